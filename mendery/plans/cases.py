"""Queries for behaviours that the main catalogue doesn't reach, each with a DuckDB oracle that compares whole values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery import types as t
from mendery.operators.decode import LenientParser, parse, value
from mendery.plans.catalogue import FENCE, any_json, query
from mendery.sources import table

NS = t.struct(n=t.number, s=t.string)
_K = "CAST(n_nationkey AS DOUBLE)"


def _decoded(spark: SparkSession, sf_dir: str, text: str, spec: t.Spec, **options) -> DataFrame:
    """Nations written as `text` (printf of key and name): key, decoded value `v` and `ok`."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.format_string(text, "n_nationkey", "n_name").alias("text"))
    return rows.select("n_nationkey", parse("text", spec, **options).alias("p")).select("n_nationkey", F.col("p.value").alias("v"), "p.ok")


# -- API


@query(f"SELECT n_nationkey, {_K} AS n, n_name AS s, true AS ok FROM nation")
def lenient_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.format_string("so {n: %d, s: '%s',}", "n_nationkey", "n_name").alias("text"))
    return LenientParser(NS).transform(rows, "text", "p").select("n_nationkey", "p.value.n", "p.value.s", "p.ok")


@query(f"SELECT n_nationkey, n_nationkey % 2 = 0 AS ok, CASE WHEN n_nationkey % 2 = 0 THEN {_K} END AS n FROM nation")
def options_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without extraction and fixes only valid JSON decodes."""
    k = F.col("n_nationkey")
    text = F.when(k % 2 == 0, F.format_string('{"n": %d, "s": "a"}', k)).when(k % 4 == 1, F.format_string(f'{FENCE}json\n{{"n": %d, "s": "a"}}\n{FENCE}', k)).otherwise(F.format_string("{n: %d, s: 'a'}", k))
    p = parse(text, NS, allow_extract=False, allow_fixes=False, allow_as_string=False)
    return table(spark, sf_dir, "nation").select("n_nationkey", p.alias("p")).select("n_nationkey", "p.ok", "p.value.n")


@query(f"SELECT n_nationkey, {_K} AS n, n_name AS s FROM nation")
def allow_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "{n: %d, s: '%s'}", NS, allow_fixes=False, allow_malformed=True).select("n_nationkey", "v.n", "v.s")


# -- strategies on strings


@query("SELECT n_nationkey, '{\"a\": ' || n_nationkey || '}' AS v FROM nation")
def raw_string_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, '{"a": %d}', t.string).select("n_nationkey", "v")


@query("SELECT n_nationkey, '\"' || n_nationkey || '\"' AS v FROM nation")
def quoted_primitive_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _decoded(spark, sf_dir, '"%d"', t.union(t.string, t.number))
    return got.select("n_nationkey", F.try_variant_get("v", "$", "string").alias("v"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS ok FROM nation")
def cut_quoted_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text that ends within its quotes is none of several literals."""
    text = F.when(F.col("n_nationkey") % 2 == 0, F.lit('"one"')).otherwise(F.lit('"one'))
    return table(spark, sf_dir, "nation").select("n_nationkey", parse(text, t.union(t.literal("one"), t.literal("two")))["ok"].alias("ok"))


@query(f"SELECT n_nationkey, {_K} AS v FROM nation")
def wrapped_number_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "the answer is %d", t.number.optional()).select("n_nationkey", "v")


# -- lenient values


@query("SELECT n_nationkey, 'a' || chr(10) || '  ' || n_name AS s FROM nation")
def triple_single_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "{s: '''\n  a\n    %2$s\n''', n: %1$d}", NS).select("n_nationkey", "v.s")


@query("SELECT n_nationkey, 'print(' || n_nationkey || ')' AS s FROM nation")
def fenced_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, f'{{"s": {FENCE}python\nprint(%d)\n{FENCE}, "n": 2}}', NS).select("n_nationkey", "v.s")


@query("SELECT n_nationkey, '\"' || n_name || '\"' AS s FROM nation")
def doubled_quotes_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, '{"n": %d, "s": ""%s""}', NS).select("n_nationkey", "v.s")


@query(f"SELECT n_nationkey, {_K} AS n, n_name AS s FROM nation")
def value_glued_to_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, '{"n": %d, "s": "%s", "o": null{"x": 1}}', NS).select("n_nationkey", "v.n", "v.s")


@query(f"SELECT n_nationkey, {_K} AS n, true AS b, CAST(NULL AS VARCHAR) AS c, false AS e FROM nation")
def lenient_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = t.struct(n=t.number, b=t.boolean, c=t.string.nullable(), e=t.boolean)
    return _decoded(spark, sf_dir, "{n: %d, b: true, c: null, e: false}", spec).select("n_nationkey", "v.*")


@query("SELECT n_nationkey, 'a\" and so it goes on ' || n_name AS s FROM nation")
def prose_after_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, '{"n": %d, "s": "a" and so it goes on %s', NS).select("n_nationkey", "v.s")


# -- scalars, enums, literals


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS ok, CASE WHEN n_nationkey % 2 = 0 THEN 1.0::DOUBLE END AS n, CASE WHEN n_nationkey % 2 = 0 THEN false END AS b, CAST(NULL AS DOUBLE) AS o FROM nation")
def scalar_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """true is 1, null and arrays are no number, a failed optional is null."""
    k = F.col("n_nationkey")
    n = F.when(k % 2 == 0, F.lit("true")).when(k % 4 == 1, F.lit("null")).otherwise(F.lit("[1]"))
    text = F.concat(F.lit('{"n": '), n, F.lit(', "b": false, "o": "none"}'))
    p = parse(text, t.struct(n=t.number, b=t.boolean, o=t.number.optional()), allow_as_string=False)
    return table(spark, sf_dir, "nation").select("n_nationkey", p.alias("p")).select("n_nationkey", "p.ok", "p.value.n", "p.value.b", "p.value.o")


@query("SELECT n_nationkey, 'B' AS e, '5' AS f, CAST(NULL AS VARCHAR) AS g FROM nation")
def enum_from_other_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fitting item of an array, a number by its text, a fenced null."""
    spec = t.struct(e=t.enum("A", "B"), f=t.enum("A", "5"), g=t.enum("A", "B").nullable())
    return _decoded(spark, sf_dir, f'{{"e": ["x%d", "B", "A"], "f": 5, "g": "{FENCE}json\\nnull\\n{FENCE}"}}', spec).select("n_nationkey", "v.*")


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS ok FROM nation")
def enum_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = t.struct(e=t.enum("A", "B").require("is A", lambda x: x == "A"))
    text = F.when(F.col("n_nationkey") % 2 == 0, F.lit('{"e": "A"}')).otherwise(F.lit('{"e": "B"}'))
    return table(spark, sf_dir, "nation").select("n_nationkey", parse(text, spec, allow_as_string=False)["ok"].alias("ok"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS ok, CASE WHEN n_nationkey % 2 = 0 THEN 'café latte' END AS l FROM nation")
def literal_accents_and_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case and accents don't count; a text that holds a structure isn't searched."""
    text = F.when(F.col("n_nationkey") % 2 == 0, F.lit('{"l": "CAFE LATTE"}')).otherwise(F.lit('{"l": "{\\"a\\": \\"café latte\\"}"}'))
    p = parse(text, t.struct(l=t.literal("café latte")), allow_as_string=False)
    return table(spark, sf_dir, "nation").select("n_nationkey", p.alias("p")).select("n_nationkey", "p.ok", "p.value.l")


# -- objects, arrays, maps


@query(f"SELECT n_nationkey, {_K} AS n, n_name AS s FROM nation")
def later_entry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, '{"n": -1, "s": "%2$s", "n": %1$d}', NS).select("n_nationkey", "v.n", "v.s")


@query(f"SELECT n_nationkey, 1.0::DOUBLE AS a, {_K} AS b FROM nation")
def merged_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = t.struct(o=t.struct(a=t.number, b=t.number))
    return _decoded(spark, sf_dir, '{"o": {"a": 1, "b": -1}, "o": {"b": %d}}', spec).select("n_nationkey", "v.o.*")


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS ok FROM nation")
def array_without_fitting_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("n_nationkey") % 2 == 0, F.lit('["x", "7"]')).otherwise(F.lit('["x", "y"]'))
    return table(spark, sf_dir, "nation").select("n_nationkey", parse(text, t.array(t.number), allow_as_string=False)["ok"].alias("ok"))


@query(f"SELECT n_nationkey, {_K} AS a, n_name AS b FROM nation")
def objects_into_union_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = t.array(t.struct(v=t.union(t.struct(a=t.number), t.struct(b=t.string))))
    got = _decoded(spark, sf_dir, '[{"a": %d}, {"b": "%s"}]', spec)
    return got.select("n_nationkey", F.try_variant_get(F.col("v")[0]["v"], "$.a", "double").alias("a"), F.try_variant_get(F.col("v")[1]["v"], "$.b", "string").alias("b"))


@query("SELECT n_nationkey, n_nationkey < 3 AS ok FROM nation")
def array_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = t.struct(l=t.array(t.number).require("short", lambda x: len(x) < 3))
    text = F.concat(F.lit('{"l": ['), F.concat_ws(",", F.transform(F.sequence(F.lit(1), F.greatest("n_nationkey", F.lit(1))), lambda x: x.cast("string"))), F.lit("]}"))
    return table(spark, sf_dir, "nation").select("n_nationkey", parse(text, spec, allow_as_string=False)["ok"].alias("ok"))


@query(f"SELECT n_nationkey, '{{a: [' || n_nationkey || ']}}' AS k, {_K} AS a, 0 AS none FROM nation")
def map_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object where a text is wanted, a map inside a string, a scalar where a map is wanted."""
    spec = t.struct(m=t.mapping(t.string, t.string), q=t.mapping(t.string, t.number), z=t.mapping(t.string, t.number))
    got = _decoded(spark, sf_dir, '{"m": {"k": {"a": [%1$d]}}, "q": "{\\"a\\": %1$d}", "z": 5}', spec)
    return got.select("n_nationkey", F.col("v.m")["k"].alias("k"), F.col("v.q")["a"].alias("a"), F.size("v.z").alias("none"))


# -- unions


@query("SELECT n_nationkey, CAST(NULL AS VARCHAR) AS a, 0.0::DOUBLE AS b FROM nation")
def union_without_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nullable option takes what nothing fits; defaults are made up only if asked for."""
    spec = t.struct(a=t.union(t.enum("A"), t.literal("q").nullable()), b=t.union(t.number, t.boolean))
    got = _decoded(spark, sf_dir, '{"a": [%d], "b": {}}', spec, fabricate_defaults=True)
    return got.select("n_nationkey", F.try_variant_get("v.a", "$", "string").alias("a"), F.try_variant_get("v.b", "$", "double").alias("b"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS DOUBLE) END AS n, CASE WHEN n_nationkey % 2 = 1 THEN true END AS b FROM nation")
def union_scalar_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    text = F.when(k % 2 == 0, F.format_string("I think it is %d", k)).otherwise(F.lit("I say that is true"))
    v = value(text, t.union(t.number, t.boolean))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.when(k % 2 == 0, F.try_variant_get(v, "$", "double")).alias("n"), F.when(k % 2 == 1, F.try_variant_get(v, "$", "boolean")).alias("b"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS ok FROM nation")
def ambiguous_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two literals that aren't texts in one text are ambiguous."""
    text = F.when(F.col("n_nationkey") % 2 == 0, F.lit("just 2")).otherwise(F.lit("1 or 2"))
    return table(spark, sf_dir, "nation").select("n_nationkey", parse(text, t.union(t.literal(1), t.literal(2)))["ok"].alias("ok"))


@query(f"SELECT n_nationkey, {_K} AS a FROM nation")
def fence_in_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = t.struct(v=t.union(t.struct(a=t.number), t.number))
    got = _decoded(spark, sf_dir, f'{{"v": "see {FENCE}json\\n{{\\"a\\": %d}}\\n{FENCE} there"}}', spec)
    return got.select("n_nationkey", F.try_variant_get("v.v", "$.a", "double").alias("a"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS ok, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS y FROM nation")
def tagged_fence_and_unknown_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = t.tagged("type", t.struct(type=t.literal("a"), x=t.number), t.struct(type=t.literal("b"), y=t.string))
    tag = F.when(F.col("n_nationkey") % 2 == 0, F.lit("b")).otherwise(F.lit("zz"))
    p = parse(F.format_string(f'so: {FENCE}json\n{{"type": "%s", "y": "%s"}}\n{FENCE}', tag, "n_name"), spec, allow_as_string=False)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", p.alias("p"))
    return rows.select("n_nationkey", "p.ok", F.try_variant_get("p.value", "$.y", "string").alias("y"))


@query("""SELECT n_nationkey, '{"bool":true,"list":[1,[2,"' || n_name || '"],{"k":null}],"object":{"n":' || n_nationkey || ',"object":{"list":[]}}}' AS json FROM nation""")
def any_json_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive union gives back the very structure; objects aren't wrapped."""
    got = _decoded(spark, sf_dir, '{"bool": true, "list": [1, [2, "%2$s"], {"k": null}], "object": {"n": %1$d, "object": {"list": []}}}', any_json(), native_tier=False)
    return got.select("n_nationkey", F.to_json("v").alias("json"))


@query("""SELECT n_nationkey, repeat('{"a":[', n_nationkey % 9) || '1' || repeat(']}', n_nationkey % 9) AS json FROM nation""")
def any_json_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (F.col("n_nationkey") % 9).cast("int")
    text = F.concat(F.repeat(F.lit("{a: ["), d), F.lit("1"), F.repeat(F.lit(",]}"), d))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(value(text, any_json())).alias("json"))


# -- partial texts


@query(f"SELECT n_nationkey, list_value('a', '') AS names, list_value(1.0::DOUBLE, {_K}) AS nums FROM nation")
def partial_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements cut off are kept with defaults; a comma at the end adds nothing."""
    items = _decoded(spark, sf_dir, '[{"id": 1, "name": "a"}, {"id": %d, "na', t.array(t.struct(id=t.number, name=t.string)), allow_partial=True)
    nums = _decoded(spark, sf_dir, "[1, %d, ", t.array(t.number), allow_partial=True).select("n_nationkey", F.col("v").alias("nums"))
    return items.select("n_nationkey", F.col("v.name").alias("names")).join(nums, "n_nationkey")


@query(f"SELECT n_nationkey, list_value('a') AS keys, {_K} AS a FROM nation")
def partial_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _decoded(spark, sf_dir, '{"a": %d, "b": ', t.mapping(t.string, t.number), allow_partial=True)
    return got.select("n_nationkey", F.map_keys("v").alias("keys"), F.col("v")["a"].alias("a"))


@query(f"SELECT n_nationkey, {_K} AS id, n_name AS name FROM nation")
def partial_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = t.struct(id=t.number, items=t.array(t.struct(id=t.number, name=t.string)))
    got = _decoded(spark, sf_dir, '{"id": %d, "items": [{"id": 2, "name": "%s"', spec, allow_partial=True)
    return got.select("n_nationkey", "v.id", F.col("v.items")[0]["name"].alias("name"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS ok FROM nation")
def not_null_directive(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = t.struct(id=t.number, q=t.alias(t.string.nullable(), not_null=True))
    text = F.when(F.col("n_nationkey") % 2 == 0, F.lit('{"id": 1, "q": "x"}')).otherwise(F.lit('{"id": 1, "q": null}'))
    return table(spark, sf_dir, "nation").select("n_nationkey", parse(text, spec, native_tier=False, allow_as_string=False)["ok"].alias("ok"))


# -- constraints


@query("SELECT n_nationkey, n_nationkey BETWEEN 3 AND 9 AS several, n_nationkey < 5 AS block, n_nationkey <> 7 AS map, n_name LIKE '%A%' AS format FROM nation")
def constraint_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several predicates on one field, one on an object, on a map and on a text's form."""
    import re

    ok = lambda text, spec: parse(text, spec, allow_as_string=False)["ok"]
    k = F.col("n_nationkey")
    several = t.struct(n=t.number.require("least", lambda x: x >= 3).require("most", lambda x: x <= 9))
    block = t.struct(a=t.number, b=t.number).require("ordered", lambda o: o["a"] < o["b"])
    held = t.struct(m=t.mapping(t.string, t.number).require("no seven", lambda m: 7 not in m.values()))
    form = t.struct(s=t.string.require("has A", lambda x: re.search("A", x) is not None))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey",
        ok(F.format_string('{"n": %d}', k), several).alias("several"),
        ok(F.format_string('{"a": %d, "b": 5}', k), block).alias("block"),
        ok(F.format_string('{"m": {"x": %d}}', k), held).alias("map"),
        ok(F.format_string('{"s": "%s"}', "n_name"), form).alias("format"),
    )


@query("SELECT n_nationkey, 'a: constraint small fails; b: constraint large fails' AS error FROM nation")
def every_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = t.struct(a=t.number.require("small", lambda x: x < 0), b=t.number.require("large", lambda x: x > 99))
    p = parse(F.format_string('{"a": %1$d, "b": %1$d}', "n_nationkey"), spec, allow_as_string=False)
    return table(spark, sf_dir, "nation").select("n_nationkey", p["error"].alias("error"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey > 20 THEN 3 ELSE 2 END AS kept, n_nationkey <= 20 AS ok FROM nation WHERE n_nationkey > 10")
def array_length_after_dropping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that break a constraint go, then the array's own constraint is held."""
    item = t.union(t.struct(bar=t.number.require("small", lambda x: x < 10)), t.struct(bar=t.number.require("big", lambda x: x > 20)))
    text = F.format_string('[{"bar": 5}, {"bar": %d}, {"bar": 25}]', "n_nationkey")
    kept = F.size(value(text, t.array(item)))
    ok = parse(F.concat(F.lit('{"l": '), text, F.lit("}")), t.struct(l=t.array(item).require("two", lambda x: len(x) == 2)), allow_as_string=False)["ok"]
    return table(spark, sf_dir, "nation").filter("n_nationkey > 10").select("n_nationkey", kept.alias("kept"), ok.alias("ok"))
