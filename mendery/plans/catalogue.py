"""The queries of the survey's catalogue and their DuckDB oracles.

Most render text from typed columns, damage it, decode it, and are held against
the columns themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery import types as t
from mendery.functions import scalars as N
from mendery.operators.decode import parse, value
from mendery.operators.extract import dedent_text, extract_candidates, repair_json
from mendery.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def money(c: str) -> Column:
    """A double as text with two decimals."""
    return F.col(c).cast("decimal(18,2)").cast("string")


def grouped(c: str) -> Column:
    """A double as text with thousands separators and two decimals."""
    return F.format_number(F.col(c).cast("decimal(18,2)"), 2)


FENCE = "```"
KV = t.struct(k=t.number)
NATION = t.struct(n_nationkey=t.number, n_name=t.string)
_NATION = "SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name FROM nation"


def segments(spark: SparkSession, sf_dir: str) -> t.Enum:
    """The values of c_mktsegment: a handful whatever the table's size."""
    rows = table(spark, sf_dir, "customer").select("c_mktsegment").distinct().filter("c_mktsegment IS NOT NULL").collect()
    return t.enum(*sorted(r[0] for r in rows))


def _rendered(spark: SparkSession, sf_dir: str, text: str, spec: t.Spec = NATION, native_tier: bool = True) -> DataFrame:
    """Nations written as `text` (printf of key and name), decoded."""
    rows = table(spark, sf_dir, "nation").select(F.format_string(text, "n_nationkey", "n_name").alias("text"))
    return rows.select(parse("text", spec, native_tier=native_tier)["value"].alias("v")).select("v.*")


# -- strict JSON and objects


@query("SELECT event_type, count(*) AS n, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS avg_k FROM events GROUP BY event_type")
def strict_struct_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", value("props", KV)["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("k"), 6).alias("avg_k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, true AS ok, 'json' AS strategy FROM events")
def strict_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", parse("props", KV).alias("p")).select("event_id", "p.value.k", "p.ok", "p.strategy")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def kernel_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", value("props", KV, native_tier=False)["k"].alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 2 = 1")
def trailing_text_is_not_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat("props", F.lit(" bye")))
    v = N.strict_json(text)
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "double").alias("k"))


@query(_NATION)
def unquoted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "{n_nationkey: %d, n_name: %s}")


@query(_NATION)
def single_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "{'n_nationkey': %d, 'n_name': '%s'}")


@query(_NATION)
def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, '{"n_nationkey": %d, /* the name, } */ "n_name": "%s" // end\n}')


@query(_NATION)
def trailing_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, '{"n_nationkey": %d, "n_name": "%s",}')


@query(_NATION)
def missing_comma_and_colon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, '{"n_nationkey" %d\n "n_name": "%s"}')


@query(_NATION)
def doubled_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rendered(spark, sf_dir, '{"n_nationkey": %d, "n_name": ""%s""}')
    return rows.withColumn("n_name", F.regexp_replace("n_name", '"', ""))


@query("SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, 'he said \"' || n_name || '\", and left' AS n_name FROM nation")
def unescaped_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, '{"n_nationkey": %d, "n_name": "he said "%s", and left"}')


@query("SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name || chr(10) || 'é🙂\\/' AS n_name FROM nation")
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "{\"n_nationkey\": %d, 'n_name': \"%s\\n\\u00e9\\ud83d\\ude42\\\\/\"}")


@query("SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, 'def f():' || chr(10) || '  return ' || n_name AS n_name FROM nation")
def triple_quote_dedent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, '{"n_nationkey": %d, "n_name": """\n    def f():\n      return %s\n  """}')


@query("SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, 'the nation ' || n_name || ',' || chr(10) || ' and others' AS n_name FROM nation")
def bareword_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "{n_name: the nation %2$s,\n and others,\n n_nationkey: %1$d}")


@query("SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, 'print(' || n_name || ')' AS n_name FROM nation")
def code_in_backticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, '{"n_nationkey": %d, "n_name": `print(%s)`}')


@query(_NATION)
def key_aliasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, '{"N-NationKey": %d, " n name ": "%s"}')


@query("SELECT CAST(n_nationkey AS DOUBLE) AS id, n_name AS description FROM nation")
def declared_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, '{"nation_number": %d, "summary": "%s"}', t.struct(id=t.alias(t.number, "nationNumber"), description=t.string))


@query(_NATION)
def unknown_keys_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, '{"x": [1, {}], "n_nationkey": %d, "n_name": "%s", "y": null}')


@query("SELECT n_nationkey, n_nationkey % 3 <> 0 AS ok FROM nation")
def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("n_nationkey") % 3 == 0, F.lit('{"other": 1, "more": 2}')).otherwise(F.lit('{"a": 1, "b": 2}'))
    return table(spark, sf_dir, "nation").select("n_nationkey", parse(text, t.struct(a=t.number, b=t.number))["ok"].alias("ok"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS opt, CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey AS DOUBLE) END AS nul FROM nation")
def optional_and_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = t.struct(opt=t.string.optional(), nul=t.number.nullable())
    text = F.concat(F.lit("{"), F.when(F.col("n_nationkey") % 2 == 0, F.format_string('"opt": "%s",', "n_name")).otherwise(""), F.lit('"nul": '), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey").cast("string")).otherwise("null"), F.lit("}"))
    return table(spark, sf_dir, "nation").select("n_nationkey", value(text, spec).alias("v")).select("n_nationkey", "v.opt", "v.nul")


@query("SELECT n_nationkey, list_value(1.0::DOUBLE, CAST(n_nationkey AS DOUBLE)) AS v FROM nation")
def dup_keys_to_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('{"v": 1, "v": %d}', "n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", value(text, t.struct(v=t.array(t.number)))["v"].alias("v"))


@query(_NATION)
def object_in_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.format_string('{"in": "{\\"n_nationkey\\": %d, \\"n_name\\": \\"%s\\"}"}', "n_nationkey", "n_name").alias("text"))
    return rows.select(value("text", t.struct({"in": NATION}))["in"].alias("v")).select("v.*")


@query("SELECT CAST(o_orderkey AS DOUBLE) AS foo, true AS ok FROM orders")
def implied_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parse(F.concat(F.lit(" "), F.col("o_orderkey").cast("string")), t.struct(foo=t.number))
    return table(spark, sf_dir, "orders").select(p.alias("p")).select("p.value.foo", "p.ok")


@query("SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_orderkey")
def nested_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of their lines, decoded and flattened again."""
    line = F.format_string("{number: %d, quantity: %s,}", "l_linenumber", money("l_quantity"))
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("Lines:\n```json\n{'lines': ["), F.concat_ws(",\n", F.collect_list(line)), F.lit("]}\n```")).alias("text"))
    spec = t.struct(lines=t.array(t.struct(number=t.number, quantity=t.number)))
    rows = docs.select("l_orderkey", value("text", spec)["lines"].alias("lines"))
    return rows.select("l_orderkey", F.size("lines").cast("long").alias("n"), F.round(F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["quantity"]), 2).alias("quantity"))


# -- numbers


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS v FROM orders")
def comma_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"v": '), grouped("o_totalprice"), F.lit(', "w": 1}'))
    return table(spark, sf_dir, "orders").select("o_orderkey", value(text, t.struct(v=t.number, w=t.number))["v"].alias("v"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS dollars, CAST(o_orderkey AS DOUBLE) / (1 + o_custkey % 7) AS fraction FROM orders")
def currency_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    dollars = N.number(F.concat(F.lit("$"), grouped("o_totalprice")))
    fraction = N.number(F.concat_ws("/", "o_orderkey", 1 + F.col("o_custkey") % 7))
    return table(spark, sf_dir, "orders").select("o_orderkey", dollars.alias("dollars"), fraction.alias("fraction"))


@query("SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS first, -CAST(o_custkey AS DOUBLE) AS signed FROM orders")
def number_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("It is about -"), F.col("o_custkey").cast("string"), F.lit(" or 7, I think."))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.number_in_prose(text).alias("first"), N.number_in_prose(text, signed=True).alias("signed"))


@query("SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS v FROM orders")
def number_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", N.number(F.concat(F.col("o_custkey").cast("string"), F.lit("abc"))).alias("v"))


@query("SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS v FROM orders")
def bool_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_custkey") % 3 == 0, F.lit("I say **True**, étrange")).when(F.col("o_custkey") % 3 == 1, F.lit("that is FALSE.")).otherwise(F.lit("true or false"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.boolean(text).alias("v"))


@query("SELECT event_id, CAST(k AS VARCHAR) AS s, CAST(k AS DOUBLE) AS n, k <> 0 AS b FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def scalar_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r"\d+", 0)
    text = F.concat(F.lit('{"s": '), k, F.lit(', "n": "'), k, F.lit('", "b": '), k, F.lit("}"))
    spec = t.struct(s=t.string, n=t.number, b=t.boolean)
    return table(spark, sf_dir, "events").select("event_id", value(text, spec).alias("v")).select("event_id", "v.*")


@query("SELECT DISTINCT '{a: x, b: [1,2]}' AS obj, '[1,\"q\"]' AS arr, 'null' AS nul, 'true' AS yes FROM region")
def string_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit('{"obj": {"a": "x", "b": [1, 2]}, "arr": [1, "q"], "nul": null, "yes": true}')
    spec = t.struct(obj=t.string, arr=t.string, nul=t.string, yes=t.string)
    return table(spark, sf_dir, "region").select(value(text, spec).alias("v")).select("v.*").distinct()


# -- enums and literals


@query("SELECT c_custkey, c_mktsegment AS v FROM customer")
def enum_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("The segment is **"), F.lower("c_mktsegment"), F.lit("**, I think."))
    return table(spark, sf_dir, "customer").select("c_custkey", N.enum_value(text, segments(spark, sf_dir)).alias("v"))


@query("SELECT c_custkey, c_mktsegment AS v FROM customer")
def enum_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('"'), F.initcap("c_mktsegment"), F.lit('"'))
    return table(spark, sf_dir, "customer").select("c_custkey", N.enum_value(text, segments(spark, sf_dir)).alias("v"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS v, c_custkey % 2 = 0 AS ok FROM customer")
def enum_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = segments(spark, sf_dir)
    other = F.when(F.col("c_mktsegment") == spec.values[0], spec.values[1]).otherwise(spec.values[0])
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(" it is"))).otherwise(F.concat("c_mktsegment", F.lit(" or "), other, F.lit(" it is")))
    return table(spark, sf_dir, "customer").select("c_custkey", parse(text, spec).alias("p")).select("c_custkey", F.col("p.value").alias("v"), "p.ok")


@query("SELECT c_custkey, c_mktsegment AS v FROM customer")
def enum_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = segments(spark, sf_dir)
    named = t.enum(*spec.values, aliases={f"k{i}": v for i, v in enumerate(spec.values)})
    text = F.lit(None).cast("string")
    for i, v in enumerate(spec.values):
        text = F.when(F.col("c_mktsegment") == v, F.lit(f"I'd take k{i}: the usual")).otherwise(text)
    return table(spark, sf_dir, "customer").select("c_custkey", N.enum_value(text, named).alias("v"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag AS v FROM lineitem")
def literal_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.col("l_linenumber") % 4
    text = F.when(way == 0, F.concat(F.lit('" '), F.lower("l_returnflag"), F.lit(' "'))).when(way == 1, F.concat("l_returnflag", F.lit("!@#"))).when(way == 2, F.concat(F.lit("'"), "l_returnflag", F.lit("'"))).otherwise(F.concat(F.lit("it would be "), "l_returnflag", F.lit(".")))
    got = F.coalesce(*[N.literal_string(text, v) for v in ("A", "N", "R")])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", got.alias("v"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '1' WHEN 1 THEN 'true' WHEN 2 THEN '\"THREE\"' END AS v, n_nationkey % 4 <> 3 AS ok FROM nation")
def literal_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.col("n_nationkey") % 4
    text = F.when(way == 0, F.lit('{"status": 1}')).when(way == 1, F.lit('{"r": true}')).when(way == 2, F.lit('{"v": "the answer is THREE"}')).otherwise(F.lit('{"a": 1, "b": 2}'))
    p = parse(text, t.union(t.literal(1), t.literal(True), t.literal("THREE")))
    return table(spark, sf_dir, "nation").select("n_nationkey", p.alias("p")).select("n_nationkey", F.to_json("p.value").alias("v"), "p.ok")


# -- arrays and maps


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) + CASE WHEN o_orderkey % 3 = 1 THEN 3 WHEN o_orderkey % 3 = 2 THEN 1 ELSE 4 END AS total FROM orders")
def drop_bad_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.lit('"x"')
    a = F.when(F.col("o_orderkey") % 3 == 1, bad).otherwise(F.lit("1"))
    b = F.when(F.col("o_orderkey") % 3 == 2, bad).otherwise(F.lit("3"))
    text = F.concat(F.lit("["), a, F.lit(", "), b, F.lit(", "), F.col("o_orderkey").cast("string"), F.lit("]"))
    v = value(text, t.array(t.number))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("SELECT o_orderkey, list_value(o_orderstatus) AS v FROM orders")
def scalar_to_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", value(F.concat(F.lit('"'), "o_orderstatus", F.lit('"')), t.array(t.string)).alias("v"))


@query("SELECT n_nationkey, list_value(n_name, 'two words', '3') AS v FROM nation")
def bareword_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", value(F.format_string("[%s, two words, 3] is the list.", "n_name"), t.array(t.string)).alias("v"))


@query("SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS a, CAST(n_regionkey AS DOUBLE) AS b FROM nation")
def nested_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = value(F.format_string("[[%d, %d,], [1]", "n_nationkey", "n_regionkey"), t.array(t.array(t.number)))
    return table(spark, sf_dir, "nation").select("n_nationkey", v.alias("v")).select("n_nationkey", F.col("v")[0][0].alias("a"), F.col("v")[0][1].alias("b"))


@query("SELECT n_regionkey, n_name AS key, CAST(n_nationkey AS DOUBLE) AS value FROM nation")
def map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("{"), F.concat_ws(", ", F.collect_list(F.format_string("'%s': %d", "n_name", "n_nationkey"))), F.lit("} as asked")).alias("text"))
    return maps.select("n_regionkey", F.explode(value("text", t.mapping(t.number))))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS ok FROM nation")
def map_enum_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("n_nationkey") % 2 == 0, F.lit('{"A": "one", "B": "two"}')).otherwise(F.lit('{"A": "one", "C": "two"}'))
    return table(spark, sf_dir, "nation").select("n_nationkey", parse(text, t.mapping(t.enum("A", "B"), t.string))["ok"].alias("ok"))


# -- extraction and repair


@query("SELECT page_id, CAST(regexp_extract(html, '\\{margin:(\\d+)\\}', 1) AS DOUBLE) AS margin FROM pages")
def extract_html_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", value("html", t.struct(margin=t.number))["margin"].alias("margin"))


@query(_NATION)
def markdown_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, f'Don\'t worry, here {{it}} is:\n{FENCE}json\n{{"n_nationkey": %d, "n_name": "%s"}}\n{FENCE}\nBye.')


@query(_NATION)
def open_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, f'Here:\n{FENCE}json\n{{"n_nationkey": %d, "n_name": "%s"')


@query("SELECT n_nationkey, 'fence' AS origin, 1 AS n_objects FROM nation")
def native_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string(f'so\n{FENCE}json\n{{"k": %d}}\n{FENCE}\nor so', "n_nationkey")
    body = F.get(N.fenced(text), F.lit(0))
    k = F.try_variant_get(N.strict_json(body), "$.k", "int")
    return table(spark, sf_dir, "nation").select(k.alias("n_nationkey"), F.lit("fence").alias("origin"), F.size(N.objects(text)).alias("n_objects"))


@query("SELECT n_regionkey, CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name FROM nation")
def multi_object_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.format_string('{"n_nationkey": %d, "n_name": "%s"}', "n_nationkey", "n_name")
    texts = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("There is "), F.concat_ws(" and then ", F.collect_list(one)), F.lit(" as well as {}")).alias("text"))
    return texts.select("n_regionkey", F.explode(value("text", t.array(NATION))).alias("v")).select("n_regionkey", "v.*")


@query("SELECT n_nationkey, pos, origin, json FROM (SELECT n_nationkey, 0 AS pos, 'object' AS origin, '{\"k\": ' || n_nationkey || '}' AS json FROM nation UNION ALL SELECT n_nationkey, 1, 'array', '[1, \"b\"]' FROM nation)")
def explode_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("don't {k: %d} and [1, b,] end", "n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(extract_candidates(text)).alias("pos", "c")).select("n_nationkey", "pos", "c.origin", "c.json")


@query(_NATION)
def first_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, 'a {"n_nationkey": %d, "n_name": "%s"} b {"n_nationkey": 99, "n_name": "other"}')


@query("SELECT o_orderkey, o_orderstatus AS s, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS v FROM orders")
def repair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"s": "'), "o_orderstatus", F.lit(', ]", "v": '), grouped("o_totalprice"), F.lit(", /* c */ }"))
    v = F.try_parse_json(repair_json(text))
    s = F.regexp_extract(F.try_variant_get(v, "$.s", "string"), r"^(\w+), \]$", 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"), F.try_variant_get(v, "$.v", "double").alias("v"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS v FROM orders")
def native_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{""a"": [1, 2,], "v": '), grouped("o_totalprice"), F.lit(",}"))
    fixed = N.doubled_quotes(N.thousands(N.trailing_commas(text)))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.try_variant_get(F.try_parse_json(fixed), "$.v", "double").alias("v"))


@query("SELECT n_nationkey, 'a' || chr(10) || '  ' || n_name AS v FROM nation")
def dedent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", dedent_text(F.format_string("\n   a\n     %s\n  \n", "n_name")).alias("v"))


@query("SELECT fix, count(*) AS n FROM (SELECT unnest(list_value('quoted key', 'converted quotes', 'removed trailing comma')) AS fix FROM nation) GROUP BY fix")
def fix_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(parse(F.format_string("{n_nationkey: %d, n_name: '%s',}", "n_nationkey", "n_name"), NATION)["fixes"].alias("f"))
    return rows.select(F.explode("f").alias("fix")).groupBy("fix").agg(F.count("*").alias("n"))


# -- unions, recursion and constraints


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) WHEN event_type = 'view' THEN 'true' ELSE '\"' || event_type || '\"' END AS v FROM events")
def union_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "click", F.regexp_extract("props", r"\d+", 0)).when(F.col("event_type") == "view", F.lit("true")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(value(text, t.union(t.string, t.number, t.boolean))).alias("v"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS option FROM events")
def union_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = t.struct(id=t.number, name=t.string), t.struct(id=t.number, tags=t.array(t.string))
    text = F.when(F.col("event_id") % 2 == 0, F.format_string("{id: %d, name: n, x: 1}", "event_id")).otherwise(F.format_string("so {id: %d, tags: [a, b]}", "event_id"))
    v = F.to_json(value(text, t.union(b, a)))
    return table(spark, sf_dir, "events").select("event_id", F.when(v.contains('"name"'), "a").when(v.contains('"tags"'), "b").alias("option"))


@query("SELECT event_id, event_type AS type, CASE WHEN event_type = 'click' THEN value END AS v FROM events WHERE event_type IN ('click', 'view')")
def disc_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = t.tagged("type", t.struct(type=t.literal("click"), v=t.number), t.struct(type=t.literal("view"), w=t.number))
    text = F.concat(F.lit('{"Type": "'), F.upper("event_type"), F.when(F.col("event_type") == "click", F.lit('", "v": ')).otherwise('", "w": '), F.col("value").cast("string"), F.lit(",}"))
    v = value(text, spec)
    rows = table(spark, sf_dir, "events").filter("event_type IN ('click', 'view')")
    return rows.select("event_id", F.try_variant_get(v, "$.type", "string").alias("type"), F.try_variant_get(v, "$.v", "double").alias("v"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS type, CASE WHEN event_type = 'click' THEN value END AS v, CASE WHEN event_type = 'view' THEN value END AS w, event_type IN ('click', 'view') AS ok FROM events")
def disc_union_all_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """disc_union over all events: a tag that no option knows gives no value."""
    spec = t.tagged("type", t.struct(type=t.literal("click"), v=t.number), t.struct(type=t.literal("view"), w=t.number))
    text = F.concat(F.lit('{"Type": "'), F.upper("event_type"), F.when(F.col("event_type") == "click", F.lit('", "v": ')).otherwise('", "w": '), F.col("value").cast("string"), F.lit(",}"))
    p = table(spark, sf_dir, "events").select("event_id", parse(text, spec).alias("p"))
    v = F.col("p.value")
    return p.select("event_id", F.try_variant_get(v, "$.type", "string").alias("type"), F.try_variant_get(v, "$.v", "double").alias("v"), F.try_variant_get(v, "$.w", "double").alias("w"), "p.ok")


def any_json() -> t.Spec:
    return t.union(t.number, t.boolean, t.string, t.null, t.array(t.Lazy("any", any_json)), t.mapping(t.Lazy("any", any_json)))


@query("SELECT n_nationkey, n_nationkey AS depth FROM nation")
def recursive_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("n_nationkey")
    text = F.concat(F.repeat(F.lit("{a: ["), d), F.lit("1"), F.repeat(F.lit(",]}"), d))
    v = F.to_json(value(text, any_json()))
    return table(spark, sf_dir, "nation").select("n_nationkey", (F.length(v) - F.length(F.replace(v, F.lit("["), F.lit("")))).alias("depth"))


@query("SELECT n_nationkey, n_nationkey < 10 AS ok, CASE WHEN n_nationkey < 10 THEN CAST(n_nationkey AS DOUBLE) END AS age FROM nation")
def constraint_assert(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = t.struct(age=t.number.require("small", lambda x: x < 10), name=t.string.require("named", lambda s: len(s) > 0))
    p = parse(F.format_string('{"age": %d, "name": "%s"}', "n_nationkey", "n_name"), spec)
    return table(spark, sf_dir, "nation").select("n_nationkey", p.alias("p")).select("n_nationkey", "p.ok", "p.value.age")


@query("SELECT n_nationkey, n_nationkey < 10 AS small, length(n_name) > 7 AS long FROM nation")
def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = t.struct(age=t.number.check("small", lambda x: x < 10), name=t.string.check("long", lambda s: len(s) > 7))
    c = parse(F.format_string('{"age": %d, "name": "%s"}', "n_nationkey", "n_name"), spec)["checks"]
    return table(spark, sf_dir, "nation").select("n_nationkey", c.alias("c")).select("n_nationkey", F.col("c")["small"].alias("small"), F.col("c")["long"].alias("long"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 8 THEN 'small' WHEN n_nationkey > 16 THEN 'big' END AS option FROM nation")
def union_by_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    small, big = t.struct(kind=t.string, n=t.number.require("small", lambda x: x < 8)), t.struct(n=t.number.require("big", lambda x: x > 16))
    p = parse(F.format_string('{"v": {"n": %d, "kind": "k"}}', "n_nationkey"), t.struct(v=t.union(small, big)), allow_as_string=False)
    has = F.try_variant_get(p["value"]["v"], "$.kind", "string")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.when(has.isNotNull(), "small").when(p["ok"], "big").alias("option"))


@query("SELECT c_custkey, count(*) FILTER (x < 10 OR x > 20) AS n FROM (SELECT c_custkey, unnest(list_value(c_custkey % 30, 5, 25)) AS x FROM customer) GROUP BY c_custkey")
def invalid_union_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    thing = t.union(t.struct(bar=t.number.require("small", lambda x: x < 10)), t.struct(bar=t.number.require("big", lambda x: x > 20)))
    text = F.format_string('[{"bar": %d}, {"bar": 5}, {"bar": 25}]', F.col("c_custkey") % 30)
    return table(spark, sf_dir, "customer").select("c_custkey", F.size(value(text, t.array(thing))).cast("long").alias("n"))


# -- partial texts

ITEM = t.struct(id=t.number, name=t.string, tags=t.array(t.string))


@query("SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS id, CASE n_nationkey % 3 WHEN 0 THEN '' ELSE n_name END AS name, CASE WHEN n_nationkey % 3 = 2 THEN 2 ELSE 0 END AS tags FROM nation")
def partial_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.col("n_nationkey") % 3
    head = F.format_string('```json\n{"id": %d, ', "n_nationkey")
    text = F.concat(head, F.when(way == 0, F.lit("")).when(way == 1, F.format_string('"name": "%s', "n_name")).otherwise(F.format_string('"name": "%s", "tags": ["a", "b', "n_name")))
    v = value(text, ITEM, allow_partial=True)
    return table(spark, sf_dir, "nation").select("n_nationkey", v.alias("v")).select("n_nationkey", "v.id", "v.name", F.size("v.tags").alias("tags"))


@query("SELECT n_nationkey, list_value(1.0::DOUBLE, CAST(n_nationkey AS DOUBLE)) AS v, false AS complete FROM nation")
def truncate_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parse(F.format_string("{'nums': [1, %d", "n_nationkey"), t.struct(nums=t.array(t.number)))
    return table(spark, sf_dir, "nation").select("n_nationkey", p.alias("p")).select("n_nationkey", F.col("p.value.nums").alias("v"), "p.complete")


@query("SELECT n_nationkey, list_value(1.0::DOUBLE) AS v FROM nation")
def truncate_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = value(F.format_string("{'nums': [1, %d", "n_nationkey"), t.struct(nums=t.array(t.number)), incomplete_tail="drop")
    return table(spark, sf_dir, "nation").select("n_nationkey", v["nums"].alias("v"))


@query("SELECT n_nationkey, CASE n_nationkey % 2 WHEN 0 THEN 'Incomplete' ELSE 'Complete' END AS a_state, CASE n_nationkey % 2 WHEN 0 THEN 'Pending' ELSE 'Incomplete' END AS b_state FROM nation")
def field_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = t.struct(a=t.State(t.array(t.number)), b=t.State(t.string.nullable()))
    text = F.when(F.col("n_nationkey") % 2 == 0, F.lit('{"a": [1, 2')).otherwise(F.lit('{"a": [1, 2], "b": "x'))
    return table(spark, sf_dir, "nation").select("n_nationkey", value(text, spec).alias("v")).select("n_nationkey", F.col("v.a.state").alias("a_state"), F.col("v.b.state").alias("b_state"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'not ended' END AS note FROM orders")
def done_directive(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = t.struct(id=t.number, note=t.alias(t.string.nullable(), done=True))
    text = F.concat(F.format_string('{"id": %d, "note": "not ended', "o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, F.lit('"}')).otherwise(F.lit("")))
    return table(spark, sf_dir, "orders").select("o_orderkey", value(text, spec, allow_partial=True)["note"].alias("note"))


@query("SELECT conv_id, count(*) AS n_chunks, sum(length(coalesce(text, ''))) AS chars, true AS final FROM conversations GROUP BY conv_id")
def stream_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations replayed as chunk streams; the final text of each."""
    import tempfile

    from mendery.streaming import accumulate

    source = table(spark, sf_dir, "conversations")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/conversations.parquet*")
    ends = source.groupBy("conv_id").agg(F.max("turn").alias("end"))
    chunks = stream.join(ends, "conv_id").select(F.col("conv_id"), "turn", "text", (F.col("turn") == F.col("end")).alias("last"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60).alias("ts")).withWatermark("ts", "1 minute")
    name = f"accumulated_{abs(hash((sf_dir, id(source))))}"
    where = spark.conf.get("spark.checkpoint.dir", None)
    options = {"checkpointLocation": f"{where}/{name}"} if where else {"checkpointLocation": tempfile.mkdtemp()}
    q = accumulate(chunks, "conv_id", "turn", "text", "last").writeStream.format("memory").queryName(name).options(**options).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).filter("final").select(F.col("key").cast("long").alias("conv_id"), "n_chunks", F.length("text").cast("long").alias("chars"), "final")
