"""Every query against its DuckDB SQL; the native tier against the kernel."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from mendery import types as t
from mendery.functions import scalars as N
from mendery.kernel import scalars as S
from mendery.operators.decode import parse
from mendery.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return f"{x:.6f}"
    return str([plain(v) for v in x]) if isinstance(x, list | tuple) else str(x)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for x in TABLES:
        con.execute(f"CREATE VIEW {x} AS SELECT * FROM '{SF}/{x}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in cur.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(plain(r[n]) for n in sorted(names)) for r in df.collect()) == want and want


TEXTS = ["", " ", "12", " -1,234.5 ", "$5", "$ 1,000", "1/4", "1/0", "1/2/3", "12.", "a 12 b 3", "-7 of", "1e3", "12abc", ".5", "true", "TRUE!", "untrue", "étrue", "true false", "**False**", "ONE", "one", "'TWO'", '"two"', "ONE or TWO", '"ONE" or TWO', "one two", "ONE: not TWO", "TWO is it", "**one** it is", "phone", "ONE_X", "k1", "take k1.", "Déjà vu", '"TWO', '{"a": "TWO"}', "  TWO!? ", "```TWO```", "'''two'''"]


def attempt(f, *args):
    try:
        return f(*args)
    except S.Bad:
        return None


def test_native_scalars_equal_the_kernel(spark):
    spec = t.enum("ONE", "TWO", aliases={"k1": "ONE"})
    df = spark.createDataFrame([(x,) for x in TEXTS], "s string")
    s = F.col("s")
    rows = df.select(s, N.number(s).alias("n"), N.number_in_prose(s).alias("p"), N.number_in_prose(s, True).alias("q"), N.boolean(s).alias("b"), N.enum_value(s, spec).alias("e"), N.literal_string(s, "TWO").alias("l"), N.literal_string(s, "deja vu").alias("d")).collect()
    for r in rows:
        want = (attempt(S.number, r.s), attempt(S.number_in_prose, r.s), attempt(S.number_in_prose, r.s, True), attempt(S.boolean, r.s), attempt(S.enum_value, spec, r.s))
        assert tuple(r)[1:6] == want, r
        if "```" not in r.s:
            assert (r.l, r.d) == (attempt(S.literal_string, "TWO", r.s), attempt(S.literal_string, "deja vu", r.s)), r


def test_native_tier_equals_the_kernel(spark):
    spec = t.struct(a=t.number, b=t.string.nullable(), c=t.array(t.boolean).optional(), d=t.mapping(t.number).nullable().optional(), e=t.struct(kind=t.enum("x", "y")), sum_mary=t.string.optional())
    texts = ['{"a": 1, "b": "s", "e": {"kind": "x"}}', '{"a": 1.50, "b": null, "c": [true, false], "d": {"k": 2}, "e": {"kind": "y"}, "zz": [1]}', '{"a": "1", "b": "s", "e": {"kind": "X"}}', '{"a": 1, "A": 2, "b": "s", "e": {"kind": "x"}}',
             '{"a": 1, "b": "s", "e": {"kind": "x"}} bye', '{"a": 1, "b": "s", "e": {"kind": "x"}} {"a": 2}', '{"a": 1, "b": "s", "c": [], "d": {}, "e": {"kind": "x"}}', '{"a": 1, "a": 2, "b": "s", "e": {"kind": "x"}}', '{"a": 1, "b": 5, "c": null, "e": {"kind": "x"}}',
             '{"a": 1e400, "b": "s", "e": {"kind": "x"}}', '{"a": 1, "b": "s", "e": {"kind": "x"}, "sumMary": "q"}', "[1]", "null", "", None, '{"a": 12345678901234567890, "b": "é\\u0301", "e": {"kind": "x"}}', '{"a": true, "b": "s", "e": {"kind": "z"}}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string")
    keep = ("value", "ok")
    both = [[[r.p[k] for k in keep] for r in df.select("i", parse("s", spec, native_tier=n).alias("p")).orderBy("i").collect()] for n in (True, False)]
    assert both[0] == both[1]
    assert sum(ok for _, ok in both[0]) >= 8 and not both[0][14][1]


def test_numbers_follow_the_rules():
    assert math.isclose(S.number("-2,000.00"), -2000)
