"""Compare a query with its DuckDB SQL on the driver's tables."""

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(n) for n in names]
    want = sorted(tuple(str(r[i]) for i in at) for r in cur.fetchall())
    df = query(spark, sf)
    assert sorted(df.columns) == names
    got = sorted(tuple(str(r[n]) for n in names) for r in df.collect())
    return got, want
