import math

import numpy as np

from mendery.llm.vector_search import op2_ivfpq_search, search


def brute(ids, x, every, k):
    x = np.asarray(x, np.float64)
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            s = x @ x[i]
            order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
            out[q] = [(ids[j], s[j]) for j in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    return np.mean([len({a for a, _ in got[q]} & {a for a, _ in w}) / len(w) for q, w in want.items()])


def test_recall_against_brute_force(spark):
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], np.float32)
    got = by_query(op2_ivfpq_search(spark, "/root/testdata/sf0.1").collect())
    want = brute(ids, x, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    at = {v: i for i, v in enumerate(ids.tolist())}
    for q, near in got.items():
        assert all(math.isclose(s, float(x[at[q]].astype(float) @ x[at[v]].astype(float)), rel_tol=1e-12, abs_tol=1e-12) for v, s in near)
        assert near == sorted(near, key=lambda e: (-e[1], e[0]))


def test_copies_ties_and_norms(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(400, 8)) * rng.uniform(0.5, 3, size=(400, 1))).astype(np.float32)
    x[100:300] = x[7]
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    got = by_query(search(spark.createDataFrame(data, "vec_id long, embedding array<float>"), k=5, every=10, probe_share=1.0, block_rows=16, pack_rows=4).collect())
    want = brute(np.arange(400), x, 10, 5)
    assert {q: [a for a, _ in v] for q, v in got.items()} == {q: [a for a, _ in v] for q, v in want.items()}


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    data = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [1.0, -0.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 as cell", "'x' as ids")
    rows = search(df, probe_share=1.0).collect()
    got = sorted((r.query_id, r.rank, r.vec_id) for r in rows)
    assert got == sorted([(0, 1, 20), (0, 2, 20), (0, 3, 1)] + [(20, 1, 0), (20, 2, 20), (20, 3, 1)] * 2)
    assert search(df.limit(0)).count() == 0


def test_codes_that_say_little(spark):
    """of wide vectors without structure the codes are rough; none of the nearest in the probed cells is lost by them."""
    x = np.random.default_rng(3).normal(size=(3000, 192)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = brute(np.arange(3000), x, 100, 10)
    assert recall(by_query(search(df, k=10, every=100, rerank=32).collect()), want) >= 0.9
    assert recall(by_query(search(df, k=10, every=100, rerank=32, probe_share=1.0).collect()), want) == 1
