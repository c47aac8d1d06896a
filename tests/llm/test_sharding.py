import math
import zlib
from collections import Counter, defaultdict

from mendery.llm.sharding import HashTree, Leaf, op5_hash_tree_shards, shard_rows

SF = "/root/testdata/sf0.001"


def test_all_rows_sizes_slots_and_growth(spark):
    rows = op5_hash_tree_shards(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        b = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(b) + 8, zlib.crc32(b), "key")
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(slots) <= set(range(24))


def test_shares_follow_weights_and_only_the_new_shard_takes(spark):
    tree = HashTree((Leaf(0, 0, 0, 1.0), Leaf(0, 0, 1, 3.0), Leaf(0, 1, 2, 2.0), Leaf(1, 0, 3, 2.0)))
    df = spark.range(20000).selectExpr("id as doc_id", "'x' as text", "1 as shard")
    rows = shard_rows(df, tree, tree.grow(9, 1, 0, 2.0)).collect()
    n = Counter(r.shard for r in rows)
    for s, w in ((0, 1), (1, 3), (2, 2), (3, 2)):
        assert math.isclose(n[s] / 20000, w / 8, abs_tol=0.015)
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {9}
    assert math.isclose(len(moved) / 20000, 0.2, abs_tol=0.015)
    assert {r.shard for r in moved} == {0, 1, 2, 3}
    assert rows and all(r.shard == s for r, s in zip(sorted(rows), [r.shard for r in sorted(shard_rows(df, tree).collect())], strict=True))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, None, 2), (5, None, 3), (5, "", 4), (7, "b", 5), (7, "b", 6)], "doc_id long, text string, slot int")
    rows = shard_rows(df, HashTree.even(3)).collect()
    assert len(rows) == 6 and len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sorted(r.size for r in rows) == [8, 8, 8, 9, 9, 9]
    assert len({(r.shard, r.slot) for r in rows}) == 6
    assert shard_rows(df.limit(0), HashTree.even(3)).count() == 0
