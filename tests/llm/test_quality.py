import zlib

import numpy as np

from mendery.llm.quality import label_lines, line_stats, op10_crf_quality, sample, score_documents, train

GOOD = "The river runs past the old mill and on to the sea.\nPeople walk there in the evening, and some of them fish.\n"
BAD = "BUY!! NOW!! CHEAP!! BUY!! NOW!! CHEAP!!\n$$$ ### win%%% big&&& ### $$$\n"


def small_model():
    return train([(1, GOOD * k) for k in range(1, 12)] + [(0, BAD * k) for k in range(1, 12)], steps=40)


def test_statistics_of_lines():
    stats, size, lines = line_stats(["ab CD\n\n12 12 12", "", "ab CD\nab CD"])
    assert lines.tolist() == [3, 1, 2] and size.tolist() == [5, 0, 8, 0, 5, 5]
    assert np.isclose(stats[0, 1], 0.8) and np.isclose(stats[0, 2], 0.5) and stats[2, 3] == 0.75
    assert np.isclose(stats[2, 8], 2 / 3) and np.isclose(stats[2, 9], 1 / 3)
    assert stats[:, 10].tolist() == [1, 1, 1, 1, 2, 2] and stats[:, 12].tolist() == [2, 0, 3, 0, 2, 2]


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op10_crf_quality(spark, sf).collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert set(rows) == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    held = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    right = [rows[r.doc_id].predicted == r.quality for r in held]
    assert np.mean(right) > 0.93
    assert np.mean([rows[r.doc_id].predicted == 0 for r in held if r.quality == 0]) > 0.7


def test_neighbours_lines_and_odd_rows(spark):
    model = small_model()
    data = [(1, GOOD * 3, 9.0), (2, BAD * 3, 9.0), (3, None, 9.0), (4, "", 9.0), (None, GOOD, 9.0), (5, BAD * 3000, 9.0), (5, BAD * 3000, 9.0)]
    df = spark.createDataFrame(data, "doc_id long, text string, score double")
    out = score_documents(df, model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 7 and by[1].score > 0.8 > 0.2 > by[2].score and by[5].score < 0.2
    assert by[3].score == by[4].score and by[3].n_lines == 1
    mixed = spark.createDataFrame([(1, GOOD * 4 + BAD * 4)], "doc_id long, text string")
    good = [r.good for r in sorted(label_lines(mixed, model).collect(), key=lambda r: r.line)]
    assert min(good[:7]) > 0.5 > max(good[9:15])
    assert score_documents(df.limit(0), model).count() == 0


def test_without_both_labels():
    assert np.allclose(train([]).score(["a", ""]), 0.5)
    assert (train([(1, "a")] * 50).score(["x"]) > 0.9).all()


def test_sample_of_long_texts_is_bounded(spark):
    ids = spark.range(30).withColumnRenamed("id", "doc_id")
    docs = ids.selectExpr("doc_id", "repeat('long text ', 100000 + cast(doc_id AS int)) AS text").unionByName(spark.createDataFrame([(90, "short"), (91, None)], "doc_id long, text string"))
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality")
    rows = sample(docs, labels)
    lengths = [len(t) for _, t in rows]
    assert sum(lengths) <= 16_000_000 and max(lengths) >= 1_000_000 and {y for y, _ in rows} == {0, 1}
    # whole texts with their labels
    assert all(t in ("", "short") or (t == "long text " * (len(t) // 10) and y == (len(t) // 10) % 2) for y, t in rows)
    assert len(sample(docs, labels, chars=40_000_000)) == 32
