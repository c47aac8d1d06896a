"""Chunks in any order, over several batches, give the texts that a batch would."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from mendery import types as t
from mendery.streaming import accumulate, decode_stream


def test_chunks_over_batches(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    text = {"a": '{"id": 1, "tags": ["x", "y"]}', "b": "{id: 2, tags: [p, q"}
    batches = [[("a", 1, text["a"][10:20], False), ("b", 0, text["b"][:8], False)], [("a", 0, text["a"][:10], False), ("b", 1, text["b"][8:], False)], [("a", 2, text["a"][20:], True)], [("z", 0, "{}", True, 60)], [("z", 1, "", True, 61)]]
    schema = "key string, seq long, chunk string, last boolean, ts timestamp"
    for i, rows in enumerate(batches):
        data = [(k, s, c, f, base + dt.timedelta(minutes=(m[0] if m else i))) for k, s, c, f, *m in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    spec = t.struct(id=t.number, tags=t.array(t.string))
    out = decode_stream(stream, spec, "key", "seq", "chunk", "last", idle="5 minutes")
    q = out.writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("chunks").select("key", "final", F.col("parsed.value").alias("v")).collect()
    final = {r.key: r.v for r in rows if r.final}
    assert final["a"] == (1.0, ["x", "y"])
    growing = [r.v for r in rows if r.key == "b" and not r.final and r.v]
    assert growing and growing[-1] == (2.0, ["p", "q"])


def test_long_texts_are_whole_or_fail(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    schema = "key string, seq long, chunk string, last boolean, ts timestamp"
    data = [("a", 0, "x" * 700_000, False, base), ("a", 1, "y" * 700_001, True, base), ("b", 0, "short", True, base)]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(name, **limit):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
        q = accumulate(stream, "key", "seq", "chunk", "last", **limit).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return {r.key: r.text for r in spark.table(name).filter("final").collect()}

    assert run("unlimited") == {"a": "x" * 700_000 + "y" * 700_001, "b": "short"}
    with pytest.raises(StreamingQueryException, match="max_chars"):
        run("limited", max_chars=1_000_000)
