"""Connected components of a distributed edge table by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendery.llm.common import cut


def connected(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, label) of every node of `edges` (columns u and v, long): label is the smallest node of its component.

    Large and small stars in turn until nothing changes; each round is stored in
    the shared checkpoint folder. Rows stay distributed: the driver sees a
    checksum for each round. With `most_rounds`, edges that haven't settled by then
    are an error, as their labels would be unfinished.
    """

    def state(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = state(e)
    rounds = 0
    while seen[0]:
        if rounds == most_rounds:
            raise RuntimeError(f"stars haven't settled in {most_rounds} rounds")
        rounds += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        e = cut(small.filter("u <> v").distinct())
        now = state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def at_once(edges: DataFrame) -> DataFrame:
    """What connected() gives, by one task that holds all of `edges`: for a bounded number of them."""

    def run(batches):
        import pyarrow as pa

        held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if held:
            nodes, back = np.unique(np.concatenate([x for pair in zip(*held, strict=True) for x in pair]), return_inverse=True)
            u, v = back.reshape(2, -1)
            root = np.arange(len(nodes))  # of each node one in its component that isn't larger
            while (root[u] != root[v]).any():
                a, b = root[u], root[v]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (root[root] != root).any():
                    root = root[root]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "label"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, label long")


def _labels(edges: DataFrame, most: int) -> DataFrame:
    edges = cut(edges.filter("u <> v").select("u", "v").distinct())
    return cut(at_once(edges) if edges.count() <= most else connected(edges))


def joined(labels: DataFrame | None, edges: DataFrame, most: int = 500_000) -> DataFrame:
    """The labels of connected() after further edges: only edges between components so far are new to it; up to `most` of them take one task."""
    if labels is None:
        return _labels(edges, most)
    of = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"l{s}"))
    between = edges.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
    new = _labels(between, most)
    moved = labels.join(new.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return cut(moved.unionByName(new.join(labels, "node", "left_anti")))
