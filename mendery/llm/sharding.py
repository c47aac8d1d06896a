"""Hierarchical weighted hash tree: rows to shards under regions and racks.

A key descends region, rack and shard levels. At each level every child makes a
draw -ln(u) / weight, with u hashed from the key and the child's path, and the
smallest draw wins; a child so gets a share in proportion to its weight, and a
key's draws in one subtree never depend on another. A shard added later is a
growth event: it makes one more draw at the region level, for the weight that
its region gained. A key that this draw wins goes straight down to the new
shard; all other keys keep their path, because none of their draws changed.
So one more shard takes rows only into itself, at a cost for each row of
regions + events + racks of one region + shards of one rack.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mendery.llm.common import read


@dataclass(frozen=True)
class Leaf:
    """One shard, its place and its weight."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class HashTree:
    """`base` leaves are there from the start; `grown` joined later, in this order."""

    base: tuple[Leaf, ...]
    grown: tuple[Leaf, ...] = ()

    @classmethod
    def even(cls, shards: int, regions: int = 2, racks: int = 3) -> HashTree:
        """`shards` equal shards dealt over regions of racks."""
        return cls(tuple(Leaf(i % regions, i // regions % racks, i) for i in range(shards)))

    def grow(self, shard: int, region: int = 0, rack: int = 0, weight: float = 1.0) -> HashTree:
        return replace(self, grown=(*self.grown, Leaf(region, rack, shard, weight)))

    def place(self, key: Column) -> Column:
        """The shard of `key`, as a native expression."""
        regions: dict[int, dict[int, list[Leaf]]] = {}
        for x in self.base:
            regions.setdefault(x.region, {}).setdefault(x.rack, []).append(x)

        def draw(path: str, weight: float) -> Column:
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
            return -F.log(u) / F.lit(float(weight))

        def lowest(options: list[tuple[str, float, int]]) -> Column:
            if len(options) == 1:
                return F.lit(options[0][2])
            return F.array_min(F.array(*[F.struct(draw(p, w).alias("d"), F.lit(i).alias("i")) for p, w, i in options]))["i"]

        def chosen(at: Column, of: dict[int, Column]) -> Column:
            # through an array, so that `at` is computed once
            def pick(c: Column) -> Column:
                out = None
                for i, way in of.items():
                    out = F.when(c == i, way) if out is None else out.when(c == i, way)
                return out

            return F.transform(F.array(at), pick)[0]

        weigh = lambda leaves: sum(x.weight for x in leaves)
        top = [(f"r{r}", weigh([x for rack in racks.values() for x in rack]), r) for r, racks in regions.items()]
        top += [(f"r{x.region}+{i}", x.weight, -1 - i) for i, x in enumerate(self.grown)]
        down = {}
        for r, racks in regions.items():
            shards = {k: lowest([(f"r{r}k{k}s{x.shard}", x.weight, x.shard) for x in leaves]) for k, leaves in racks.items()}
            at = lowest([(f"r{r}k{k}", weigh(leaves), k) for k, leaves in racks.items()])
            down[r] = chosen(at, shards)
        down |= {-1 - i: F.lit(x.shard) for i, x in enumerate(self.grown)}
        return chosen(lowest(top), down).cast("int")


def shard_rows(df: DataFrame, tree: HashTree, grown: HashTree | None = None, key: str = "doc_id", text: str = "text", slot_buckets: int = 1024) -> DataFrame:
    """One row per row of `df`: key, size, text_crc32, law, shard, slot, grown_shard.

    Law `key`: the key and the tree decide, so equal texts under two keys may part
    and repeated keys stay together. A null key is a key of its own. A null text
    has size 8 and the checksum of the empty text; an empty table gives no rows.
    Other columns of `df` play no part, whatever their names.

    Slots are numbered within `slot_buckets` hash buckets of each shard, then
    shifted by the sums of the buckets before: no task ever holds a shard. Equal
    rows are counted before the shuffle and numbered together, so a repeated row
    is never a hot group.
    """
    own = df.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = own.groupBy("doc_id", "bytes", "text_crc32").agg(F.count("*").alias("n"))
    k = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0"))
    rows = rows.withColumns({"shard": tree.place(k), "grown_shard": grown.place(k) if grown else F.lit(None).cast("int"), "bucket": F.pmod(F.xxhash64("doc_id", "bytes", "text_crc32"), F.lit(slot_buckets)).cast("int")})
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("m")).select("shard", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("shard", "bucket").orderBy("doc_id", "bytes", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    first = rows.withColumn("skip", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, ["shard", "bucket"])
    out = first.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return out.select("doc_id", (F.col("bytes") + 8).alias("size"), "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("skip") + F.col("i")).alias("slot"), "grown_shard")


def op5_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards; grown_shard is the place with one shard more."""
    tree = HashTree.even(24)
    return shard_rows(read(spark, sf_dir, "documents"), tree, tree.grow(24))
