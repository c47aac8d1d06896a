"""Homomorphic multiset hash of a text's paragraphs.

A paragraph (line) hashes to a wide vector: four dense lanes of 64 bits, and one
of 256 sparse lanes of 16 bits at each level that takes it. Level 0 takes every
paragraph, level j one in 4^j by its hash. A fingerprint is the sum of its paragraphs'
vectors, modulo 2^64 and 2^16, and their number. Sums don't depend on order, so
texts with the same paragraphs have the same fingerprint; a paragraph is
inserted or deleted by adding or subtracting its vector, and the fingerprint of
two texts put together is the sum of theirs. Dense lanes tell equality; each
paragraph that only one of two texts has changes one sparse lane of a level, so
the number of unequal lanes estimates how many paragraphs differ. It is read from
the first level with at most `FULL` unequal lanes: with 12 levels, up to some
10^9 differing paragraphs.
"""

from __future__ import annotations

import hashlib
import math
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery.llm.common import arrow_rows, read

DENSE, SPARSE, LEVELS = 4, 256, 12
#: With more unequal lanes than this (about four differing paragraphs a lane) the next level tells more.
FULL = 251


class MultisetHash:
    """A fingerprint that paragraphs can be added to and taken from."""

    __slots__ = ("count", "dense", "sparse")

    def __init__(self, text: str | None = None):
        self.dense = np.zeros(DENSE, np.uint64)
        self.sparse = np.zeros((LEVELS, SPARSE), np.uint16)
        self.count = 0
        if text is not None:
            self.update(text.split("\n"))

    def update(self, paragraphs: list[str], sign: int = 1) -> MultisetHash:
        """Insert paragraphs, or delete them with sign -1."""
        digests = b"".join([hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8 * DENSE + 8).digest() for p in paragraphs])
        v = np.frombuffer(digests, np.uint64).reshape(-1, DENSE + 1)
        dense = v[:, :DENSE].sum(axis=0, dtype=np.uint64)
        self.dense = self.dense + dense if sign > 0 else self.dense - dense
        x = v[:, DENSE]
        for level in range(LEVELS):
            # bits 0 to 7 are the lane, two of bits 8 to 29 for each level, bits 32 to 47 the value
            x = x[(x >> np.uint64(8)) & np.uint64(4**level - 1) == 0] if level else x
            if not len(x):
                break
            lanes = np.bincount((x % np.uint64(SPARSE)).astype(np.int64), ((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64) | 1, SPARSE)
            sparse = (lanes.astype(np.int64) & 0xFFFF).astype(np.uint16)
            self.sparse[level] = self.sparse[level] + sparse if sign > 0 else self.sparse[level] - sparse
        self.count += sign * len(paragraphs)
        return self

    def __add__(self, other: MultisetHash) -> MultisetHash:
        out = MultisetHash()
        out.dense, out.sparse, out.count = self.dense + other.dense, self.sparse + other.sparse, self.count + other.count
        return out

    def __eq__(self, other: object) -> bool:
        return isinstance(other, MultisetHash) and self.hex() == other.hex()

    __hash__ = None

    def hex(self) -> str:
        """Count, dense lanes, level 0, and eight digits for each lane of the other levels that is not 0: level, lane, value."""
        above = self.sparse[1:].ravel()
        at = np.flatnonzero(above)
        more = ((at + SPARSE) << 16 | above[at]).astype(">u4")
        return f"{self.count:08x}" + self.dense.astype(">u8").tobytes().hex() + self.sparse[0].astype(">u2").tobytes().hex() + more.tobytes().hex()

    def likeness(self, other: MultisetHash) -> float:
        """1 less the estimated share of paragraphs that only one side has (Dice); 1 if the fingerprints are equal."""
        if self.count == other.count and (self.dense == other.dense).all():
            return 1.0
        for level in range(LEVELS):
            unequal = int((self.sparse[level] != other.sparse[level]).sum())
            if unequal <= FULL:
                break
        else:
            return 0.0
        differ = max(4**level * math.log1p(-unequal / SPARSE) / math.log1p(-1 / SPARSE), 1.0, abs(self.count - other.count))
        return max(0.0, 1.0 - differ / (self.count + other.count))


def edited(text: str, following: str) -> str:
    """`text` with its last third replaced by the start of `following`."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _sweep(batches):
    """Rows in order (bucket, borrowed, ...): each own row with the row after it."""
    import pyarrow as pa

    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, _SCHEMA.split(", "), strict=True)])
    held, out = None, []
    for bucket, borrowed, doc_id, text in arrow_rows(batches, "bucket", "borrowed", "doc_id", "text"):
        if borrowed and (held is None or held[0] != bucket):
            continue  # only the first borrowed row of a bucket counts
        fp = MultisetHash(text)
        if held is not None:
            _, at, before, own = held
            changed = edited(before, text)
            new = MultisetHash(changed)
            out.append((at, len(before), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.hex(), new.hex(), own.likeness(new), own.likeness(fp)))
        held = None if borrowed else (bucket, doc_id, text, fp)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def fingerprints(df: DataFrame, per_partition: int = 4) -> DataFrame:
    """Fingerprint of each text and of its edited text, whose last third comes from the next document.

    Next means next in descending doc_id (null last; equal ids by their text's
    hash), and after the last the first; a lone row is its own next. Null texts
    are empty. An empty table gives no rows. Other columns play no part.

    Texts are dealt once, into ranges of doc_id, and streamed in order. The last
    row of a range needs the first of the next: the largest doc_id of each range
    is found beforehand from the ids alone (a row for each range), and that
    document is sent to both ranges.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select("doc_id", "text").withColumn("k", F.coalesce(F.col("doc_id"), F.lit(-(2**63))))
    n = parts * per_partition
    cuts = sorted({int(x) for x in rows.select(F.col("k").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n)})
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("k") <= c)) if cuts else F.lit(0)
    rows = rows.withColumn("at", place)
    tops = sorted((r["at"], r["top"]) for r in rows.groupBy("at").agg(F.max("k").alias("top")).collect())
    if not tops:
        return spark.createDataFrame([], _SCHEMA)
    # range -> its largest id and the range before it, which borrows that row
    before = {b[0]: a[0] for a, b in pairwise([*tops, tops[0]])}
    top = F.create_map(*[F.lit(x) for t in tops for x in t])
    lender = F.create_map(*[F.lit(x) for t in before.items() for x in t])
    own = F.struct(F.col("at").alias("bucket"), F.lit(False).alias("borrowed"))
    lent = F.struct(lender[F.col("at")].alias("bucket"), F.lit(True).alias("borrowed"))
    to = F.when(top[F.col("at")] == F.col("k"), F.array(own, lent)).otherwise(F.array(own))
    dealt = rows.select(F.explode(to).alias("to"), "k", "doc_id", "text").select("to.bucket", "to.borrowed", "k", "doc_id", "text")
    ordered = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "borrowed", F.desc("k"), F.xxhash64("text"))
    return ordered.select("bucket", "borrowed", "doc_id", "text").mapInArrow(_sweep, _SCHEMA)


def op6_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness."""
    return fingerprints(read(spark, sf_dir, "documents"))
