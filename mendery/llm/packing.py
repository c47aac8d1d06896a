"""Best-fit packing of documents into token sequences, in bulk-synchronous rounds.

Documents are encoded, end with a given id, and are cut only if longer than a
sequence. Pieces longer than half a sequence can't share one with each other, so
each opens its own. The others go by classes of size, the longest first. A round:

1. The pieces left of the class and the gaps are range-sorted by falling size.
2. Each range is swept for successors: a stack holds the gaps seen so far, the
   smallest on top, and a piece takes the top one, which is its best fit. A gap
   that surely holds several pieces of the class is offered as many times.
3. Pieces that a range has no gap for and gaps it has over are numbered by rank.
   A sweep over the ranges (two counts each) assigns runs of ranks to the
   nearest range before with gaps over, and the i-th piece of a run gets its i-th
   place, so no two ever get the same. Pieces and gaps of a run meet by blocks of
   places, sorted by place.
4. Gaps shrink by what they take as they take it, and empty sequences are opened
   for the least number that the pieces left need. The next round follows until
   none is left.

A round is two sorts with a pass of Python over each, without joins or
aggregations: what a round costs the driver are its plans, whatever its rows.
Pieces left, gaps and placed pieces of a round are one stored table. Its ranges
and blocks have as many partitions as its rows need, so that a round over few rows
doesn't pay for the partitions of one over all; no rows of pieces or gaps go to the
driver.

The rounds give the number of sequences of best-fit decreasing or very nearly it,
however the ranges are cut. Their number depends on the classes, about two to
four for each, not on the number of documents.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery.llm.common import arrow_rows, batches_of, cut, read, release, text_batches

#: Classes of size end at the capacity divided by these.
CLASSES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512)
#: Rows that a partition of a round holds, as far as spark.sql.shuffle.partitions allows that many.
ROWS = 50_000
#: Places of a range's gaps that are filled together: a multiple of what empty sequences of 1024 offer to each class.
BLOCK = 6144
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, chars: int = 1_000_000) -> DataFrame:
    """Pieces of every whole text: doc_id, piece, start, length, ids_crc32.

    A null text is empty and so has the end id alone. A longer document than
    `capacity` has its first piece shorter and the rest full.
    """

    def run(batches):
        import pyarrow as pa

        from mendery.llm.bpe import encoder

        enc = encoder(path)
        for held in batches_of(arrow_rows(batches, "doc_id", "text"), chars):
            ids, counts = enc.encode_special([x[1] for x in held])
            ids = np.insert(ids.astype("<u4"), np.cumsum(counts), end_id)
            at, out = 0, []
            for (doc_id, _), n in zip(held, (counts + 1).tolist(), strict=True):
                first = (n - 1) % capacity + 1
                bounds = [0, *range(first, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    out.append((doc_id, i, a, b - a, zlib.crc32(ids[at + a : at + b].tobytes())))
                at += n
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_batches(df).select("doc_id", "text").mapInArrow(run, PIECES)


def classes(capacity: int) -> list[tuple[int, int]]:
    """Sizes above the first and up to the second number, the largest class first."""
    ends = sorted({capacity // d for d in CLASSES if d <= capacity} | {0}, reverse=True)
    return list(zip(ends[1:], ends, strict=False))


#: kind 0: a gap (key: its sequence), 1: a piece left (key: its number), 2: a piece placed in `seq` at `at`.
STATE = "kind int, key long, size long, seq long, at long"
#: Kind 3 counts a range's pieces without a gap (rank) and its places left over (n).
SWEPT = f"{STATE}, part int, rank long, n long"
DEALT = f"{STATE}, of int, pos long, block long"


def _batch(rows: list[tuple], schema: str):
    import pyarrow as pa

    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = [pa.int32() if k == "int" else pa.int64() for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=list(names))


def _sweep(lo: int, hi: int, pieces: int, capacity: int):
    """Step 2 over one range, for pieces of sizes lo + 1 to hi: rows of SWEPT.

    Gaps left over have the rank of their first place and how many they offer, the
    smallest first, as far as all `pieces` of the round could take them. No gap's
    places are in two blocks.
    """

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        stack: list[list[int]] = []
        alone = 0
        for b in batches:
            rows = []
            for size, kind, key in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == 0:
                    if size > lo:
                        stack.append([key, size, max(1, size // hi)])
                    else:
                        rows.append((0, key, size, None, None, part, None, None))
                elif stack:
                    top = stack[-1]
                    rows.append((2, key, size, top[0], capacity - top[1], part, None, None))
                    top[1] -= size
                    top[2] -= 1
                    if not top[2]:
                        stack.pop()
                        if top[1]:
                            rows.append((0, top[0], top[1], None, None, part, None, None))
                else:
                    rows.append((1, key, size, None, None, part, alone, 1))
                    alone += 1
            if rows:
                yield _batch(rows, SWEPT)
        rank, rows = 0, []
        while stack:
            seq, gap, n = stack.pop()
            if rank < pieces:
                n = min(n, BLOCK - rank % BLOCK)
                rows.append((0, seq, gap, None, None, part, rank, n))
                rank += n
            else:
                rows.append((0, seq, gap, None, None, part, None, None))
            if len(rows) == 10_000:
                yield _batch(rows, SWEPT)
                rows = []
        yield _batch([*rows, (3, None, None, None, None, part, alone, rank)], SWEPT)

    return run


def _deal(runs: list[tuple[int, int, int, int, int]]):
    """Step 3, rows of SWEPT to those of DEALT: pieces and gaps of a run get their range and place, all others the range -1."""
    own: dict[int, np.ndarray] = {p: np.array([r[1:] for r in runs if r[0] == p]) for p in {r[0] for r in runs}}
    used: dict[int, int] = {}
    for _, lo, hi, of, first in runs:
        used[of] = max(used.get(of, 0), first + hi - lo)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            b = b.filter(pa.array(b.column(0).to_numpy() < 3))
            if not b.num_rows:
                continue
            kind, key, part = (b.column(i).to_numpy() for i in (0, 1, 5))
            rank = b.column(6).fill_null(-1).to_numpy()
            of, pos = np.full(len(kind), -1), np.zeros(len(kind), np.int64)
            for p in set(part.tolist()):
                if p in used:
                    i = (part == p) & (kind == 0) & (rank >= 0) & (rank < used[p])
                    of[i], pos[i] = p, rank[i]
                if p in own:
                    i = np.flatnonzero((part == p) & (kind == 1))
                    at = own[p][np.searchsorted(own[p][:, 0], rank[i], "right") - 1]
                    i, at = i[rank[i] < at[:, 1]], at[rank[i] < at[:, 1]]
                    of[i], pos[i] = at[:, 2], at[:, 3] + rank[i] - at[:, 0]
            block = np.where(of < 0, key, pos // BLOCK)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(of, pa.int32()), pa.array(pos), pa.array(block)], names=[x.split()[0] for x in DEALT.split(", ")])

    return run


def _fill(capacity: int):
    """Steps 3 and 4 over blocks of places, rows of DEALT by range, place and kind: pieces go into the gap that has their place."""

    def run(batches):
        import pyarrow as pa

        of, seq, gap = None, None, 0
        for b in batches:
            apart = b.column(5).to_numpy() < 0
            if apart.any():
                yield b.filter(pa.array(apart)).select(list(range(5)))
            rows = []
            some = b.filter(pa.array(~apart))
            for kind, key, size, at in zip(*(some.column(i).to_pylist() for i in (0, 1, 2, 5)), strict=True):
                if kind == 0:
                    if gap:
                        rows.append((0, seq, gap, None, None))
                    of, seq, gap = at, key, size
                else:
                    if at != of or size > gap:
                        raise AssertionError("a piece without its gap")
                    rows.append((2, key, size, seq, capacity - gap))
                    gap -= size
            if rows:
                yield _batch(rows, STATE)
        if gap:
            yield _batch([(0, seq, gap, None, None)], STATE)

    return run


def spread(spark: SparkSession, rows: int) -> int:
    """Partitions for a round of this many rows: two at least, so that ranges and keys are split at every size."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2, -(-rows // ROWS))))


def carry(ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Step 3: runs (part, lo, hi, of, first), the pieces of `part` ranked lo..hi-1 get the gaps of `of` from rank `first`.

    `ranges` has the pieces without a gap and the gaps left over of each range, by falling size.
    """
    stack: list[list[int]] = []
    runs = []
    for part, pieces, gaps in sorted(ranges):
        lo = 0
        while lo < pieces and stack:
            of, first, n = stack[-1]
            m = min(n, pieces - lo)
            runs.append((part, lo, lo + m, of, first))
            lo += m
            if m == n:
                stack.pop()
            else:
                stack[-1] = [of, first + m, n - m]
        if gaps:
            stack.append([part, 0, gaps])
    return runs


def match(state: DataFrame, lo: int, hi: int, pieces: int, capacity: int, parts: int) -> tuple[DataFrame, int]:
    """One round over gaps and `pieces` pieces of sizes lo + 1 to hi (kind, key, size): its state, and how many pieces are left.

    `parts` is the number of ranges.
    """
    order = (F.desc("size"), F.asc("kind"), F.asc("key"))
    swept = cut(state.select("size", "kind", "key").repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_sweep(lo, hi, pieces, capacity), SWEPT))
    # one row of each range
    ranges = [tuple(r) for r in swept.filter("kind = 3").select("part", "rank", "n").collect()]
    runs = carry(ranges)
    rest = sum(r[1] for r in ranges) - sum(hi_ - lo_ for _, lo_, hi_, _, _ in runs)
    # two numbers a range make at most two runs a range
    dealt = swept.mapInArrow(_deal(runs), DEALT).repartition(parts, "of", "block").sortWithinPartitions("of", "pos", "kind")
    return cut(dealt.mapInArrow(_fill(capacity), STATE)), rest


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """`pieces` with sequence_id and offset; pieces needs a column length (1..capacity).

    Equally long pieces are told apart by a number that each stored row gets, so
    one size may hold any share of the rows, and repeated rows are pieces like
    others. An empty table packs into nothing.
    """
    spark = pieces.sparkSession
    rows = cut(pieces.withColumn("_u", F.monotonically_increasing_id()))
    (half, _), *smaller = classes(capacity)
    size = F.col("length").cast("long")
    sums = [f(F.when((size > lo) & (size <= hi), size)) for lo, hi in smaller for f in (F.count, F.sum)]
    large, *totals = rows.agg(F.count(F.when((size > half) & (size < capacity), 1)), *sums).first()
    small = rows.coalesce(spread(spark, large + sum(totals[::2])))
    state = small.filter((size > half) & (size < capacity)).select(F.lit(0).alias("kind"), F.col("_u").alias("key"), (capacity - size).alias("size"))
    placed, opened = [], 0
    for i, (lo, hi) in enumerate(smaller):
        n, total = totals[2 * i], totals[2 * i + 1]
        more = small.filter((size > lo) & (size <= hi)).select(F.lit(1), "_u", size)
        again = False
        while n:
            if again:
                # the least that the pieces left need; those they leave are there for the next classes
                need = max(-(-total // capacity), -(-n // (capacity // (lo + 1))))
                more = spark.range(opened, opened + need, 1, spread(spark, need)).select(F.lit(0), -1 - F.col("id"), F.lit(capacity).cast("long"))
                opened += need
            again = True
            state, n = match(state.filter("kind < 2").select("kind", "key", "size").unionAll(more), lo, hi, n, capacity, spread(spark, n + large + opened))
            placed.append(state.filter("kind = 2").select(F.col("key").alias("_u"), F.col("seq").alias("sequence_id"), F.col("at").alias("offset")))
            if n:
                total = state.filter("kind = 1").agg(F.sum("size")).first()[0]
        # plans and shuffles of the class's rounds would fill the driver's heap
        release(spark)
    out = rows.filter(size > half).select(*pieces.columns, F.col("_u").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if placed:
        found = placed[0]
        for p in placed[1:]:
            found = found.unionAll(p)
        out = out.unionAll(rows.filter(size <= half).join(found, "_u").select(*pieces.columns, "sequence_id", "offset"))
    return out


def op3_best_fit_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    # the ranks file has the vocabulary of byte_bpe_50k.json
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return pack(token_pieces(read(spark, sf_dir, "documents"), path))
