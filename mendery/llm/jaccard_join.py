"""Exact n-gram Jaccard join by a token-group matrix.

Texts become sets of hashed word shingles; texts with the same set are one node.
Nodes with the same three smallest hashes, which alike sets mostly share, form a
group; large ones are split into groups of bounded size. The matrix holds each group's
token union. Two bounds on the overlap of two groups' members decide whether a
group is opened for another:

- The matrix rows are the tokens of each member's prefix, in an order with the
  corpus' frequent tokens last. Members that link share at least
  l = 1 + size / 100 tokens of prefixes of (size - least overlap + l), so groups
  that share fewer cannot link. The smaller one of a pair must overlap by more,
  which makes its prefix shorter: these first tokens are the leading ones.
- Each group stores its union as counts by ranges of the hash, one or two for
  each token (the largest count of its members). The sum of the lesser counts
  bounds any overlap.
- Each group stores which of 512 ranges of the hash hold an odd number of tokens in
  all its members, and which an even number in all. Sets differ by a token at least
  in each range that is odd in one and even in the other.

Opened groups' members are compared exactly. Only connections matter for
components: first each group is compared with one group that may link and, by its
frequent matrix tokens, with a few groups of like size at random, twice, and with
hubs: the groups that have the fewest infrequent tokens, so the least edited ones.
This joins large groups of copies. Then all groups that share enough and whose
members are not yet in one component are compared. Every pair of nodes that links
is so either compared or already connected. Postings of frequent tokens are joined
between components first, then between the nodes themselves, each time under the
bounds of size and of odd ranges: a node's ranges are all known, so that edited
copies which are too far apart make no rows, whatever else is in their groups.

Sets are made anew from the texts where they are needed (two scans) instead of
being stored: shuffles carry prefixes and counts, and the compressed texts of
groups that are opened, which are a third of their sets' size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mendery.llm.common import arrow_rows, batches_of, cut, read, release, small_batches, trimmed
from mendery.llm.components import joined
from mendery.llm.textvec import Texts, mix

FEWEST, MOST = 6, 15
WORDS = 8
CHARS, MOST_KNOWN = 1_000_000, 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for hashes a sort is faster than numpy's table."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles as 64-bit hashes; with fewer words the whole sequence is one; without words none."""
    if not texts:
        return []
    t = Texts(texts)
    begin, end, of = t.words(lower=True)
    h = t.hashes(begin, end) if len(begin) else np.empty(0, np.uint64)
    n = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n) - n
    m = max(0, len(h) - k + 1)
    s = mix(h[:m] + np.uint64(k))
    for j in range(1, k):
        s = mix(s * _STEP + h[j : j + m])
    out = []
    for a, c in zip(first.tolist(), n.tolist(), strict=True):
        if c >= k:
            out.append(distinct(s[a : a + c - k + 1]))
        else:
            x = mix(h[a : a + 1] + np.uint64(c))
            for j in range(1, c):
                x = mix(x * _STEP + h[a + j : a + j + 1])
            out.append(x[: min(c, 1)])
    return out


def node_of(s: np.ndarray) -> int:
    """A 64-bit name for a set."""
    with np.errstate(over="ignore"):
        return int(mix(mix(s ^ _STEP).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0].astype(np.int64))


def _sets(batches, k: int, *names: str):
    """Batches of (values of the named columns, set) of each text."""
    for held in batches_of(arrow_rows(batches, *names, "text"), CHARS):
        yield list(zip([x[:-1] for x in held], shingle_sets([x[-1] for x in held], k), strict=True))


def _frequent(df: DataFrame, k: int, percent: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash keys (sorted) and document counts of the tokens in at least `least` documents; of more than `most` the most frequent.

    They only order tokens, so that long postings are rare; any order gives the
    same links. All documents are counted: each task counts its tokens and sends
    them as sorted arrays by ranges of the hash. A prefix starts with the smallest
    hashes of its set, so about twice as many of these are counted as it has.
    """
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @trimmed
    def local(batches):
        import pyarrow as pa

        def out(held):
            keys, n = np.unique(short_keys(np.concatenate(held), parts), return_counts=True)
            cuts = np.searchsorted(keys >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
            low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            full = [i for i in range(parts) if cuts[i + 1] > cuts[i]]
            return pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([_packed(low[cuts[i] : cuts[i + 1]]) for i in full]), pa.array([np.minimum(n[cuts[i] : cuts[i + 1]], 255).astype(np.uint8).tobytes() for i in full])],
                names=["range", "keys", "counts"],
            )

        held, size = [], 0
        for sets in _sets(batches, k):
            low = [s[: 2 * (len(s) - least_overlap(len(s), percent) + slack(len(s))) + 8] for _, s in sets]
            held += low
            size += sum(map(len, low))
            if size > 2_000_000:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    @trimmed
    def merge(batches):
        import pyarrow as pa

        def out(at, keys, counts):
            keys, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(back, np.concatenate(counts)).astype(np.int64)
            some = n >= least
            return pa.RecordBatch.from_arrays([pa.array((np.uint64(at) << np.uint64(32) | keys[some]).astype(np.int64)), pa.array(n[some])], names=["key", "n"])

        at, keys, counts = None, [], []
        for b in batches:
            for r, kb, cb in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r != at and keys:
                    yield out(at, keys, counts)
                    keys, counts = [], []
                at = r
                keys.append(_unpacked(kb).astype(np.uint64))
                counts.append(np.frombuffer(cb, np.uint8))
        if keys:
            yield out(at, keys, counts)

    counted = df.mapInArrow(local, "range int, keys binary, counts binary").repartition(parts // 4, "range").sortWithinPartitions("range").mapInArrow(merge, "key long, n long")
    rows = counted.orderBy(F.desc("n"), "key").limit(most).toPandas()
    order = np.argsort(rows["key"].to_numpy(np.int64).astype(np.uint64), kind="stable")
    return rows["key"].to_numpy(np.int64).astype(np.uint64)[order], rows["n"].to_numpy(np.int64)[order]


def short_keys(s: np.ndarray, parts: int) -> np.ndarray:
    """The hash range (of `parts`) and the lower half of each hash."""
    return ((((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)) << np.uint64(32)) | (s & np.uint64(0xFFFFFFFF))


def _packed(low: np.ndarray) -> bytes:
    """Sorted uint32 keys as differences, their bytes by place: the upper ones are mostly zero and compress."""
    return np.diff(low, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32)


def frequency(s: np.ndarray, keys: np.ndarray, counts: np.ndarray, parts: int) -> np.ndarray:
    """Counts of the frequent tokens of a set, 0 for others."""
    if not len(keys):
        return np.zeros(len(s), np.int64)
    own = short_keys(s, parts)
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return np.where(keys[at] == own, counts[at], 0)


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n must share with any set that it links with."""
    return -(-percent * n // 100)


def slack(n: int) -> int:
    return 1 + n // 100


def prefix(s: np.ndarray, freq: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a set in the global order (infrequent by hash, then by count and hash)."""
    n = len(s)
    p = min(n, n - least_overlap(n, percent) + slack(n))
    light = s[freq == 0]
    if len(light) >= p:
        return light[:p]
    heavy = freq > 0
    order = np.lexsort((s[heavy], freq[heavy]))
    return np.concatenate((light, s[heavy][order][: p - len(light)]))


def leading(n: int, percent: int) -> int:
    """How many tokens of its prefix a set of n needs against sets of its size or larger."""
    return min(n, n - -(-2 * percent * n // (100 + percent)) + slack(n))


def lowest(s: np.ndarray) -> int:
    """A name for the three smallest hashes of a set."""
    return int(mix(mix(s[:1] + s[:3][-1:] * _STEP) + s[:2][-1:])[0].astype(np.int64))


def sketch(s: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes by 2^6 to 2^15 equal ranges, one or two for each token."""
    bits = min(MOST, max(FEWEST, len(s).bit_length()))
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def stored(counts: np.ndarray) -> bytes:
    """Counts below 16 as half bytes, others as whole ones of the width they need; the first byte tells which."""
    most = int(counts.max())
    if most < 16:
        x = counts.astype(np.uint8)
        return b"\0" + (x[::2] | x[1::2] << 4).tobytes()
    width = 1 if most < 2**8 else 2 if most < 2**16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def loaded(b: bytes) -> np.ndarray:
    if b[0]:
        return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int32)
    x = np.frombuffer(b, np.uint8, offset=1)
    out = np.empty(2 * len(x), np.int32)
    out[::2], out[1::2] = x & 15, x >> 4
    return out


def parities(s: np.ndarray) -> np.ndarray:
    """One bit for each of 512 hash ranges, in 8 words: whether it holds an odd number of the set's hashes."""
    return np.packbits((np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=64 * WORDS) & 1).astype(np.uint8)).view(np.int64)


def agreed(sets: list[np.ndarray]) -> np.ndarray:
    """The ranges that are odd in all of some sets' parities (8 words), and those that are even in all."""
    x = np.stack(sets)
    return np.concatenate((np.bitwise_and.reduce(x), np.bitwise_and.reduce(~x)))


def folded(counts: np.ndarray, n: int) -> np.ndarray:
    """The counts by fewer ranges."""
    return counts.reshape(n, -1).sum(axis=1) if len(counts) > n else counts


def merged(sketches: list[np.ndarray]) -> np.ndarray:
    """For each range the largest count, by as many ranges as the coarsest has."""
    n = min(map(len, sketches))
    return np.max([folded(s, n) for s in sketches], axis=0)


def most_shared(a: np.ndarray, b: np.ndarray) -> int:
    """A bound on the overlap of sets with these sketches."""
    n = min(len(a), len(b))
    return int(np.minimum(folded(a, n), folded(b, n)).sum())


def links(sets: list[np.ndarray], names: list[int], split: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among `sets`, or between the first `split` and the rest if split > 0."""
    n = np.array([len(s) for s in sets])
    m = len(sets)
    left = range(split) if split else range(m - 1)
    if m == 2:
        both = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [0, 0]])
    else:
        _, back = np.unique(np.concatenate(sets), return_inverse=True)
        own = np.repeat(np.arange(m), n)
        width = int(back.max()) + 1
        both = np.zeros((m, m), np.int64)
        for lo in range(0, width, 1 << 15):  # the sets as a dense matrix, some columns at a time
            some = (back >= lo) & (back < lo + (1 << 15))
            a = np.zeros((m, min(width - lo, 1 << 15)), np.float32)
            a[own[some], back[some] - lo] = 1
            both += (a @ a.T).astype(np.int64)
    hit = 100 * both >= percent * (n[:, None] + n[None] - both)
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in left:
        for j in np.flatnonzero(hit[i, max(split, i + 1) :]) + max(split, i + 1):
            a, b = find(i), find(int(j))
            if a != b:
                root[b] = a
                out.append((names[i], names[int(j)]))
    return out


def components(df: DataFrame, k: int = 5, percent: int = 80, group_rows: int = 64, group_tokens: int = 20_000, hot_posting: int = 32, frequent: int = 24, most_frequent: int = 300_000) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of `df`.

    Words are runs of characters but ASCII white space, with A-Z in lower case;
    a text's set has its distinct k-word shingles, or its whole sequence if it is
    shorter. Two texts link when 100 * intersection >= percent * union; empty sets
    link with nothing (also null texts). A null doc_id takes its component's
    smallest id, or null. Rows with one doc_id and different texts link by their
    texts alone. Repeated rows give rows like others, an empty table none. Columns
    other than doc_id and text play no part.

    `most_frequent` bounds the broadcast table of frequent tokens, which only
    orders tokens; sets have 64-bit hashes and names.
    """
    spark = df.sparkSession
    # a text is found again by the hash t
    docs = df.select("doc_id", F.xxhash64("text").alias("t"), "text")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    with small_batches(spark, 1000):
        known = _frequent(docs.select("text"), k, percent, frequent, most_frequent)
    shared = spark.sparkContext.broadcast(known)
    release(spark)

    @trimmed
    def sign(batches):
        """Every row's set by name, size and smallest hashes; of each set, once in a task, its sketch and prefix."""
        import pyarrow as pa

        keys, counts = shared.value
        seen: set[int] = set()
        for sets in _sets(batches, k, "doc_id", "t"):
            own = []
            for (doc_id, t), s in sets:
                name = node_of(s) if len(s) else None
                low, more = None, (None, None, None)
                if name is not None:
                    low = lowest(s)
                    if name not in seen:
                        seen.add(name)
                        more = (stored(sketch(s)), prefix(s, frequency(s, keys, counts, parts), percent).tobytes(), parities(s).tobytes())
                own.append((doc_id, t, len(s), name, low, *more))
            types = (*[pa.int64()] * 5, *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own, strict=True), types, strict=True)], names=["doc_id", "t", "n", "node", "low", "sketch", "prefix", "odd"])

    with small_batches(spark, 2000):
        signed = cut(docs.mapInArrow(sign, "doc_id long, t long, n long, node long, low long, sketch binary, prefix binary, odd binary"))
    rows = cut(signed.select("doc_id", "t", "n", "node", "low"))

    # groups: nodes with the same smallest hashes, split where there are many; such a hash is dealt by `salts`
    nodes = cut(rows.filter("node IS NOT NULL").groupBy("node", "low").agg(F.first("n").alias("n"), F.min("doc_id").alias("least"), F.min("t").alias("t")))
    salts = 64
    big = nodes.groupBy("low").agg(F.greatest(F.ceil(F.count("*") / group_rows), F.ceil(F.sum("n") / group_tokens)).alias("pieces")).filter("pieces > 1")
    big = big.select("low", "pieces", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    grouped = nodes.withColumn("salt", F.pmod("node", F.lit(salts)).cast("int")).join(big, ["low", "salt"], "left")
    grouped = cut(grouped.select("node", "n", "t", F.xxhash64("low", F.pmod(F.col("node"), F.coalesce("pieces", F.lit(1)))).alias("grp")))

    sketches = signed.filter("sketch IS NOT NULL").groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix"), F.first("odd").alias("odd"))
    members = sketches.join(grouped, "node").groupBy("grp").agg(*[F.collect_list(c).alias(c) for c in ("node", "n", "t", "sketch", "prefix", "odd")])

    @trimmed
    def union(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for r in b.to_pylist():
                prefixes = [np.frombuffer(p, np.uint64) for p in r["prefix"]]
                first = distinct(np.concatenate([p[: leading(n, percent)] for p, n in zip(prefixes, r["n"], strict=True)]))
                tokens = np.concatenate((first, np.setdiff1d(np.concatenate(prefixes), first)))
                whole = r["sketch"][0] if len(r["sketch"]) == 1 else stored(merged([loaded(s) for s in r["sketch"]]))
                out.append((r["grp"], r["node"], r["t"], min(r["n"]), max(r["n"]), sum(r["n"]), min(slack(x) for x in r["n"]), whole, tokens.tobytes(), len(first), r["n"], r["prefix"] if len(prefixes) > 1 else [b""], r["odd"]))  # a lone member's prefix is its group's tokens
            if out:
                types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.binary())] * 2)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["grp", "nodes", "texts", "lo", "hi", "total", "slack", "sketch", "tokens", "leads", "sizes", "prefixes", "odds"])

    with small_batches(spark, 1000):
        groups = cut(members.mapInArrow(union, "grp long, nodes array<long>, texts array<long>, lo long, hi long, total long, slack long, sketch binary, tokens binary, leads long, sizes array<long>, prefixes array<binary>, odds array<binary>"))
    del signed, sketches, members
    release(spark)

    # the matrix: a row for each token of a group's union, where two groups at least have the token
    def explode(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                tokens = [np.frombuffer(t, np.int64) for t in b.column(4).to_pylist()]
                of = pa.array(np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]))
                leads = np.concatenate([np.arange(len(t)) < n for t, n in zip(tokens, b.column(5).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), *[b.column(i).take(of) for i in range(4)], pa.array(leads)], names=["token", "grp", "lo", "hi", "slack", "leads"])

    matrix = groups.select("grp", "lo", "hi", "slack", "tokens", "leads").mapInArrow(explode, "token long, grp long, lo long, hi long, slack long, leads boolean")
    each = W.partitionBy("token")
    matrix = cut(matrix.withColumn("many", F.count("*").over(each)).filter("many > 1"))
    release(spark)

    @trimmed
    def bound(batches):
        """Pairs of groups whose sketches allow a link; the one with fewer tokens first."""
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x, y = ([loaded(v) for v in b.column(i).to_pylist()] for i in (2, 3))
                sizes = sum(b.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
                most = np.fromiter(map(most_shared, x, y), np.int64, len(x))
                yield b.select([0, 1]).filter(pa.array((100 + percent) * most >= percent * sizes))

    def bounded(pairs: DataFrame) -> DataFrame:
        of = lambda s: groups.select(F.col("grp").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("sketch", "lo", "hi", "total")])
        near = pairs.join(of("a"), "a").join(of("b"), "b").filter(f"100 * hi_a >= {percent} * lo_b AND 100 * hi_b >= {percent} * lo_a")
        less = F.col("total_a") <= F.col("total_b")
        first, second = (F.when(less, F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
        return near.select(first.alias("a"), second.alias("b"), "sketch_a", "sketch_b", "lo_a", "lo_b").mapInArrow(bound, "a long, b long")

    def opened(pairs: DataFrame) -> DataFrame:
        """Links between the members of each pair of groups (of one group, if a = b)."""
        pairs = cut(pairs)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("grp")).distinct()
        wanted = cut(groups.join(wanted, "grp", "left_semi").select("grp", F.explode(F.arrays_zip("nodes", "texts")).alias("x")).select("grp", F.col("x.nodes").alias("node"), F.col("x.texts").alias("t")))
        # a bitmap of bounded size spares the shuffle most texts that aren't wanted; the join below is exact
        bits = 1 << max(10, min(26, (8 * wanted.count()).bit_length()))
        slot = F.pmod(F.col("t"), F.lit(bits))
        words = wanted.groupBy(F.floor(slot / 64).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(t, {bits}) % 64 AS int))")).alias("v")).toPandas()
        table = np.zeros(bits // 64, np.uint64)
        table[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).astype(np.uint64)
        wanted_bits = spark.sparkContext.broadcast(table)

        @trimmed
        def emit(batches):
            import pyarrow as pa
            import zstandard

            table, pack = wanted_bits.value, zstandard.ZstdCompressor(level=3)
            seen: set[int] = set()
            for b in batches:
                t = b.column(0).to_numpy(zero_copy_only=False)
                i = t % bits
                own = []
                for j in np.flatnonzero((table[i // 64] >> (i % 64).astype(np.uint64)) & np.uint64(1)).tolist():
                    if int(t[j]) not in seen and (text := b.column(1)[j].as_py()) is not None:
                        seen.add(int(t[j]))
                        own.append((int(t[j]), pack.compress(text.encode("utf-8", "surrogatepass"))))
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*own, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["t", "text"])

        full = docs.select("t", "text").mapInArrow(emit, "t long, text binary").groupBy("t").agg(F.first("text").alias("text")).join(wanted, "t")
        packs = full.groupBy("grp").agg(F.collect_list("node").alias("nodes"), F.collect_list("text").alias("texts"))
        side = lambda s: packs.select(F.col("grp").alias(s), F.col("nodes").alias(f"nodes_{s}"), F.col("texts").alias(f"texts_{s}"))
        # the smaller group of a pair travels to the larger one
        both = pairs.filter("a <> b").join(side("a"), "a").join(side("b"), "b").select("nodes_a", "texts_a", "nodes_b", "texts_b")
        alone = pairs.filter("a = b").select("a").join(side("a"), "a").select("nodes_a", "texts_a", F.lit(None).cast("array<long>").alias("nodes_b"), F.lit(None).cast("array<binary>").alias("texts_b"))

        @trimmed
        def compare(batches):
            import pyarrow as pa
            import zstandard

            unpack = zstandard.ZstdDecompressor()
            known: dict[int, np.ndarray] = {}  # sets of late; a group comes with many others in a row
            size = 0

            def sets_of(names, texts):
                nonlocal size
                if size > MOST_KNOWN:
                    known.clear()
                    size = 0
                new = [i for i, x in enumerate(names) if x not in known]
                for i, s in zip(new, shingle_sets([unpack.decompress(texts[i]).decode("utf-8", "surrogatepass") for i in new], k), strict=True):
                    known[names[i]] = s
                    size += len(s)
                return [known[x] for x in names]

            for b in batches:
                out = []
                for i in range(b.num_rows):
                    na, ta, nb, tb = (b.column(c)[i].as_py() for c in range(4))
                    names = [*na, *(nb or ())]
                    out += links(sets_of(names, [*ta, *(tb or ())]), names, len(na) if nb else 0, percent)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])

        return both.unionByName(alone).mapInArrow(compare, "u long, v long")

    # sizes fit, and the token is a leading one of a member that may be the smaller one
    near = f"100 * x.hi >= {percent} * y.lo AND 100 * y.hi >= {percent} * x.lo AND (x.leads AND x.lo <= y.hi OR y.leads AND y.lo <= x.hi)"
    pair = (F.least("x.grp", "y.grp").alias("a"), F.greatest("x.grp", "y.grp").alias("b"), F.least("x.slack", "y.slack").alias("slack"))
    few = matrix.filter(F.col("many") <= hot_posting)

    def signatures(labels: DataFrame) -> DataFrame:
        """The matrix with each group's component; a group whose members are in several stands for itself."""
        own = groups.select("grp", F.explode("nodes").alias("node")).join(labels, "node", "left").groupBy("grp").agg(F.min(F.coalesce("label", "node")).alias("l1"), F.max(F.coalesce("label", "node")).alias("l2"))
        sig = F.when(F.col("l1") == F.col("l2"), F.struct(F.lit(0).alias("kind"), F.col("l1").alias("id"))).otherwise(F.struct(F.lit(1).alias("kind"), F.col("grp").alias("id")))
        return cut(matrix.drop("sig").join(own.select("grp", sig.alias("sig")), "grp"))

    def partners(salt: int, each: int = 6, dealt: int = 256) -> DataFrame:
        """For each group a few others from the postings of its frequent leading tokens: next in size among about `dealt` random ones."""
        hot = matrix.filter((F.col("many") > hot_posting) & F.col("leads")).withColumn("deal", F.pmod(F.xxhash64("grp", F.lit(salt)), F.ceil(F.col("many") / dealt)))
        before = F.lag(F.struct("grp", "lo", "hi", "sig")).over(W.partitionBy("token", "deal").orderBy("lo", F.xxhash64("grp", F.lit(salt))))
        found = hot.withColumn("p", before).filter(f"sig <> p.sig AND 100 * hi >= {percent} * p.lo AND 100 * p.hi >= {percent} * lo")
        some = F.row_number().over(W.partitionBy("grp").orderBy(F.xxhash64("token", F.lit(salt))))
        return found.withColumn("i", some).filter(F.col("i") <= each).select(F.least("grp", "p.grp").alias("a"), F.greatest("grp", "p.grp").alias("b")).distinct()

    def hubs(each: int = 3) -> DataFrame:
        """For each group a few others from the postings of its frequent tokens: of each posting's groups of about its size, the one with the fewest infrequent tokens a member."""
        hot = matrix.filter(F.col("many") > hot_posting).withColumn("size", F.floor(F.log("lo") / float(np.log(100 / percent) if percent < 100 else 1)))
        rare = (F.col("all") - F.col("n")) / F.col("members")
        most = hot.groupBy("grp").agg(F.count("*").alias("n")).join(groups.select("grp", (F.length("tokens") / 8).alias("all"), F.size("nodes").alias("members")), "grp").select("grp", F.struct((-rare).alias("rare"), "members", "grp").alias("hub"))
        hot = hot.join(most, "grp")
        found = hot.join(hot.groupBy("token", "size").agg(F.max("hub").alias("best")), ["token", "size"]).filter("grp <> best.grp").select("grp", "best").distinct()
        some = F.row_number().over(W.partitionBy("grp").orderBy(F.desc("best")))
        return found.withColumn("i", some).filter(F.col("i") <= each).select(F.least("grp", "best.grp").alias("a"), F.greatest("grp", "best.grp").alias("b")).distinct()

    # first: groups with themselves, with one group of those that share enough, and with a few partners and hubs
    alone = groups.filter(F.size("nodes") > 1).select(F.col("grp").alias("a"), F.col("grp").alias("b"))
    alike = few.alias("x").join(few.alias("y"), F.expr(f"x.token = y.token AND x.grp < y.grp AND {near}")).select(*pair)
    alike = alike.groupBy("a", "b").agg(F.count("*").alias("m"), F.first("slack").alias("slack")).filter("m >= slack")
    one = alike.groupBy("b").agg(F.min(F.struct((-F.col("m")).alias("m"), "a")).alias("p")).select("p.a", "b")
    matrix = matrix.withColumn("sig", F.struct(F.lit(1).alias("kind"), F.col("grp").alias("id")))
    with small_batches(spark):
        edges = cut(opened(alone.unionByName(bounded(partners(0).unionByName(one).unionByName(hubs()).distinct()))))
    release(spark)
    labels = joined(None, edges)
    matrix = signatures(labels)
    with small_batches(spark):
        edges = cut(opened(bounded(partners(1))))
    release(spark)
    labels = joined(labels, edges)

    # then: groups that share enough tokens and aren't in one component already
    matrix = signatures(labels)
    few = matrix.filter(F.col("many") <= hot_posting)
    shares = few.alias("x").join(few.alias("y"), F.expr(f"x.token = y.token AND x.grp < y.grp AND x.sig <> y.sig AND {near}")).select(*pair)
    # nodes, and whole components as groups of their nodes, that may link: their odd ranges allow it too
    # the ranges stay one column: Spark infers constraints for every choice of renamed columns in a condition
    differ = " + ".join(f"bit_count((x.ranges[{i}] & y.ranges[{i + WORDS}]) | (x.ranges[{i + WORDS}] & y.ranges[{i}]))" for i in range(WORDS))
    near = f"{near} AND {100 + percent} * ({differ}) <= {100 - percent} * (x.hi + y.hi)"

    @trimmed
    def postings(batches):
        """A row for each frequent token of each member's prefix."""
        import pyarrow as pa

        for b in batches:
            out = []
            for r in b.to_pylist():
                hot = np.sort(np.array(r["hot"], np.int64).view(np.uint64))
                for node, n, p, odd in zip(r["nodes"], r["sizes"], r["prefixes"], r["odds"], strict=True):
                    p = np.frombuffer(p or r["tokens"], np.uint64)
                    at = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, p), len(hot) - 1)] == p)
                    ranges = agreed([np.frombuffer(odd, np.int64)])
                    out += [(t, r["grp"], node, n, n, r["slack"], i < leading(n, percent), ranges) for t, i in zip(p[at].view(np.int64).tolist(), at.tolist(), strict=True)]
            if out:
                types = (*[pa.int64()] * 6, pa.bool_(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["token", "grp", "node", "lo", "hi", "slack", "leads", "ranges"])

    hot = matrix.filter(F.col("many") > hot_posting).groupBy("grp").agg(F.collect_list("token").alias("hot"))
    hot = groups.select("grp", "slack", "nodes", "tokens", "sizes", "prefixes", "odds").join(hot, "grp")
    with small_batches(spark):
        hot = hot.mapInArrow(postings, "token long, grp long, node long, lo long, hi long, slack long, leads boolean, ranges array<long>")
        hot = cut(hot.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    both = F.array(*[F.bit_and(F.col("ranges")[i]) for i in range(2 * WORDS)])
    kinds = cut(hot.groupBy("token", "label").agg(F.max("leads").alias("leads"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), both.alias("ranges")))
    whole = lambda s, *more: F.struct(*[F.col(f"{s}.{c}") for c in (*more, "lo", "hi", "leads", "ranges")]).alias(s)
    across = kinds.alias("x").join(kinds.alias("y"), F.expr(f"x.token = y.token AND x.label < y.label AND {near}")).select(F.col("x.token").alias("t"), F.col("x.label").alias("s"), F.col("y.label").alias("z"), whole("y"))
    wide = across.join(hot.alias("x"), F.expr(f"t = x.token AND s = x.label AND {near}")).select("t", "z", whole("x", "grp", "node", "slack"))
    # members of one group have been compared
    wide = wide.join(hot.alias("y"), F.expr(f"t = y.token AND z = y.label AND x.grp <> y.grp AND {near}")).select(*pair, F.col("x.node").alias("u"), F.col("y.node").alias("v"))
    # two groups' nodes share at most the few tokens of the groups and the frequent ones of the nodes
    wide = wide.groupBy("a", "b", "slack", "u", "v").agg(F.count("*").alias("m")).groupBy("a", "b", "slack").agg(F.max("m").alias("m"))
    shares = shares.groupBy("a", "b", "slack").agg(F.count("*").alias("m"))
    counted = shares.unionByName(wide).groupBy("a", "b", "slack").agg(F.sum("m").alias("m")).filter("m >= slack").select("a", "b")
    with small_batches(spark):
        more = cut(opened(bounded(counted)))
    release(spark)
    labels = joined(labels, more)

    final = nodes.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    smallest = final.groupBy("label").agg(F.min("least").alias("component_id"))
    final = final.join(smallest, "label").select("node", "component_id")
    return rows.join(final, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op4_group_matrix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 3-word shingles and a similarity of 0.9."""
    return components(read(spark, sf_dir, "documents"), k=3, percent=90)


#: The same by DuckDB, on the shingles' texts.
ORACLE_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE a = s.doc_id) AS component_id FROM s
"""
