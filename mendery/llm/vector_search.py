"""Approximate nearest neighbours by inner product: inverted file with product quantisation.

Equal vectors are one class with the ids that can matter (the k + 1 smallest), so
a vector that many rows share is indexed once. Classes get one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm, which makes the largest inner product
the smallest distance. They go to the nearest of the coarse centroids; the
residual is product-quantised. A query probes the cells with the nearest
centroids: as many as hold `target` of the true neighbours within the sample, and
on until they hold `rerank` classes. Whole cells are dealt to blocks of about
`block_rows` classes (a larger cell to several). There asymmetric distance tables
(query sub-vector by codeword) score all codes of the probed cells, and the best
`rerank` of a block are scored again exactly, in double precision, from the
original vectors beside the codes, as are all others that the error of their
codes doesn't rule out; so nothing is missed within the probed cells, also where
many vectors share a code.

The centroids, codebooks and the number of probes are fitted on a bounded sample
(`sample_rows`, or 32 a cell if that is more); every vector is indexed. Queries
travel in packs, and blocks are repeated where there are very many queries, so
neither a full cell, a hot vector nor all queries meet one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mendery.llm.common import cut, read, small_batches


@dataclass
class Index:
    """Fitted parts: coarse centroids [cells, d + 1], codebooks [parts, 256, width], the largest norm."""

    coarse: np.ndarray
    books: np.ndarray
    norm: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.concatenate((x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))[:, None]), axis=1)

    def split(self, x: np.ndarray) -> np.ndarray:
        """[n, d + 1] to [n, parts, width], padded with zeros."""
        parts, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def distances(self, x: np.ndarray, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Squared distances of queries to centroids, less the query's own norm. The added coordinate of a query is 0."""
        c = self.coarse[some]
        return (c**2).sum(axis=1)[None] - 2 * x.astype(np.float64) @ c[:, :-1].T

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        c = self.coarse
        return ((c**2).sum(axis=1)[None] - 2 * self.lift(x) @ c.T).argmin(axis=1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = self.split(self.lift(x) - self.coarse[cell])
        return np.stack([((b**2).sum(axis=1)[None] - 2 * rest[:, j] @ b.T).argmin(axis=1) for j, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def errors(self, x: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each vector is from what its code stands for, without the added coordinate, which no query has."""
        made = np.concatenate([b[c] for b, c in zip(self.books, codes.T, strict=True)], axis=1)[:, : x.shape[1]]
        return np.linalg.norm(x - self.coarse[cell, :-1] - made, axis=1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of codewords and query parts: [parts, 256, queries]."""
        q = self.split(np.pad(queries.astype(np.float64), ((0, 0), (0, 1))))
        return np.einsum("pcw,qpw->pcq", self.books, q).astype(np.float32)

    def approximate(self, queries: np.ndarray, far: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """[queries, codes] estimated inner products; -inf in cells beyond the distance `far` of the query."""
        some, of = np.unique(cell, return_inverse=True)
        base = queries.astype(np.float64) @ self.coarse[some, :-1].T
        base[self.distances(queries, some) > far[:, None]] = -np.inf
        out = base.T.astype(np.float32)[of]
        for table, code in zip(self.tables(queries), codes.T, strict=True):
            out += table[code]
        return np.ascontiguousarray(out.T)


def _kmeans(x: np.ndarray, k: int, steps: int, rng) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        a = np.concatenate([((c**2).sum(axis=1)[None] - 2 * p @ c.T).argmin(axis=1) for p in np.array_split(x, -(-len(x) // 8192))])
        n = np.bincount(a, minlength=len(c))
        s = np.stack([np.bincount(a, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def fit(sample: np.ndarray, norm: float, cells: int, parts: int = 16, steps: int = 8, seed: int = 11) -> Index:
    rng = np.random.default_rng(seed)
    width = -(-(sample.shape[1] + 1) // parts)
    index = Index(np.zeros((1, sample.shape[1] + 1)), np.zeros((parts, 1, width)), norm)
    lifted = index.lift(sample)
    index.coarse = _kmeans(lifted, cells, steps, rng)
    rest = index.split(lifted - index.coarse[index.cell(sample)])
    books = [_kmeans(rest[:, j], 256, steps, rng) for j in range(parts)]
    index.books = np.stack([np.pad(b, ((0, 256 - len(b)), (0, 0)), mode="edge") for b in books])
    return index


def probes_for(index: Index, sample: np.ndarray, k: int, target: float, queries: int = 256, seed: int = 13) -> int:
    """How many nearest cells hold `target` of the k true neighbours of sampled queries within the sample."""
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    x, cell, place = sample.astype(np.float64), index.cell(sample), []
    chosen = np.random.default_rng(seed).choice(len(x), min(queries, len(x)), replace=False)
    for part in np.array_split(chosen, -(-len(chosen) // 32)):
        score = x[part] @ x.T
        score[np.arange(len(part)), part] = -np.inf
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        nth = np.argsort(np.argsort(index.distances(x[part]), axis=1, kind="stable"), axis=1)
        place.append(np.take_along_axis(nth, cell[near], axis=1).ravel())
    return int(np.quantile(np.concatenate(place), target, method="higher")) + 1


def _matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as a float32 matrix."""
    return np.asarray(column.flatten(), np.float32).reshape(len(column), -1)


def _distinct(keep: int, every: int):
    """Per batch: each distinct vector once, with its smallest ids and whether a query is among its rows."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            x = _matrix(b.column(1)) + np.float32(0)  # -0 is 0
            order = np.lexsort((ids, *x.T[::-1]))
            x, ids = x[order], ids[order]
            new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1))))
            groups = np.split(ids, new[1:])
            yield pa.RecordBatch.from_arrays([pa.array(list(x[new]), pa.list_(pa.float32())), pa.array([g[:keep].tolist() for g in groups], pa.list_(pa.int64())), pa.array([bool((g % every == 0).any()) for g in groups])], names=["embedding", "ids", "asks"])

    return run


def search(df: DataFrame, k: int = 20, every: int = 20, target: float = 0.95, probe_share: float | None = None, rerank: int = 256, sample_rows: int = 16384, most_cells: int = 4096, block_rows: int = 4096, pack_rows: int = 256, block_queries: int = 65536, most_waiting: int = 131072) -> DataFrame:
    """The k nearest found of each row whose vec_id is divisible by `every`: query_id, rank, vec_id, score.

    `df` has vec_id long and embedding array<float>; other columns play no part.
    Rows take no part if the id is null, or the vector is null, empty, zero, holds
    null or non-finite components or has another length than most vectors have. A
    query's own row is no candidate; a repeated row is another row. Equal scores
    go to the smaller id. Fewer candidates than k give fewer rows, an empty table
    none.

    The number of cells is the square root of the rows (at most `most_cells`).
    `probe_share` sets the share of cells that are probed; without it the sample
    does, for `target`: few cells where vectors form clusters, more than half of
    them where they have none.
    """
    spark = df.sparkSession
    fine = "vec_id IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = float('inf')) AND exists(embedding, x -> x <> 0)"
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).filter(fine)
    schema = "query_id long, rank int, vec_id long, score double"
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("m")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    d, n, most = sizes
    rows = rows.filter(F.size("embedding") == d)
    cells = min(most_cells, max(1, round(n**0.5)))
    sample_rows = max(sample_rows, 32 * cells)
    u = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    some = rows.filter(u < sample_rows / n).limit(2 * sample_rows) if n > sample_rows else rows
    sample = np.concatenate([np.asarray(x, np.float32).reshape(-1, d) for x in ([r[0] for r in sorted(some.select("embedding").collect())],)])
    sample = np.unique(sample, axis=0)
    index = fit(sample, most, cells)
    cells = len(index.coarse)
    probes = probes_for(index, sample, k, target) if probe_share is None else max(1, round(cells * probe_share + 0.49))
    shared = spark.sparkContext.broadcast(index)

    # classes of equal vectors; a class is known by two hashes
    classes = rows.mapInArrow(_distinct(k + 1, every), "embedding array<float>, ids array<long>, asks boolean")
    classes = classes.groupBy("embedding").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.max("asks").alias("asks"))
    key = (F.xxhash64("embedding").alias("h1"), F.xxhash64("embedding", F.lit(1)).alias("h2"))

    def assign(batches):
        import pyarrow as pa

        index = shared.value
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                cell = index.cell(x)
                codes = index.encode(x, cell)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([v.tobytes() for v in x]), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes])], names=["ids", "asks", "h1", "h2", "x", "cell", "code"])

    stored = cut(classes.select("embedding", "ids", "asks", *key).mapInArrow(assign, "ids array<long>, asks boolean, h1 long, h2 long, x binary, cell int, code binary"))
    # blocks of whole cells, one row each; these lists have at most `most_cells` entries
    held = {r["cell"]: r["n"] for r in stored.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    full, first, parts, last, room = np.zeros(cells, np.int64), np.zeros(cells, np.int64), np.ones(cells, np.int64), -1, 0
    for c, m in sorted(held.items()):
        if m > room:
            last, room = last + 1, block_rows
        full[c], first[c], parts[c] = m, last, max(1, -(-m // block_rows))
        last, room = last + int(parts[c]) - 1, room - m if parts[c] == 1 else 0
    spread = max(1, -(-stored.filter("asks").count() // block_queries))
    dealt = F.broadcast(spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in held], "cell int, first long, parts long"))
    placed = stored.join(dealt, "cell").withColumn("block", F.col("first") + F.pmod(F.col("h1"), F.col("parts")))
    blocks = placed.groupBy("block").agg(*[F.collect_list(c).alias(f"b_{c}") for c in ("ids", "x", "cell", "code")])
    blocks = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    record = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("far", "<f8"), ("x", "<f4", d)])

    def pack(batches):
        import pyarrow as pa

        index = shared.value
        waiting: dict[int, list[np.ndarray]] = {}
        size: dict[int, int] = {}

        def out(some):
            data = [np.concatenate(waiting.pop(b)) for b in some]
            for b in some:
                del size[b]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([int(v["h1"][0]) % spread for v in data], pa.int32()), pa.array([v.tobytes() for v in data], pa.binary())], names=["block", "copy", "queries"])

        for b in batches:
            for at in range(0, b.num_rows, pack_rows):
                s = b.slice(at, pack_rows)
                rows_ = np.zeros(s.num_rows, record)
                rows_["x"] = np.frombuffer(b"".join(s.column(0).to_pylist()), np.float32).reshape(-1, d)
                rows_["h1"], rows_["h2"] = (s.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                dist = index.distances(rows_["x"])
                order = np.argsort(dist, axis=1, kind="stable")
                enough = (np.cumsum(full[order], axis=1) < rerank).sum(axis=1)
                nth = np.minimum(np.maximum(probes - 1, enough), cells - 1)
                far = np.take_along_axis(dist, np.take_along_axis(order, nth[:, None], axis=1), axis=1)[:, 0]
                rows_["far"] = far + 1e-9 * (np.abs(far) + 1e-9)
                opened = (dist <= rows_["far"][:, None]) & (full > 0)
                who, c = np.nonzero(opened)
                n_parts = parts[c]
                nth_part = np.arange(n_parts.sum()) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
                to = np.unique(np.stack((np.repeat(first[c], n_parts) + nth_part, np.repeat(who, n_parts))), axis=1)
                new = np.flatnonzero(np.diff(to[0], prepend=-1))
                for block, own in zip(to[0][new].tolist(), np.split(to[1], new[1:]), strict=True):
                    waiting.setdefault(block, []).append(rows_[own])
                    size[block] = size.get(block, 0) + len(own)
                some = sum(size.values()) >= most_waiting
                if done := [x for x, m in size.items() if some or m >= pack_rows]:
                    yield out(done)
        if size:
            yield out(list(size))

    asked = stored.filter("asks").select("x", "h1", "h2").mapInArrow(pack, "block long, copy int, queries binary")

    def probe(batches):
        import pyarrow as pa

        index = shared.value
        for b in batches:
            for i in range(b.num_rows):
                q = np.frombuffer(b.column(0)[i].as_py(), record)
                ids = b.column(1)[i].values
                x = np.frombuffer(b"".join(b.column(2)[i].values.to_pylist()), np.float32).reshape(-1, d).astype(np.float64)
                cell = b.column(3)[i].values.to_numpy()
                codes = np.frombuffer(b"".join(b.column(4)[i].values.to_pylist()), np.uint8).reshape(len(x), -1)
                firsts = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
                near = index.approximate(q["x"], q["far"], cell, codes)
                exact = q["x"].astype(np.float64) @ x.T
                m = min(max(rerank, k + 1), len(x))
                best = np.argpartition(-near, m - 1, axis=1)[:, :m]
                known = np.take_along_axis(np.where(np.isneginf(near), -np.inf, exact), best, axis=1)
                worst = np.partition(known, m - 1 - k, axis=1)[:, m - 1 - k] if m > k else np.full(len(q), -np.inf)
                # a code's error bounds how much better its vector can be: none that could be among the best is left out
                length = np.linalg.norm(q["x"].astype(np.float64), axis=1)[:, None]
                may = ~np.isneginf(near) & (near + length * (index.errors(x, cell, codes)[None] + 1e-5 * index.norm) >= worst[:, None])
                near = np.where(may, exact, -np.inf)
                best = np.argpartition(-near, m - 1, axis=1)[:, :m]
                score = np.concatenate([np.einsum("qrd,qd->qr", x[best[a : a + 16]], q["x"][a : a + 16].astype(np.float64)) for a in range(0, len(q), 16)])
                score[np.isneginf(np.take_along_axis(near, best, axis=1))] = -np.inf
                order = np.lexsort((firsts[best], -score), axis=1)[:, : k + 1]
                score, best = np.take_along_axis(score, order, axis=1), np.take_along_axis(best, order, axis=1)
                of, nth = np.nonzero(score > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(q["h1"][of]), pa.array(q["h2"][of]), pa.array(-score[of, nth]), ids.take(pa.array(best[of, nth]))], names=["h1", "h2", "s", "ids"])

    # rows hold whole blocks: few of them in a batch
    with small_batches(spark, 8):
        found = cut(asked.join(blocks, ["block", "copy"]).select("queries", "b_ids", "b_x", "b_cell", "b_code").mapInArrow(probe, "h1 long, h2 long, s double, ids array<long>"))
    nearest = W.partitionBy("h1", "h2").orderBy("s", F.col("ids")[0])
    kept = found.withColumn("_nth", F.row_number().over(nearest)).filter(F.col("_nth") <= k + 1)
    pairs = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("s"), i.alias("i")))))
    best = kept.groupBy("h1", "h2").agg(F.slice(F.array_sort(pairs), 1, k + 1).alias("near"))
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), *[F.xxhash64(e, *rest).alias(a) for a, e, rest in (("h1", F.transform("embedding", lambda v: v + F.lit(0).cast("float")), ()), ("h2", F.transform("embedding", lambda v: v + F.lit(0).cast("float")), (F.lit(1),)))])
    own = F.array_position(F.transform("near", lambda e: e["i"]), F.col("query_id"))
    rest = F.filter("near", lambda e, i: i + 1 != own)
    listed = queries.join(best, ["h1", "h2"]).select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("p", "e"))
    return listed.select("query_id", (F.col("p") + 1).alias("rank"), F.col("e.i").alias("vec_id"), (-F.col("e.s")).alias("score"))


def op2_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose id is divisible by 20."""
    return search(read(spark, sf_dir, "embeddings"))
