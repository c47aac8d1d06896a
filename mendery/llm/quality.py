"""Document quality from a linear-chain conditional random field over lines.

Every line of a whole text is labelled bad or good. A line's statistics (lengths,
shares of letters, capitals, digits and symbols, word lengths, repeated and
distinct words, copies of the line, its end) fall into bins learned from the
training sample; its features are its own bins and those of the lines before and
after, beside the learned transitions. Documents carry the labels, lines don't:
the lines of a good document are good, those of a bad one start as bad and after
each fit go over to what the chain says, as long as a line stays bad. A document's
goodness is the mean of its lines' forward-backward marginals, weighted by length;
a logistic curve fitted on the same sample turns it into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery.llm.common import SLICE, arrow_rows, batches_of, crc_remainder, only, read, text_batches
from mendery.llm.crf import Crf, fit, whole
from mendery.llm.textvec import LETTER, NUMBER, OTHER, SPACE, Texts, classes

BINS = 10
STATS = ("length", "letters", "capitals", "digits", "symbols", "marks", "word_length", "short_words", "repeats", "distinct", "copies", "stop", "words")
_COMMON = np.array([ord(c) for c in " ,.;:'\"!?()-\n"], np.uint32)
_ENDS = np.array([ord(c) for c in ".!?…:;\"'"], np.uint32)


def line_stats(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics of each line, its length and how many lines each text has (one at least)."""
    t = Texts(texts)
    c = classes()[t.cps]
    brk = t.cps == 10
    brk[t.marks] = True
    end = np.flatnonzero(brk)
    begin = np.concatenate(([0], end[:-1] + 1))
    of = np.searchsorted(t.starts, begin, "right") - 1
    size = end - begin

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
        return (total[end] - total[begin]).astype(np.float64)

    letters, some = count(c == LETTER), np.maximum(size, 1)
    upper = np.zeros(0x110000, bool)
    upper[65:91] = upper[0xC0:0xDF] = True
    odd = (c == OTHER) & ~np.isin(t.cps, _COMMON)
    wb, we, _ = t.words()
    line = np.searchsorted(begin, wb, "right") - 1
    n = np.bincount(line, minlength=len(begin)).astype(np.float64)
    words = np.maximum(n, 1)
    chars = np.bincount(line, we - wb, len(begin))
    h = t.hashes(wb, we)
    again = np.concatenate(([False], (h[1:] == h[:-1]) & (line[1:] == line[:-1]))) if len(h) else np.zeros(0, bool)
    order = np.lexsort((h, line))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    per = lambda mask, of_=None: np.bincount(line if of_ is None else of_, mask, len(begin))
    lh = t.hashes(begin, end)
    order2 = np.lexsort((lh, of))
    first = np.ones(len(lh), bool)
    first[1:] = (lh[order2][1:] != lh[order2][:-1]) | (of[order2][1:] != of[order2][:-1])
    group = np.cumsum(first) - 1
    copies = np.empty(len(lh))
    copies[order2] = np.bincount(group)[group]
    last = t.cps[np.maximum(end - 1, 0)]
    stats = np.stack(
        [
            np.log1p(size),
            letters / some,
            count(upper[t.cps]) / np.maximum(letters, 1),
            count(c == NUMBER) / some,
            count(odd) / some,
            count((c == OTHER) & ~odd & (t.cps != 32)) / some,
            chars / words,
            per((we - wb) <= 3) / words,
            per(again) / words,
            per(fresh, line[order]) / words,
            copies,
            np.isin(last, _ENDS) * (size > 0) * 1.0,
            n,
        ],
        axis=1,
    )
    return stats, size, np.bincount(of, minlength=len(texts)).astype(np.int64)


@dataclass
class Model:
    """Bin edges, weights [place, statistic, bin, label], chain weights and the final curve."""

    edges: list[np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((3, len(STATS), BINS + 1, 2)))
    crf: Crf = field(default_factory=lambda: Crf(2))
    curve: tuple[float, float] = (0.0, 1.0)

    def slots(self, stats: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Flat indices into weights[..., label] of each line's own, previous and next line's bins."""
        own = np.stack([np.searchsorted(e, stats[:, j], "right") for j, e in enumerate(self.edges)], axis=1)
        wall = np.full((1, own.shape[1]), BINS)  # beyond the text
        before, after = np.concatenate((wall, own[:-1])), np.concatenate((own[1:], wall))
        ends = np.cumsum(lines)
        before[ends - lines], after[ends - 1] = BINS, BINS
        j = np.arange(own.shape[1])
        return np.concatenate([(p * len(STATS) + j) * (BINS + 1) + x for p, x in enumerate((own, before, after))], axis=1)

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each line's probability to be good, its length, and lines by text."""
        stats, size, lines = line_stats(texts)
        emit = self.weights.reshape(-1, 2)[self.slots(stats, lines)].sum(axis=1)
        return self.crf.marginals(emit, *whole(lines))[:, 1], size, lines

    def goodness(self, good: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        of = np.repeat(np.arange(len(lines)), lines)
        w = size + 1.0
        return np.bincount(of, good * w, len(lines)) / np.bincount(of, w, len(lines))

    def score(self, texts: list[str]) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a + b * self.goodness(*self.marginals(texts)))))


def train(rows: list[tuple[int, str]], rounds: int = 3, steps: int = 60) -> Model:
    """A model from (label, text) rows; without both labels every score is the share of label 1 (1/2 without rows)."""
    y = np.array([r[0] for r in rows], int)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model([np.arange(1.0, BINS)] * len(STATS), curve=(float(np.log(share / (1 - share))), 0.0))
    texts = [r[1] for r in rows]
    parts = [line_stats([x[0] for x in held]) for held in batches_of(((x,) for x in texts), 1_000_000)]
    stats, size, lines = (np.concatenate(x) for x in zip(*parts, strict=True))
    of = np.repeat(np.arange(len(texts)), lines)
    model = Model([np.unique(np.quantile(stats[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(len(STATS))])
    slots = model.slots(stats, lines)
    flat = model.weights.reshape(-1, 2)
    starts, lengths = whole(lines)
    label = y[of]

    def emit():
        return flat[slots].sum(axis=1)

    def grad(left):
        g = np.stack([np.bincount(slots.ravel(), np.repeat(left[:, k], slots.shape[1]), len(flat)) for k in range(2)], axis=1)
        return {"weights": (flat, g)}

    for _ in range(rounds):
        fit(model.crf, emit, grad, label, starts, lengths, steps, decay=1e-4)
        good = model.crf.marginals(emit(), starts, lengths)[:, 1]
        worst = np.full(len(texts), 2.0)
        np.minimum.at(worst, of, good)
        label = np.where(y[of] == 1, 1, ((good > 0.5) & (good > worst[of])).astype(int))
    x = model.goodness(model.crf.marginals(emit(), starts, lengths)[:, 1], size, lines)
    a = b = 0.0
    for _ in range(50):  # Newton's method on the regularised likelihood
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(y - p).sum(), ((y - p) * x).sum() - 0.01 * b])
        w = p * (1 - p)
        hess = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        d = np.linalg.solve(hess, g)
        a, b = a + np.clip(d[0], -5, 5), b + np.clip(d[1], -5, 5)
    model.curve = (float(a), max(0.0, float(b)))
    return model


def sample(docs: DataFrame, labels: DataFrame, rows: int = 4000, chars: int = 16_000_000) -> list[tuple[int, str]]:
    """About `rows` labelled documents (the fit's bound, at most twice as many), chosen by a hash of doc_id.

    The fit takes place on the driver, so whole texts are taken in the order of that
    hash, each if it fits into what is left of `chars` characters.
    """
    spark = docs.sparkSession
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("_quality")).dropDuplicates(["doc_id"])
    n = known.count()
    u = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) / 1_000_000
    some = known.withColumn("_u", u).filter(F.col("_u") < min(1.0, rows / max(n, 1))).limit(2 * rows)
    # bounded tables of ids and labels
    some = spark.createDataFrame(some.collect(), some.schema)
    own = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    sizes = own.groupBy("doc_id", "_u").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size")).collect()
    fit, left = [], chars
    for r in sorted(sizes, key=lambda r: (r["_u"], r["doc_id"])):
        if r["size"] <= left:
            fit.append((r["doc_id"],))
            left -= r["size"]
    if len(fit) < len(sizes):
        own = own.join(F.broadcast(spark.createDataFrame(fit, some.select("doc_id").schema)), "doc_id", "left_semi")
    kept = own.limit(2 * rows)
    return sorted((r["_quality"], r["text"] or "") for r in kept.collect())


def score_documents(df: DataFrame, model: Model, chars: int = 1_000_000) -> DataFrame:
    """doc_id, score and n_lines of every whole text. Null texts are empty; an empty text is one empty line.

    Repeated rows give rows like others, an empty table none; columns other than
    doc_id and text play no part.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for held in batches_of(arrow_rows(batches, "doc_id", "text"), chars):
            good, size, lines = model.marginals([x[1] for x in held])
            a, b = model.curve
            p = 1 / (1 + np.exp(-(a + b * model.goodness(good, size, lines))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array(p), pa.array(lines, pa.int64())], names=["doc_id", "score", "n_lines"])

    return text_batches(df).select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_lines long")


def keep_good(df: DataFrame, model: Model, least_score: float, chars: int = 1_000_000) -> DataFrame:
    """The rows of `df`, all columns, whose text scores at least this; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index("text")

    def run(batches):
        import pyarrow as pa

        only("quality", dict)
        for b in (x.slice(i, SLICE) for x in batches for i in range(0, x.num_rows, SLICE)):
            keep: list[bool] = []
            for held in batches_of(((x or "",) for x in b.column(at).to_pylist()), chars):
                keep += (shared.value.score([x[0] for x in held]) >= least_score).tolist()
            yield b.filter(pa.array(keep, pa.bool_()))

    return text_batches(df).mapInArrow(run, df.schema)


def label_lines(df: DataFrame, model: Model, chars: int = 1_000_000) -> DataFrame:
    """Every line's probability to be good: doc_id, line, good."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for held in batches_of(arrow_rows(batches, "doc_id", "text"), chars):
            good, _, lines = shared.value.marginals([x[1] for x in held])
            ends = np.cumsum(lines)
            ids = pa.array([x[0] for x in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), lines)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(good)) - np.repeat(ends - lines, lines), pa.int64()), pa.array(good)], names=["doc_id", "line", "good"])

    return text_batches(df).select("doc_id", "text").mapInArrow(run, "doc_id long, line long, good double")


def train_on(docs: DataFrame, labels: DataFrame) -> Model:
    return train(sample(docs, labels))


THRESHOLD = 0.3


def op10_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels whose crc32 remainder by 5 is not 0."""
    docs = read(spark, sf_dir, "documents")
    held_out = crc_remainder("doc_id", 5) == 0
    model = train_on(docs, read(spark, sf_dir, "labels").filter(~held_out))
    out = score_documents(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines")
