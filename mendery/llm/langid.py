"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters, case-folded. A word's features are hashed: prefixes
and suffixes of one to three letters, letter trigrams with word edges, and the
whole word (the lexicon). Weights of features and transitions between the
languages of neighbouring words are learned together, from chains spliced of
spans of several documents so that they switch language. A whole text is one
chain, labelled by forward-backward; the document's language is the one with
most of the letters, weighted by marginal probability, and the score is its
share.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendery.llm.common import SLICE, arrow_rows, batches_of, crc_remainder, only, read, text_batches
from mendery.llm.crf import Crf, chains, fit, whole
from mendery.llm.textvec import LETTER, PieceCache, Texts, classes, mix

SLOTS = 1 << 17
#: A gram is known to a language if it makes at least this share of the grams of its sample (strays of wrong labels do not).
RARE = 1e-5


@functools.cache
def _lower() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(classes() == LETTER).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


def letter_words(texts: list[str]) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with letters in lower case, and begin, end and text number of their runs of letters."""
    t = Texts(texts)
    letter = classes()[t.cps] == LETTER
    letter[t.marks] = False
    t.cps = _lower()[t.cps]
    edge = np.diff(np.concatenate(([0], letter.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return t, begin, end, np.searchsorted(t.starts, begin, "right") - 1


def features(t: Texts, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of the words [begin, end) and the word of each, in any order."""
    n = len(begin)
    each = np.arange(n)
    slots, words = [], []

    def add(kind: int, a: np.ndarray, b: np.ndarray, of: np.ndarray) -> None:
        slots.append((mix(t.hashes(a, b) + np.uint64(kind * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(47)).astype(np.int32))
        words.append(of)

    for k in (1, 2, 3):
        some = each[end - begin >= k]
        add(k, begin[some], begin[some] + k, some)
        add(3 + k, end[some] - k, end[some], some)
    add(7, begin, end, each)
    size = np.maximum(end - begin - 2, 0)
    of = np.repeat(each, size)
    at = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    add(8, at, at + 3, of)
    return np.concatenate(slots), np.concatenate(words)


def grams(t: Texts, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' letter trigrams, of shorter words the whole, and the word of each."""
    size = np.maximum(end - begin - 2, 1)
    of = np.repeat(np.arange(len(begin)), size)
    at = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    return t.hashes(at, np.minimum(at + 3, end[of])), of


@dataclass
class Model:
    """Languages in order, feature weights, the chain's weights and each language's known grams (sorted hashes)."""

    langs: list[str]
    weights: np.ndarray
    crf: Crf
    known: list[np.ndarray] = field(default_factory=list)

    def emissions(self, t: Texts, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        slots, words = features(t, begin, end)
        return np.stack([np.bincount(words, self.weights[slots, k], len(begin)) for k in range(len(self.langs))], axis=1)

    def evidence(self, t: Texts, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each word the number of grams known to each language, and of all its grams (last)."""
        g, of = grams(t, begin, end)
        found = [np.bincount(of, np.isin(g, x), len(begin)) for x in self.known]
        return np.stack([*found, np.bincount(of, minlength=len(begin))], axis=1)


def train(samples: list[tuple[str, str]], steps: int = 60, span: int = 24, seed: int = 7) -> Model:
    """A model from (language, text) rows. Whole texts take part, in spans of `span` words, shuffled into chains of 64."""
    langs = sorted({x[0] for x in samples})
    model = Model(langs, np.zeros((SLOTS, max(1, len(langs)))), Crf(max(1, len(langs))))
    t, begin, end, of = letter_words([x[1] for x in samples])
    label = np.array([langs.index(x[0]) for x in samples], np.int64)
    for k in range(len(langs)):
        own = label[of] == k
        seen, times = np.unique(grams(t, begin[own], end[own])[0], return_counts=True)
        model.known.append(seen[times >= RARE * times.sum()])
    if len(langs) < 2:
        return model
    n = np.bincount(of, minlength=len(samples))
    first = np.cumsum(n) - n
    rng = np.random.default_rng(seed)
    spans = []
    for i in range(len(samples)):
        spans += [np.arange(first[i] + a, first[i] + min(a + span, n[i])) for a in range(0, int(n[i]), span)]
    at = np.concatenate([spans[i] for i in rng.permutation(len(spans))])
    keys, where, word = np.unique(t.hashes(begin[at], end[at]), return_index=True, return_inverse=True)
    slots, words = features(t, begin[at][where], end[at][where])
    y = label[of[at]]
    starts, lengths = chains(np.array([len(at)]), 64)

    def emit():
        e = np.stack([np.bincount(words, model.weights[slots, k], len(keys)) for k in range(len(langs))], axis=1)
        return e[word]

    def grad(left):
        g = np.empty_like(model.weights)
        for k in range(len(langs)):
            g[:, k] = np.bincount(slots, np.bincount(word, left[:, k], len(keys))[words], SLOTS)
        return {"weights": (model.weights, g)}

    fit(model.crf, emit, grad, y, starts, lengths, steps, block=64)
    model.weights = model.weights.astype(np.float32)
    return model


def sample(df: DataFrame, per_lang: int = 150) -> list[tuple[str, str]]:
    """About `per_lang` labelled rows of every language, chosen by a hash of doc_id.

    `per_lang` is a parameter of the fit; at most twice as many rows a language are kept.
    """
    rows = df.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    counts = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, per_lang / n))])
    u = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    drawn = rows.filter(u < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text")))
    kept = drawn.withColumn("place", place).filter(F.col("place") <= 2 * per_lang)
    return sorted((r["lang"], r["text"]) for r in kept.select("lang", "text").collect())


def train_on(df: DataFrame) -> Model:
    return train(sample(df))


def _score(model: Model, evidence: bool = False):
    n_langs = len(model.langs)
    width = n_langs + (n_langs + 1) * evidence

    def compute(pieces: list[str]):
        t = Texts(pieces)
        t.cps = _lower()[t.cps]
        values = model.emissions(t, t.starts[:-1], t.marks)
        if evidence:
            values = np.concatenate((values, model.evidence(t, t.starts[:-1], t.marks)), axis=1)
        return values.ravel(), np.full(len(pieces), width, np.int64)

    cache = PieceCache(compute, most=2_000_000, dtype=np.float32)

    def run(texts: list[str]):
        """Words, their marginals, the texts, and with `evidence` the words' known grams, of all texts."""
        t, begin, end, of = letter_words(texts)
        if not len(begin):
            return begin, end, of, np.empty((0, n_langs)), t, np.empty((0, width - n_langs))
        values = cache.gather(cache.rows(t, begin, end)).reshape(-1, width)
        starts, lengths = whole(np.bincount(of, minlength=len(texts)))
        return begin, end, of, model.crf.marginals(values[:, :n_langs], starts, lengths), t, values[:, n_langs:]

    return run


def _scorer(shared, evidence: bool = False):
    """The worker's scorer for a broadcast model."""
    return only(("language", shared.id, evidence), lambda: _score(shared.model.value, evidence))


class _Shared:
    """A broadcast model and a name for it."""

    def __init__(self, spark: SparkSession, model: Model):
        self.model = spark.sparkContext.broadcast(model)
        self.id = f"{spark.sparkContext.applicationId}-{self.model._jbroadcast.id()}"


def identify(df: DataFrame, model: Model, chars: int = 1_000_000) -> DataFrame:
    """`df`'s doc_id with lang_pred, score and n_words for every whole text.

    A null text or one without letters is `und` with score 0, as is every text if
    the model has no language. Equal shares go to the first language by name.
    Repeated rows give rows like others, an empty table none; columns other than
    doc_id and text play no part.
    """
    shared = _Shared(df.sparkSession, model)

    def run(batches):
        import pyarrow as pa

        score = _scorer(shared)
        langs = shared.model.value.langs
        for held in batches_of(arrow_rows(batches, "doc_id", "text"), chars):
            n = np.zeros(len(held), np.int64)
            best, top = np.zeros(len(held), np.int64), np.zeros(len(held))
            if langs:
                begin, end, of, m, _, _ = score([x[1] for x in held])
                n = np.bincount(of, minlength=len(held))
                mass = np.stack([np.bincount(of, m[:, k] * (end - begin), len(held)) for k in range(len(langs))], axis=1)
                best, top = mass.argmax(axis=1), mass.max(axis=1) / np.maximum(mass.sum(axis=1), 1e-12)
            names = [langs[b] if k else "und" for b, k in zip(best.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array(names), pa.array(np.where(n > 0, np.clip(top, 0, 1), 0.0)), pa.array(n, pa.int64())], names=["doc_id", "lang_pred", "score", "n_words"])

    return text_batches(df).select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long")


def keep_identified(df: DataFrame, model: Model, least_score: float, least_known: float = 0.0, chars: int = 1_000_000) -> DataFrame:
    """The rows of `df`, all columns, whose text is in a learned language; no shuffle.

    The language has at least `least_score` of the text, and knows at least
    `least_known` of the text's grams, however many languages there are.
    """
    shared = _Shared(df.sparkSession, model)
    at = df.columns.index("text")

    def run(batches):
        import pyarrow as pa

        score = _scorer(shared, evidence=True)
        langs = shared.model.value.langs
        for b in (x.slice(i, SLICE) for x in batches for i in range(0, x.num_rows, SLICE)):
            keep: list[bool] = []
            for held in batches_of(((x or "",) for x in b.column(at).to_pylist()), chars):
                if not langs:
                    keep += [False] * len(held)
                    continue
                begin, end, of, m, _, seen = score([x[0] for x in held])
                mass = np.stack([np.bincount(of, m[:, k] * (end - begin), len(held)) for k in range(len(langs))], axis=1)
                known = np.stack([np.bincount(of, seen[:, k], len(held)) for k in range(len(langs) + 1)], axis=1)
                own = known[np.arange(len(held)), mass.argmax(axis=1)]
                keep += ((mass.sum(axis=1) > 0) & (mass.max(axis=1) >= least_score * mass.sum(axis=1)) & (own >= least_known * known[:, -1])).tolist()
            yield b.filter(pa.array(keep, pa.bool_()))

    return text_batches(df).mapInArrow(run, df.schema)


def language_spans(df: DataFrame, model: Model, chars: int = 1_000_000) -> DataFrame:
    """The code-switched text's runs of one language: doc_id, start, end, lang, score (mean marginal of its words)."""
    shared = _Shared(df.sparkSession, model)

    def run(batches):
        import pyarrow as pa

        score = _scorer(shared)
        langs = shared.model.value.langs
        for held in batches_of(arrow_rows(batches, "doc_id", "text"), chars):
            begin, end, of, m, t, _ = score([x[1] for x in held])
            if not len(begin):
                continue
            k = m.argmax(axis=1)
            new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (of[1:] != of[:-1]))))
            last = np.append(new[1:], len(k)) - 1
            mean = np.add.reduceat(m.max(axis=1), new) / (last - new + 1)
            ids = pa.array([x[0] for x in held], pa.int64()).take(pa.array(of[new]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(begin[new] - t.starts[of[new]]), pa.array(end[last] - t.starts[of[new]]), pa.array([langs[i] for i in k[new]]), pa.array(mean)], names=["doc_id", "start", "end", "lang", "score"])

    return text_batches(df).select("doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, lang string, score double")


def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from documents whose crc32 remainder by 3 is not 1."""
    docs = read(spark, sf_dir, "documents")
    held_out = crc_remainder("doc_id", 3) == 1
    found = identify(docs, train_on(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_words")
