"""Token counts of a text's sections from one encoding of the whole text.

Each document is encoded once, whole. Its tokens' character spans come from the
bytes that each token stands for, mapped back to characters: a token covers the
characters in which its bytes lie, so tokens that split a character both cover
it. Sections are a document's lines, each with its line break, or spans that the
caller gives. Both are sorted, so an interval join is two binary searches for
each section: the first token that reaches it and the last that starts in it.

A token that crosses a boundary goes by one explicit rule:
`start` to the section of its first character, `most` to the section with most
of its characters (the earlier one if equal), `share` to each in proportion.
The sections' counts sum up to the document's tokens under each rule, as far as
sections cover the text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery.llm.common import arrow_rows, batches_of, only, read, text_batches
from mendery.llm.textvec import PieceCache, Texts, _ranks, encode_pieces

RULES = ("start", "most", "share")


def _spans(path: str):
    """For PieceCache: each token of a piece as two numbers, its first and last character's place in the piece."""
    ids_of = encode_pieces(path)

    def compute(pieces: list[str]):
        ids, counts = ids_of(pieces)
        enc = _ranks(path)
        known, back = np.unique(ids, return_inverse=True)
        sizes = np.array([len(enc.decode_single_token_bytes(i)) for i in known.tolist()], np.int64)[back]
        ends = np.cumsum(sizes)
        raw = np.frombuffer("".join(pieces).encode("utf-8", "replace"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # byte -> character
        base = np.repeat(np.cumsum([0, *map(len, pieces)])[:-1], counts)
        out = np.stack((char[ends - sizes] - base, char[ends - 1] - base), axis=1).astype(np.int32)
        return out.ravel(), counts * 2

    return compute


def _cache(path: str) -> PieceCache:
    return only(("spans", path), lambda: PieceCache(_spans(path)))


def token_spans(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end (exclusive) character offsets of all texts' tokens, each from its text's start, and their numbers."""
    t = Texts(texts)
    begin, end, of = t.matches()
    if not len(begin):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    cache = _cache(path)
    rows = cache.rows(t, begin, end)
    tokens = cache.count[rows] // 2
    flat = cache.gather(rows).reshape(-1, 2).astype(np.int64)
    base = np.repeat(begin - t.starts[of], tokens)
    return flat[:, 0] + base, flat[:, 1] + base + 1, np.bincount(of, tokens, len(texts)).astype(np.int64)


def attribute(begin: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section [lo, hi) by the rule, and how many tokens cross into or out of it.

    Tokens are in order; sections are in order and don't overlap. An empty section
    has no tokens.
    """
    # begins and ends of tokens both never fall, even where tokens split a character
    first = np.searchsorted(end, lo, "right")
    last = np.searchsorted(begin, hi, "left")
    some = (last > first) & (hi > lo)
    first, last = np.where(some, first, 0), np.where(some, last, 0)
    at = lambda a, i: a[np.minimum(i, len(a) - 1)] if len(a) else np.zeros(len(i), np.int64)
    left = np.where(some, np.searchsorted(begin, lo, "left") - first, 0)  # started before, reach in
    right = np.where(some, last - np.searchsorted(end, hi, "right"), 0)  # start within, reach out
    over = some & (at(begin, first) < lo) & (at(end, first) > hi)  # one token covers the section and more
    crossing = left + right - (over & (left == right) & (last - first == left))
    if rule == "start":
        return (np.where(some, last - first, 0) - left).astype(np.float64), crossing
    counts = np.zeros(len(lo))
    # tokens wholly within one section count there; the few others are taken one by one
    inside = np.searchsorted(lo, begin, "right") - 1
    whole = (inside >= 0) & (end <= hi[np.maximum(inside, 0)]) if len(lo) else np.zeros(len(begin), bool)
    counts += np.bincount(inside[whole], minlength=len(lo)) if len(lo) else 0
    for k in np.flatnonzero(~whole).tolist():
        a, b = int(begin[k]), int(end[k])
        near = range(max(int(np.searchsorted(hi, a, "right")), 0), int(np.searchsorted(lo, b, "left")))
        part = [(min(b, int(hi[s])) - max(a, int(lo[s])), s) for s in near if min(b, int(hi[s])) > max(a, int(lo[s]))]
        if part and rule == "most":
            counts[max(part, key=lambda x: (x[0], -x[1]))[1]] += 1
        else:
            for n, s in part:
                counts[s] += n / (b - a)
    return counts, crossing


_SCHEMA = "doc_id long, section int, start long, end long, n_tokens double, n_crossing long, doc_tokens long"


def line_tokens(df: DataFrame, path: str, rule: str = "start", chars: int = 1_000_000) -> DataFrame:
    """A row for each line of each whole text: its span, tokens by `rule`, crossing tokens, and the document's tokens.

    A null or empty text has one empty line without tokens. Repeated rows give
    rows like others, an empty table none; other columns play no part.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches):
        import pyarrow as pa

        for held in batches_of(arrow_rows(batches, "doc_id", "text"), chars):
            texts = [x[1] for x in held]
            begin, end, counts = token_spans(texts, path)
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            at, n_lines = 0, []
            for text, n in zip(texts, counts.tolist(), strict=True):
                sizes = np.fromiter((len(x) + 1 for x in text.split("\n")), np.int64)
                sizes[-1] -= 1
                hi = np.cumsum(sizes)
                lo = hi - sizes
                got, crossing = attribute(begin[at : at + n], end[at : at + n], lo, hi, rule)
                for c, v in zip(cols, (np.arange(len(lo), dtype=np.int32), lo, hi, got, crossing, np.full(len(lo), n)), strict=True):
                    c.append(v)
                n_lines.append(len(lo))
                at += n
            ids = pa.array([x[0] for x in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), n_lines)))
            types = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.concatenate(c), t) for c, t in zip(cols, types, strict=True)]], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return text_batches(df).select("doc_id", "text").mapInArrow(run, _SCHEMA)


def op7_token_attribution(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Tokens of every line of every document; a crossing token counts where it starts."""
    import public_tokenizers

    rows = line_tokens(read(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return rows.withColumn("n_tokens", F.col("n_tokens").cast("long"))
