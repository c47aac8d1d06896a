import math
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mendery.llm import token_spans as module
from mendery.llm.token_spans import attribute, line_tokens, op7_token_attribution, token_spans

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def slow(begin, end, lo, hi, rule):
    counts, crossing = [0.0] * len(lo), [0] * len(lo)
    for a, b in zip(begin, end, strict=True):
        part = [(min(b, hi[s]) - max(a, lo[s]), s) for s in range(len(lo)) if min(b, hi[s]) > max(a, lo[s])]
        for n, s in part:
            crossing[s] += n < b - a
        if rule == "share":
            for n, s in part:
                counts[s] += n / (b - a)
        elif rule == "most" and part:
            counts[max(part, key=lambda x: (x[0], -x[1]))[1]] += 1
        elif rule == "start":
            for s in range(len(lo)):
                counts[s] += lo[s] <= a < hi[s]
    return counts, crossing


@pytest.mark.parametrize("rule", ["start", "most", "share"])
def test_interval_join_against_brute_force(rule):
    rnd = random.Random(4)
    for _ in range(400):
        n = rnd.randint(1, 40)
        begin, end, at = [], [], 0
        while at < n:
            size = rnd.randint(1, 6)
            for _ in range(rnd.choice([1, 1, 1, 2]) if size == 1 else 1):  # tokens that split one character
                begin.append(at)
                end.append(min(n, at + size))
            at += size
        cuts = sorted({0, n, *(rnd.randint(0, n) for _ in range(rnd.randint(0, 8)))})
        lo, hi = np.array(cuts[:-1] or [0]), np.array(cuts[1:] or [0])
        got, crossing = attribute(np.array(begin), np.array(end), lo, hi, rule)
        want, cross = slow(begin, end, lo, hi, rule)
        assert np.allclose(got, want) and crossing.tolist() == cross
        assert math.isclose(got.sum(), len(begin))


def test_spans_are_the_tokenizers_offsets():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(6)
    texts = ["".join(rnd.choices(["a", "the ", "é", "日本", "🙂", "\n", "\n\n", "  ", "12", "'s", "!"], k=rnd.randint(0, 30))) for _ in range(1000)]
    begin, end, counts = token_spans(texts, RANKS)
    at = 0
    for x, n in zip(texts, counts.tolist(), strict=True):
        e = tok.encode(x, add_special_tokens=False)
        assert n == len(e.ids)
        own = [(a, b) for a, b in zip(begin[at : at + n].tolist(), end[at : at + n].tolist(), strict=True)]
        for (a, b), piece in zip(own, e.tokens, strict=True):
            space = piece[0] == "Ġ" and len(piece) > 1
            assert (a, b) in e.offsets or space
        at += n


def test_each_distinct_token_is_decoded_once(monkeypatch):
    enc, calls = module._ranks(RANKS), []

    class Counting:
        def decode_single_token_bytes(self, i):
            calls.append(i)
            return enc.decode_single_token_bytes(i)

    monkeypatch.setattr(module, "_ranks", lambda path: Counting())
    pieces = ["zqxzqx", "zqx", "日本zqx", " zqxzqxzqx"]
    spans, counts = module._spans(RANKS)(pieces)
    assert len(calls) == len(set(calls)) < counts.sum() // 2
    ends = np.split(spans.reshape(-1, 2), np.cumsum(counts // 2)[:-1])
    assert [(int(x[0, 0]), int(x[-1, 1]) + 1) for x in ends] == [(0, len(p)) for p in pieces]


def test_query_sums_to_whole_documents(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = defaultdict(list)
    for r in op7_token_attribution(spark, SF).collect():
        by[r.doc_id].append(r)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(by) == len(docs)
    for d in docs:
        rows = sorted(by[d.doc_id], key=lambda r: r.section)
        n = len(tok.encode(d.text or "", add_special_tokens=False).ids)
        assert sum(r.n_tokens for r in rows) == n == rows[0].doc_tokens
        assert [d.text[r.start : r.end].rstrip("\n") for r in rows] == [x for x in d.text.split("\n")]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, "", 3), (2, "x\n\n\n y", 4), (2, "x\n\n\n y", 4)], "doc_id long, text string, start int")
    rows = line_tokens(df, RANKS, "share").collect()
    assert len(rows) == 3 + 8 and sum(r.n_tokens for r in rows if r.doc_id == 1) == 0
    assert line_tokens(df.limit(0), RANKS).count() == 0
    with pytest.raises(ValueError):
        line_tokens(df, RANKS, "other")
