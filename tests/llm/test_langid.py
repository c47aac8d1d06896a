import itertools
import zlib

import numpy as np

from mendery.llm.crf import Crf, chains
from mendery.llm.langid import identify, language_spans, op1_crf_language, sample, train

SF = "/root/testdata/sf0.001"
EN = "the quick brown fox jumps over the lazy dog while some people watch from the other side of this river "
DE = "der schnelle braune fuchs springt ueber den faulen hund und viele leute schauen von der anderen seite zu "


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    for lengths in ([5, 3, 1, 4], [1], [6]):
        n = sum(lengths)
        crf = Crf(3)
        crf.trans, crf.start = rng.normal(size=(3, 3)), rng.normal(size=3)
        emit = rng.normal(size=(n, 3))
        starts, sizes = chains(np.array(lengths), 100)
        m, moves, begun = crf.marginals(emit, starts, sizes, pairs=True)
        want, want_moves = np.zeros((n, 3)), np.zeros((3, 3))
        for s, k in zip(starts, sizes, strict=True):
            paths = list(itertools.product(range(3), repeat=int(k)))
            w = np.array([np.exp(crf.start[p[0]] + sum(emit[s + i, y] for i, y in enumerate(p)) + sum(crf.trans[a, b] for a, b in itertools.pairwise(p))) for p in paths])
            w /= w.sum()
            for p, x in zip(paths, w, strict=True):
                for i, y in enumerate(p):
                    want[s + i, y] += x
                for a, b in itertools.pairwise(p):
                    want_moves[a, b] += x
        assert np.allclose(m, want) and np.allclose(moves, want_moves) and np.allclose(begun, want[starts].sum(axis=0))


def test_chains_cover_all_items():
    starts, lengths = chains(np.array([0, 5, 130, 64]), 64)
    assert starts.tolist() == [0, 5, 69, 133, 135] and lengths.tolist() == [5, 64, 64, 2, 64]


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in op1_crf_language(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    assert len(rows) == len(docs)
    for d in docs:
        assert rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1)
    held = [d for d in docs if rows[d.doc_id].held_out]
    assert sum(rows[d.doc_id].lang_pred == d.lang for d in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_code_switched_text_and_odd_rows(spark):
    model = train([("en", EN * 8), ("de", DE * 8)] * 3, steps=40)
    data = [(1, EN + DE, "x"), (2, None, "x"), (3, "", "x"), (4, "12 !! 34", "x"), (None, DE, "x"), (5, "the " * 60000, "x"), (5, "the " * 60000, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang_pred string")
    out = identify(df, model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 7 and [by[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and by[2].score == 0.0
    assert by[None].lang_pred == "de" and by[5].lang_pred == "en" and by[5].n_words == 60000
    spans = sorted((r.start, r.end, r.lang) for r in language_spans(df.filter("doc_id = 1"), model).collect())
    assert [s[2] for s in spans] == ["en", "de"] and abs(spans[1][0] - len(EN)) <= 12
    assert identify(df.limit(0), model).count() == 0
    none = train([])
    assert {r.lang_pred for r in identify(df, none).collect()} == {"und"}


def test_every_language_is_learned(spark):
    words = ["".join(chr(97 + (7 * i + 3 * j + i * j * k) % 26) for k in range(6)) for i in range(70) for j in range(5)]
    rows = [(10 * i + n, f"l{i:02}", " ".join(words[5 * i : 5 * i + 5] * 3)) for i in range(70) for n in range(3 - (i == 0))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = sample(df)
    assert sorted(got) == sorted((lang, text) for _, lang, text in rows)
    # the bound on rows is each language's own: many rows of one take nothing from another
    many = spark.createDataFrame([(i, "aa", "x") for i in range(2000)] + [(5000, "zz", "y")], "doc_id long, lang string, text string")
    few = [lang for lang, _ in sample(many, per_lang=20)]
    assert few.count("zz") == 1 and 1 <= few.count("aa") <= 40
    found = {r.doc_id: r.lang_pred for r in identify(df.filter("lang = 'l00'"), train(got, steps=8)).collect()}
    assert set(found.values()) == {"l00"}
