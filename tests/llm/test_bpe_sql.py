import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from mendery.llm import bpe_sql
from mendery.llm.bpe_sql import SqlCodec, codec, encode_decode, op9_sql_bpe

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(b):
    return hashlib.sha256(b).hexdigest()


def test_query_against_the_library(spark):
    enc = library()
    got = {r.doc_id: r for r in op9_sql_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = enc.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == digest((d.text or "").encode())


def test_odd_texts():
    enc, own = library(), codec(RANKS)
    rnd = random.Random(2)
    parts = ["'", "'s", "'ve", "'LL", " ", "   ", "\n", "\r\n", "\t", "a", "xyz", "é", "12", "½", "!?", "…", "　", "日本", "🙂", "\0", "<|endoftext|>", "\x85", "\x1c"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(2000)]
    texts += ["", "z" * 401, "a" * 300, "!" * 5000, " " * 3000 + "x", "word " * 3000]
    ids, counts = own.encode(texts)
    assert own.decode(ids, counts) == [x.encode() for x in texts]
    for x, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == enc.encode_ordinary(x), x


def test_long_pieces_and_colliding_hashes():
    enc, own = library(), codec(RANKS)
    rnd = random.Random(3)
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    letters = "etaoinshrdluqzxjkbcdfgmpvwy"
    texts = [thue + " " + thue.translate(str.maketrans("ab", "ba")), thue]
    texts.append(" ".join("".join(rnd.choices(letters, k=30)) for _ in range(3000)))
    texts.append(" ".join("".join(chr(rnd.randint(0x4E00, 0x9FA5)) for _ in range(130)) for _ in range(200)))
    texts.append("a" * 50000 + "=" * 20000 + "-=" * 8000 + "".join(rnd.choices("ab", k=2000)))
    ids, counts = own.encode(texts)
    assert own.decode(ids, counts) == [x.encode() for x in texts]
    for x, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == enc.encode_ordinary(x)
    # more tokens than one decoding query takes
    ids, counts = own.encode(["plain words go on " * 200_000, "", "x"])
    assert own.decode(ids, counts) == [b"plain words go on " * 200_000, b"", b"x"]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, None), (2, "")], "doc_id long, text string").selectExpr("*", "'x' as pos", "1 as word")
    rows = encode_decode(df, RANKS).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 0, 2]
    assert {r.decoded_sha256 for r in rows if not r.n_tokens} == {digest(b"")}
    assert encode_decode(df.limit(0), RANKS).count() == 0


def test_words_take_few_steps():
    # a row stayed for 10.9 steps on average when each step took one rank of a word, and stays for 5.2 now
    enc, own = library(), codec(RANKS)
    rnd = random.Random(4)
    words = ["".join(rnd.choices("etaoinshrdlucm", k=30)) for _ in range(500)]
    ids, counts = own.encode_words(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [enc.encode_ordinary(x) for x in words]
    own.encode_words(words)  # leaves their bytes
    steps = bpe_sql._ENCODE[: bpe_sql._ENCODE.rindex("SELECT word, id FROM step")] + "SELECT avg(n) FROM step"
    assert own.con.sql(steps).fetchall()[0][0] < 8


def plain(word, ranks):
    """Pair by pair: the leftmost of minimum rank."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[x] for x in parts]


def test_ranks_in_any_order(tmp_path):
    # tokens of lower rank than their parts, as trained vocabularies have few of
    rnd = random.Random(5)
    for k in range(6):
        tokens = {bytes(rnd.choices(b"abc"[: 2 + k % 2], k=rnd.randint(2, 6))) for _ in range((20, 60, 200)[k % 3])} | {b"aa", b"ab"}
        tokens = [bytes([i]) for i in range(256)] + sorted(tokens)
        ids = rnd.sample(range(len(tokens)), len(tokens))
        file = tmp_path / f"{k}.tiktoken"
        file.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in zip(tokens, ids, strict=True)))
        ranks = dict(zip(tokens, ids, strict=True))
        words = ["".join(rnd.choices("abc", k=rnd.randint(1, (12, 60)[i % 2]))) for i in range(400)] + ["a" * 200, "ab" * 150, "abc" * 90]
        got, counts = SqlCodec(str(file)).encode_words(words)
        assert [x.tolist() for x in np.split(got, np.cumsum(counts)[:-1])] == [plain(w.encode(), ranks) for w in words]
