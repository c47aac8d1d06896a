import hashlib
import random

from mendery.llm.fingerprint import MultisetHash, edited, fingerprints, op6_multiset_fingerprints

SF = "/root/testdata/sf0.001"


def test_query_against_brute_force(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in op6_multiset_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, (doc_id, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        changed = edited(text, following)
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == MultisetHash(text).hex() and r.edited_fingerprint == MultisetHash(changed).hex()
        assert r.near_edited == MultisetHash(text).likeness(MultisetHash(changed))
        assert r.near_next == MultisetHash(text).likeness(MultisetHash(following))


def test_homomorphism_and_likeness():
    lines = [f"line {i}" for i in range(200)]
    shuffled = lines[:]
    random.Random(1).shuffle(shuffled)
    whole = MultisetHash("\n".join(lines))
    assert whole == MultisetHash("\n".join(shuffled))
    assert whole == MultisetHash("\n".join(lines[:70])) + MultisetHash("\n".join(lines[70:]))
    assert MultisetHash("\n".join(lines)).update(lines[:50], -1) == MultisetHash("\n".join(lines[50:]))
    assert MultisetHash("a\na") != MultisetHash("a") and MultisetHash("") != MultisetHash("\n")
    other = MultisetHash("\n".join(lines[:150] + [f"new {i}" for i in range(50)]))
    assert abs(whole.likeness(other) - 0.75) < 0.08
    assert whole.likeness(whole) == 1.0 and whole.likeness(MultisetHash("x")) < 0.1


def test_odd_rows(spark):
    data = [(None, "n", "x"), (1, None, "x"), (1, "same", "x"), (2, "", "x"), (3, "é\n" * 40000, "x"), (3, "é\n" * 40000, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, bucket string")
    out = fingerprints(df).collect()
    assert len(out) == 6
    same = [r for r in out if r.doc_id == 3]
    assert len({r.fingerprint for r in same}) == 1 and same[0].n_chars == 80000
    last = next(r for r in out if r.doc_id is None)
    assert last.n_chars == 1 and last.edited_sha256 == hashlib.sha256(b"n").hexdigest()
    assert max(r.near_next for r in same) == 1.0
    assert fingerprints(df.limit(0)).count() == 0
    lone = fingerprints(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).first()
    assert lone.near_next == 1.0 and lone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_likeness_of_very_many_paragraphs():
    for n, replaced in ((4500, 1500), (20_000, 2000), (20_000, 10_000), (300_000, 30_000)):
        lines = [f"line {i}" for i in range(n)]
        new = [f"new {i}" for i in range(replaced)]
        whole, other = MultisetHash("\n".join(lines)), MultisetHash("\n".join(lines[: n - replaced] + new))
        assert abs(whole.likeness(other) - (1 - replaced / n)) < 0.08, (n, replaced)
        assert whole.likeness(MultisetHash("\n".join(f"other {i}" for i in range(n)))) < 0.3
        assert MultisetHash("\n".join(lines)).update(lines[n - replaced :], -1).update(new) == other
        assert MultisetHash("\n".join(lines[:1000])) + MultisetHash("\n".join(lines[1000:])) == whole
