import random

import numpy as np
import pytest
from oracle import rows as both

from mendery.llm.components import connected, joined
from mendery.llm.jaccard_join import ORACLE_OP4, WORDS, agreed, components, frequency, least_overlap, loaded, merged, most_shared, op4_group_matrix_join, parities, prefix, shingle_sets, sketch, slack, stored

SF = "/root/testdata/sf0.001"


def words(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split(" ") if w]


def brute(docs, k, percent):
    sets = []
    for _, text in docs:
        w = words(text or "")
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and 100 * n >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted((str(d), len(s), str(least[find(i)])) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_query_equals_sql(spark):
    a, b = both(spark, op4_group_matrix_join, ORACLE_OP4)
    assert a == b and len({r[0] for r in a}) < len(a)


def near_copies(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.choice([3, 30, 90, 250]))] for _ in range(6)]
    for i in range(n):
        w = list(rnd.choice(bases)) if rnd.random() < 0.9 else [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.choice([0, 1, 1, 2, 4])):
            if w:
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        docs.append((i, rnd.choice([" ", "\n", "\t "]).join(w)))
    return docs


def test_hot_groups_and_pivots_against_brute_force(spark):
    for seed, k, percent in ((1, 3, 90), (2, 5, 80), (3, 2, 70)):
        docs = near_copies(seed, 260)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        out = components(df, k, percent, group_rows=4, hot_posting=5, frequent=6, most_frequent=50)
        assert got(out) == brute(docs, k, percent)


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(30000))
    docs = [(5, "A b c d"), (3, "a B\tc  d"), (3, "a b c d"), (9, None), (8, ""), (7, " \n"), (None, "a b c d"), (None, "lone"), (4, "x y"), (2, "X Y"), (1, "x"), (11, long), (10, long + " z"), (12, "a\x1cb c")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as node", "'q' as component_id", "2 as n")
    assert got(components(df, 3, 90)) == brute(docs, 3, 90)
    assert components(df.limit(0), 3, 90).count() == 0
    assert got(components(df.filter("doc_id = 9"), 3, 90)) == [("9", 0, "9")]


def test_prefixes_of_links_share_enough():
    rnd = random.Random(8)
    for _ in range(300):
        percent = rnd.choice([70, 80, 90])
        universe = [rnd.randrange(2**63) for _ in range(300)]
        a = set(rnd.sample(universe, rnd.randint(1, 250)))
        b = set(a)
        for _ in range(rnd.randint(0, 20)):
            b.discard(rnd.choice(universe))
            b.add(rnd.choice(universe))
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        keys = np.unique(np.array([(((u >> 32) * 8) >> 32) << 32 | (u & 0xFFFFFFFF) for u in rnd.sample(universe, 120)], np.uint64))
        counts = np.array([rnd.randint(9, 99) for _ in keys])
        n = len(a & b)
        if 100 * n >= percent * len(a | b):
            px, py = (set(prefix(s, frequency(s, keys, counts, 8), percent).tolist()) for s in (x, y))
            assert len(px & py) >= min(slack(len(x)), slack(len(y)))
            assert n >= max(least_overlap(len(x), percent), least_overlap(len(y), percent))


def test_shingles():
    a, b, c = shingle_sets(["a b c a b c", "A  B\nC a b c", "a b"], 3)
    assert a.tolist() == b.tolist() and len(a) == 3 and len(c) == 1
    assert shingle_sets(["", " "], 3)[0].tolist() == []
    assert shingle_sets(["a b"], 3)[0].tolist() != shingle_sets(["b a"], 3)[0].tolist()


def test_connected(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(200, 200)]
    found = {r.node: r.label for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert all(found.get(x, x) == r for x, r in root.items())


def test_connected_is_settled_or_fails(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    with pytest.raises(RuntimeError, match="settled"):
        connected(chain, most_rounds=2)
    assert {(r.node, r.label) for r in connected(chain).collect()} == {(i, 0) for i in range(301)}


def test_sketches_bound_overlaps():
    rng = np.random.default_rng(2)
    for n in (3, 500, 3000, 40000, 70000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 2**63, 2 * n, dtype=np.uint64))))
        c = rng.integers(0, 2**63, 700, dtype=np.uint64)
        x, y = loaded(stored(sketch(a))), loaded(stored(merged([sketch(b), sketch(np.unique(c))])))
        assert most_shared(x, y) >= len(np.intersect1d(a, b)) and most_shared(x, x) == len(a)


def test_odd_ranges_bound_differences():
    rng = np.random.default_rng(4)
    bits = lambda x: int(np.unpackbits(x.view(np.uint8)).sum())
    for n in (1, 40, 150, 2000):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        edited = lambda k: np.unique(np.concatenate((base[min(k, n) :], rng.integers(0, 2**64, k, dtype=np.uint64))))
        left, right = ([edited(int(k)) for k in rng.integers(0, 30, size)] for size in (3, 2))
        for a, b in ((left, right), (left[:1], right[:1])):
            x, y = (agreed([parities(s) for s in sets]) for sets in (a, b))
            found = bits((x[:WORDS] & y[WORDS:]) | (x[WORDS:] & y[:WORDS]))
            assert found <= min(len(np.setxor1d(s, t)) for s in a for t in b)
    # copies with twice as many edits as a link allows are told apart, though they share most of their frequent tokens
    a, b = (agreed([parities(np.concatenate((base[k : k + 150], rng.integers(0, 2**64, 20, dtype=np.uint64))))]) for k in (0, 40))
    assert 180 * bits((a[:WORDS] & b[WORDS:]) | (a[WORDS:] & b[:WORDS])) > 20 * 2 * 170


def test_edited_copies_of_one_text_against_brute_force(spark):
    rnd = random.Random(12)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for i in range(140):
        w = list(base)
        for at in rnd.sample(range(150), rnd.choice([1, 2, 2, 3, 4])):
            w[at] = f"x{rnd.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(components(df, 5, 80, group_rows=4, hot_posting=5, frequent=6)) == brute(docs, 5, 80)


def test_joined_labels_are_those_of_all_edges(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(240)]
    frames = [spark.createDataFrame(x, "u long, v long") for x in (edges[:100], edges[100:101], edges[101:], [])]
    labels = None
    for x in frames:
        labels = joined(labels, x)
    assert sorted(labels.collect()) == sorted(connected(spark.createDataFrame([e for e in edges if e[0] != e[1]], "u long, v long")).collect())


def test_mixed_groups_make_few_rows(spark, monkeypatch):
    """Copies that are too far apart for a link and share their smallest hashes, so that groups hold members of many components."""
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    # the words of the three smallest shingles stay, so all copies have them unless a new shingle is smaller
    s, order = shingle_sets([" ".join(base)], 5)[0], [shingle_sets([" ".join(base[i : i + 5])], 5)[0][0] for i in range(116)]
    stays = {i + j for i in (order.index(x) for x in s[:3]) for j in range(5)}
    docs = []
    for i in range(160):
        w = list(base)
        for at in rnd.sample([x for x in range(120) if x not in stays], rnd.choice([1, 2, 6, 9])):
            w[at] = f"x{rnd.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    made, group = [], type(df).groupBy

    def counted(self, *cols):
        if [c for c in cols[:2] if isinstance(c, str)] == ["a", "b"]:
            made.append(self.count())
        return group(self, *cols)

    monkeypatch.setattr(type(df), "groupBy", counted)
    out = got(components(df, 5, 80, group_rows=16, hot_posting=5, frequent=6))
    assert out == brute(docs, 5, 80)
    # the rows that the joins of tokens make
    assert max(made) < 500, made


def test_edges_at_once_or_in_rounds(spark):
    rnd = random.Random(10)
    edges = [(-i, -i - 1) for i in range(200, 260)] + [(rnd.randrange(-300, 300), rnd.randrange(300)) for _ in range(300)] + [(7, 7)]
    frames = [spark.createDataFrame(x, "u long, v long") for x in (edges[:150], edges[150:], [])]
    results = []
    for most in (1000, 0):
        labels = None
        for x in frames:
            labels = joined(labels, x, most)
        results.append(sorted(labels.collect()))
    assert results[0] == results[1] == sorted(connected(spark.createDataFrame(edges, "u long, v long")).collect())
