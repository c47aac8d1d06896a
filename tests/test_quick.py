"""The quick reader against the Reader, and how often a text is read."""

import random

from mendery import types as t
from mendery.kernel import loads, scan
from mendery.kernel.cascade import Options, decode
from mendery.kernel.loads import Reader, Unreadable, quick
from mendery.kernel.repair import repair

PARTS = ["{", "}", "[", "]", ",", ":", " ", "\n", "'a b'", '"c.d"', "''", "'é!'", "k", "key2", "true", "null", "True", "1", "-2.50", "007", "1,234", "/", "(", "'it's'", "a: 1,", "'b': 'x',", "c: [1, 2,],", "d: {e: 'f'},"]


def read(text):
    r = Reader(text)
    return r.value(), r.fixes


def test_quick_reads_what_the_reader_reads():
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(4 if depth else 2, 8)
        if kind < 3:
            return "{" + ", ".join(f"{rng.choice(['k', 'n_1', chr(39) + 'a b' + chr(39), chr(34) + 'é' + chr(34)])}{rng.choice([':', ' : '])}{value(depth - 1)}" for _ in range(rng.randrange(4))) + rng.choice(["", ",", " ,\n"]) + "}"
        if kind < 4 or kind == 7 and depth:
            return "[" + ",\n".join(value(depth - 1) for _ in range(rng.randrange(4))) + rng.choice(["", ","]) + "]"
        return rng.choice(["1", "-2.5", "0", "true", "null", "'x (y)'", '"z, no"', "'it'", '"é.!"', "12.00", "''", "True", "bare"])

    texts = [rng.choice(["", " ", "\n"]) + rng.choice(["{a: %s}", "[%s]", "{'b': %s,}"]) % value(3) + rng.choice(["", "\n"]) for _ in range(4000)]
    texts += ["{" + "".join(rng.choice(PARTS) for _ in range(rng.randrange(12))) + rng.choice(["}", ""]) for _ in range(20000)]
    texts += ["[" * n + "1" + "]" * n for n in (100, 119, 120, 121, 122, 300)] + ["[" + "{a: [1]}," * 200 + "]"]
    n = 0
    for x in texts:
        if got := quick(x):
            assert got == read(x) and repr(got) == repr(read(x)), x
            n += 1
    assert n > 2000
    assert quick("[" * 121 + "]" * 121) is None


def test_a_fitting_fence_is_read_once(monkeypatch):
    """the text around a fence whose value fits isn't read again, and simple structures aren't read character by character."""
    calls = []
    monkeypatch.setattr(scan, "structures", lambda text: calls.append(text) or [])
    monkeypatch.setattr(loads.Reader, "value", lambda *a, **k: calls.append(a) or (_ for _ in ()).throw(Unreadable("read slowly")))
    line = t.struct(number=t.number, quantity=t.number)
    r = decode("Lines:\n```json\n{'lines': [{number: 1, quantity: 2.50,},\n{number: 2, quantity: 3.00,}]}\n```", t.struct(lines=t.array(line)))
    assert r.value == {"lines": [{"number": 1.0, "quantity": 2.5}, {"number": 2.0, "quantity": 3.0}]}
    assert (r.strategy, r.fixes, calls) == ("extract", ["converted quotes", "quoted key", "removed trailing comma"], [])


def test_a_value_that_does_not_fit_is_coerced_once(monkeypatch):
    """strategies that read the same from a text don't try its value again."""
    from mendery.kernel import cascade

    calls = []
    real = cascade.coerce
    monkeypatch.setattr(cascade, "coerce", lambda n, *a: calls.append(n) or real(n, *a))
    spec = t.tagged("type", t.struct(type=t.literal("click"), v=t.number), t.struct(type=t.literal("view"), w=t.number))
    text = '{"Type": "ERROR", "w": 29.27,}'
    r = decode(text, spec, Options())
    assert not r.ok and r.error == "no tagged option fits" and len(calls) == 1
    assert repair(text) == '{"Type": "ERROR", "w": 29.27}'
    assert decode('{"Type": "VIEW", "w": 29.27,}', spec).value == {"type": "view", "w": 29.27}
