"""Decoding of single texts: what the survey's fixtures expect."""

import json

import pytest

from mendery import types as t
from mendery.kernel.cascade import Options, decode
from mendery.kernel.loads import dedent, lenient, plain, strict
from mendery.kernel.repair import repair

FENCE = "```"
ONE_TWO = t.enum("ONE", "TWO")
CODE = t.struct(type=t.literal("code"), code=t.string)
KEY = t.struct(key=t.string)
NUMS = t.struct(key=t.array(t.number))


def any_json():
    return t.union(t.number, t.boolean, t.string, t.null, t.array(t.Lazy("any", any_json)), t.mapping(t.Lazy("any", any_json)))


GOOD = [
    # numbers
    ("12,111", t.number, 12111), ("12.11.", t.number, 12.11), ("1/5", t.number, 0.2), ("$1,234.56", t.number, 1234.56),
    ("1 cup of butter, soft", t.number, 1), ("-7.5e2", t.number, -750), ("about 42 of them", t.number, 42), ('"3"', t.number, 3),
    # booleans
    ("The answer is True", t.boolean, True), ("Answer: **False**", t.boolean, False), ("true", t.boolean, True),
    # strings are the text itself
    ('"quoted"', t.string, '"quoted"'), ("null", t.string.nullable(), None), ("None", t.string.nullable(), "None"), ('{" a ": 1}', t.string, '{" a ": 1}'),
    # arrays
    ("[1, 2, 3,]", t.array(t.number), [1, 2, 3]), ("[1, 2, 3", t.array(t.number), [1, 2, 3]), ("[1234, 5678", t.array(t.number), [1234, 5678]),
    ("[1, 2, 3]", t.array(t.string), ["1", "2", "3"]), ('[1, 2.5, "3"]', t.array(t.number), [1, 2.5, 3]), ("42", t.array(t.number), [42]),
    ('[""a"", ""b""]', t.array(t.string), ['"a"', '"b"']), ("[a, b] is the output.", t.array(t.string), ["a", "b"]),
    ("[hello, 'world', test]", t.array(t.string), ["hello", "world", "test"]), ("[]", t.array(t.string), []),
    ("The answer is true", t.array(t.boolean), [True]), ("[[1, 2], [3, 4]]", t.array(t.array(t.number)), [[1, 2], [3, 4]]),
    ("first [1, 2] then [3, 4]", t.array(t.number), [1, 2]), ('[1, "x", 3]', t.array(t.number), [1, 3]),
    # objects
    (' { "key" : [ 1 , 2 , 3 ] } ', NUMS, {"key": [1, 2, 3]}), ("prefix {\"key\": [1]} suffix", NUMS, {"key": [1]}),
    ('{"key": "a"} {"key": "b"}', KEY, {"key": "a"}), ('x {"key": "a"} y {"key": "b"} z', t.array(KEY), [{"key": "a"}, {"key": "b"}]),
    ('{"key": "value",}', KEY, {"key": "value"}), ('{"key": [1, 2', NUMS, {"key": [1, 2]}), ('{"key": "val', KEY, {"key": "val"}),
    ("{key: value with space}", KEY, {"key": "value with space"}), ('{" key ": "x"}', KEY, {"key": "x"}), ('{"KEY": "x"}', KEY, {"key": "x"}),
    ('{"foo": "["bar"]"}', t.struct(foo=t.string), {"foo": '["bar"]'}), ('{"foo": "{"foo": ["bar"]}"}', t.struct(foo=t.string), {"foo": '{"foo": ["bar"]}'}),
    ('{ a: "she said "hi", and also "bye"", "b": ok }', t.struct(a=t.string, b=t.string), {"a": 'she said "hi", and also "bye"', "b": "ok"}),
    ("{\n a: Hi friends!,\n b: one line\n and another,\n res: [hello,\n world]\n}", t.struct(a=t.string, b=t.string, res=t.array(t.string)), {"a": "Hi friends!", "b": "one line\n and another", "res": ["hello", "world"]}),
    ('{"a": ""}', t.struct(a=t.string), {"a": ""}), ("{}", t.struct(foo=t.string.optional()), {"foo": None}),
    ('{"v": -2,000.00, "w": 1}', t.struct(v=t.number, w=t.number), {"v": -2000, "w": 1}),
    ('{"v": 1, // note\n /* more */ "w": 2}', t.struct(v=t.number, w=t.number), {"v": 1, "w": 2}),
    ("1214", t.struct(foo=t.number), {"foo": 1214}), (" true ", t.struct(foo=t.union(t.number, t.boolean)), {"foo": True}),
    ('{"order-key": 1, "Order Status": "x"}', t.struct(order_key=t.number, orderStatus=t.string), {"order_key": 1, "orderStatus": "x"}),
    ('{"desc": "x"}', t.struct(description=t.string), {"description": "x"}), ('{"popularity": 3}', t.struct(score=t.alias(t.number, "popularity")), {"score": 3}),
    ('{"foo": "{\\"a\\": 1}"}', t.struct(foo=t.struct(a=t.number)), {"foo": {"a": 1}}), ('{"v": 1, "v": 2}', t.struct(v=t.array(t.number)), {"v": [1, 2]}),
    ('{"v": 1, "v": 2}', t.struct(v=t.number), {"v": 2}), ('{"extra": 1, "key": "a"}', KEY, {"key": "a"}),
    (f"Here:\n{FENCE}json\n{{\"key\": \"a\"}}\n{FENCE}\nBye {{not}} this", KEY, {"key": "a"}), (f"{FENCE}json\n{{\"key\": \"a\"", KEY, {"key": "a"}),
    ("don't worry: {'key': 'it''s'}", KEY, {"key": "it''s"}), ("<style>p{margin:0}</style>", t.struct(margin=t.number), {"margin": 0}),
    # code and quotes
    ("{\"type\": \"code\", \"code\": `print(\"hi\")`}", CODE, {"type": "code", "code": 'print("hi")'}),
    ("{\"type\": \"code\", \"code\": 'print(\"hi\")'}", CODE, {"type": "code", "code": 'print("hi")'}),
    ('{"type": "code", "code": """print("hi")"""}', CODE, {"type": "code", "code": 'print("hi")'}),
    ('{\n "code": """\n"Hello"\n"""\n "type": "code",\n}', CODE, {"type": "code", "code": '"Hello"'}),
    ('{"code": """\n    def f():\n      x\n  """, "type": "code"}', CODE, {"type": "code", "code": "def f():\n  x"}),
    ('{"type": "code", "code": "print(\\"a\nb\\")"}', CODE, {"type": "code", "code": 'print("a\nb")'}),
    ('{"type": "code", "code": "print("Hello, world!")"}', CODE, {"type": "code", "code": 'print("Hello, world!")'}),
    ("{\"type\": \"code\", \"code\": 'print('Hello, world!')'}", CODE, {"type": "code", "code": "print('Hello, world!')"}),
    ("{\"type\": \"code\", \"code\": `log(`Hello`)`}", CODE, {"type": "code", "code": "log(`Hello`)"}),
    # maps
    ('{""a"": ""b""}', t.mapping(t.string), {'"a"': '"b"'}), ('{"a\n ": "b"}', t.mapping(t.string), {"a\n ": "b"}),
    ('{5: "b", 2.17: "e", null: "n"}', t.mapping(t.string), {"5": "b", "2.17": "e", "null": "n"}), ("{a: b} is the output.", t.mapping(t.string), {"a": "b"}),
    ('{"A": "one"}', t.mapping(t.enum("A", "B"), t.string), {"A": "one"}), ('{first: {"a": 1, "b": x}}', t.mapping(t.struct(a=t.number, b=t.string)), {"first": {"a": 1, "b": "x"}}),
    ("plain prose", t.mapping(t.string), {}), ('{"a": {"b": "c", "d":', t.mapping(t.mapping(t.string.optional())), {"a": {"b": "c", "d": None}}),
    # enums
    ("two", ONE_TWO, "TWO"), ('"TWO"', ONE_TWO, "TWO"), ('["TWO", "THREE"]', ONE_TWO, "TWO"), ("**one** is the answer", ONE_TWO, "ONE"),
    ('"ONE: the description"', ONE_TWO, "ONE"), ('"TWO" is one of the answers.', ONE_TWO, "TWO"), ("k1", t.enum("ONE", aliases={"k1": "ONE"}), "ONE"),
    (f"such as 1040-X or 1040.\n{FENCE}json\nnull\n{FENCE}", t.enum("1040", "1040-X").optional(), None), ("Class: SPAM\nit is spam", t.enum("SPAM", "NOT_SPAM"), "SPAM"),
    # literals
    ('"Two" is the answer', t.literal("TWO"), "TWO"), ('"TWO!@#"', t.literal("TWO"), "TWO"), ('"  TWO  "', t.literal("TWO"), "TWO"), ("Déjà vu", t.literal("deja vu"), "deja vu"),
    ("2", t.union(t.literal(2), t.literal(3)), 2), ("TWO or THREE", t.union(t.literal("TWO"), t.literal("THREE")), "TWO"),
    ('{"status": 1}', t.union(t.literal(1), t.literal(True), t.literal("THREE")), 1), ('{"result": true}', t.union(t.literal(1), t.literal(True), t.literal("THREE")), True),
    ('{"value": "The answer is THREE"}', t.union(t.literal(1), t.literal(True), t.literal("THREE")), "THREE"), ('\n "pay"\n', t.union(t.literal("pay"), t.literal("pay_later")), "pay"),
    # unions
    ('{"hi": ["a"]}', t.union(t.struct(hi=t.array(t.string)), t.struct(foo=t.string)), {"hi": ["a"]}),
    (f"{FENCE}json\n{{\"cat\": \"E\", \"item\": \"28C\", \"data\": null}}\n{FENCE}", t.union(t.struct(cat=t.enum("A")), t.struct(cat=t.enum("C"), item=t.number), t.struct(cat=t.enum("E"), item=t.union(t.number, t.string), data=t.number.optional())), {"cat": "E", "item": "28C", "data": None}),
    ("1 cup of butter", t.union(t.number, t.string), "1 cup of butter"), ('"hello"', t.union(t.string, t.number), '"hello"'), ("42", t.union(t.string, t.number), 42),
    ("null", t.union(t.string, t.null), None), ("[1, 2]", t.union(t.array(t.string), t.array(t.number)), [1, 2]), ("C", t.union(t.enum("A"), t.enum("C")), "C"),
    ('[{"x": 1}, {"y": "s"}]', t.array(t.struct(sel=t.union(t.struct(x=t.number), t.struct(y=t.string)))), [{"sel": {"x": 1}}, {"sel": {"y": "s"}}]),
    ('{"type": "b", "v": 2}', t.tagged("type", t.struct(type=t.literal("a"), s=t.string), t.struct(type=t.literal("b"), v=t.number)), {"type": "b", "v": 2}),
    ('so {"Type": "B", "v": 2} it is', t.tagged("type", t.struct(type=t.literal("a"), s=t.string), t.struct(type=t.literal("b"), v=t.number)), {"type": "b", "v": 2}),
    ('{"a": [1, {"b": null}], "c": {"d": true}}', any_json(), {"a": [1, {"b": None}], "c": {"d": True}}),
]

BAD = [
    ("true or false", t.boolean), ("nothing", t.number), ("both ONE and TWO", ONE_TWO), ('"Two" is one of them', ONE_TWO), ('"ONE - is it, not TWO"', ONE_TWO),
    ("not car or car-2!", t.enum("A", "B")), ("2 or 3", t.union(t.literal(2), t.literal(3))), ('\n "pay\n', t.union(t.literal("pay"), t.literal("pay_later"))),
    ('{"a": 1, "b": 2}', t.union(t.literal(1), t.literal("x"))), ('{"a": [1]}', t.union(t.literal(1), t.literal("x"))), ('{"other": 1, "x": 2}', t.struct(a=t.string, b=t.string)),
    ('{"age": 12}', t.struct(age=t.number.require("small", lambda x: x < 10))), ("12", t.number.require("small", lambda x: x < 10)), ('["x", "y"]', t.array(t.number)),
    ('{"C": "x"}', t.mapping(t.enum("A"), t.string)),
]


@pytest.mark.parametrize("text, spec, want", GOOD, ids=range(len(GOOD)))
def test_decodes(text, spec, want):
    got = decode(text, spec)
    assert got.ok, got.error
    assert got.value == want


@pytest.mark.parametrize("text, spec", BAD, ids=range(len(BAD)))
def test_refuses(text, spec):
    got = decode(text, spec)
    assert not got.ok and got.error, got.value


def test_constraints():
    small, big = t.struct(bar=t.number.require("small", lambda x: x < 10)), t.struct(bar=t.number.require("big", lambda x: x > 20))
    either = t.struct(bar=t.union(small, big), things=t.array(t.union(small, big)).require("few", lambda v: len(v) < 4))
    assert decode('{"bar": 5, "things": []}', either).value == {"bar": {"bar": 5}, "things": []}
    assert not decode('{"bar": 15, "things": []}', either).ok
    assert decode('{"bar": 1, "things": [{"bar": 25}, {"bar": 35}, {"bar": 15}, {"bar": 15}]}', either).value["things"] == [{"bar": 25}, {"bar": 35}]
    soft = t.struct(age=t.number.check("grown", lambda x: x >= 18), name=t.string.check("named", bool))
    got = decode('{"age": 3, "name": "Ann"}', soft)
    assert got.ok and got.checks == {"grown": False, "named": True}
    block = t.struct(foo=t.number).require("positive", lambda v: v["foo"] > 0)
    assert decode('{"foo": 1}', block).ok and not decode('{"foo": -1}', block).ok
    hello = t.struct(foo=t.mapping(t.number).require("ten", lambda m: m.get("hello") == 10))
    assert decode('{"foo": {"hello": 10}}', hello).ok and not decode('{"foo": {"hello": 11}}', hello).ok


def test_partial_values():
    simple = t.struct(name=t.string, value=t.number, items=t.array(t.string))
    on = Options(allow_partial=True)
    assert decode('{"name": "test", "value": 42, "items": ["one", "two"', simple, on).value == {"name": "test", "value": 42, "items": ["one", "two"]}
    assert decode('{"name": "not ended', simple, on).value == {"name": "not ended", "value": 0, "items": []}
    graph = t.struct(vertices=t.array(t.struct(id=t.string.nullable(), metadata=t.mapping(t.string))), edges=t.array(t.struct(source=t.string)))
    cut = FENCE + 'json\n{"vertices": [{"id": "s", "metadata": {"name": "S"}}, {"id":'
    want = {"vertices": [{"id": "s", "metadata": {"name": "S"}}, {"id": None, "metadata": {}}], "edges": []}
    assert decode(cut, graph, on).value == want
    assert decode(cut, t.union(graph, t.struct(code=t.number, message=t.string)), on).value == want
    assert not decode('{"name": "x"}', simple, on).ok


def test_cut_off_tails():
    nums, drop = t.struct(nums=t.array(t.number)), Options(incomplete_tail="drop")
    assert decode("{'nums': [1,2", nums).value == {"nums": [1, 2]}
    assert decode("{'nums': [1,2", nums, drop).value == {"nums": [1]}
    matrix = t.struct(matrix=t.array(t.array(t.number)))
    assert decode('{"matrix": [[1, 2], [3, 4], [5, 6', matrix, drop).value == {"matrix": [[1, 2], [3, 4]]}
    items = t.struct(items=t.array(t.struct(id=t.number, name=t.string)))
    assert decode('{"items": [{"id": 1, "name": "first"}, {"id": 2, "name": "sec"', items, drop).value == {"items": [{"id": 1, "name": "first"}]}


def test_states_and_directives():
    spec = t.struct(nums=t.State(t.array(t.number)), bar=t.State(t.number.nullable()))
    assert decode("{'nums': [1,2", spec, Options(incomplete_tail="drop")).value == {"nums": {"value": [1], "state": "Incomplete"}, "bar": {"value": None, "state": "Pending"}}
    done = t.struct(a=t.alias(t.string.nullable(), done=True), b=t.string.optional())
    assert decode('{"b": "x", "a": "ab', done, Options(allow_partial=True)).value == {"a": None, "b": "x"}
    assert not decode('{"a": null}', t.struct(a=t.alias(t.string.nullable(), not_null=True))).ok


def test_options_gate_strategies():
    assert not decode('so {"key": "a"}', KEY, Options(allow_extract=False, allow_fixes=False, allow_as_string=False)).ok
    assert not decode("[1, 2,]", t.array(t.number), Options(allow_extract=False, allow_fixes=False, allow_as_string=False)).ok
    assert decode("[1, 2,]", t.array(t.number), Options(allow_extract=False)).strategy == "repair"
    assert decode('{"key": "a"}', KEY).strategy == "json"
    got = decode("{key: 'a',}", KEY)
    assert {"quoted key", "removed trailing comma", "converted quotes"} <= set(got.fixes)


def test_depth_and_junk():
    node, spec = "1", any_json()
    for _ in range(60):
        node = '{"a": ' + node + "}"
    assert decode(node, spec).ok
    assert not decode("[" * 5000, t.array(t.number), Options(allow_as_string=False)).ok
    for junk in ("", " ", "{", "}", "[", "]", '"', "'", "`", ":", ",", "{:}", "{,}", "[,]", '{"a"', "{a", "{a:", '{"a":,}', "\\", '{"a": "\\', "/*", "//", "{'a': [1}", "[1}", "{]", "\0", "{{{{", "[{]}"):
        for spec in (KEY, t.array(t.number), t.mapping(t.string), t.number, any_json(), t.union(t.string, t.number)):
            decode(junk, spec)
            decode(junk, spec, Options(allow_partial=True, incomplete_tail="drop"))


def test_repair_leaves_strings_alone():
    assert json.loads(repair('{"a": "x, ] 1,000", "b": 1,000, }')) == {"a": "x, ] 1,000", "b": 1000}
    assert json.loads(repair('[1, [2, {"a": "b')) == [1, [2, {"a": "b"}]]
    assert dedent("\n  a\n    b\n") == "a\n  b"
    assert plain(lenient('{"a": "\\u00e9\\ud83d\\ude42"}')[0]) == plain(strict('{"a": "\\u00e9\\ud83d\\ude42"}')) == {"a": "é🙂"}


def test_every_broken_constraint_is_reported():
    small = t.number.require("small", lambda x: x < 10)
    spec = t.struct(a=small, b=t.string.require("named", lambda s: len(s) > 0), c=t.struct(d=small.require("even", lambda x: x % 2 == 0), e=small), f=t.number)
    text = '{"a": %d, "b": "%s", "c": {"d": %d, "e": %d}%s}'
    assert decode(text % (1, "x", 2, 3, ', "f": 1'), spec).ok
    r = decode(text % (11, "", 13, 12, ', "f": 1'), spec)
    assert not r.ok and r.error == "a: constraint small fails; b: constraint named fails; c: d: constraint small fails; c: d: constraint even fails; c: e: constraint small fails"
    assert decode(text % (11, "x", 2, 3, ', "f": 1'), spec).error == "a: constraint small fails"
    assert decode(text % (11, "x", 2, 3, ""), spec).error == "a: constraint small fails; f is missing"
    many = t.struct(**{f"field_{i}": t.number.require(f"positive_{i}", lambda x: x > 0) for i in range(60)})
    assert all(f"positive_{i} " in decode("{" + ", ".join(f'"field_{i}": -1' for i in range(60)) + "}", many).error for i in range(60))
    # soft checks of an option that fails leave no trace
    loose = t.struct(x=small, y=t.number.check("soft", lambda x: False))
    r = decode('{"x": 50, "y": 1}', t.union(loose, t.struct(x=t.number, y=t.number)))
    assert r.ok and r.checks == {}
