"""Nodes into target types: coercion, unions by score, constraints, partial values."""

from __future__ import annotations

import functools
import json
import math
import re
from dataclasses import dataclass, field
from typing import Any

from mendery.kernel import scalars as S
from mendery.kernel.loads import Node, Unreadable, lenient, plain, strict
from mendery.kernel.scalars import Ambiguous, Bad, Broken
from mendery.types import Array, Bool, Check, Enum, Field, Lazy, Literal, Map, Null, Nullable, Number, Optional, Spec, State, String, Struct, Tagged, Union, core

#: Other names of common fields: fixed values.
FIELD_NAMES = {
    "signature": ("function_signature", "func_signature", "method_signature"),
    "description": ("desc", "details", "summary"),
    "properties": ("props", "attributes", "fields"),
}

MISSING = object()
MAX_DEPTH = 200


@dataclass
class Context:
    """What a decode is allowed and what it reports. `raw` is the text that a whole value came from."""

    partial: bool = False
    fabricate: bool = False
    signed: bool = False
    raw: str | None = None
    checks: dict[str, bool] = field(default_factory=dict)
    # (node, type) pairs being coerced, how many of each node, and what unions made of nodes
    active: set[tuple[int, int]] = field(default_factory=set)
    within: dict[int, int] = field(default_factory=dict)
    memo: dict[tuple[int, int], tuple] = field(default_factory=dict)
    targets: dict[str, Spec] = field(default_factory=dict)

    def target(self, spec: Lazy) -> Spec:
        """The type that a lazy one stands for, the same object each time."""
        if spec.name not in self.targets:
            self.targets[spec.name] = spec.get()
        return self.targets[spec.name]


def js_number(x: float) -> str:
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e21:
        x = int(x)
    return str(x) if isinstance(x, int) else repr(x)


def js_text(n: Node) -> str:
    """A node as text: scalars bare, arrays as JSON, objects as {k: v}."""
    if n.kind == "str":
        return n.value
    if n.kind == "num":
        return js_number(n.value)
    if n.kind in ("bool", "null"):
        return json.dumps(n.value)
    if n.kind == "arr":
        return compact(plain(n))
    return "{" + ", ".join(f"{k}: {v.value if v.kind == 'str' else compact(plain(v))}" for k, v in n.value) + "}"


def compact(x: Any) -> str:
    return json.dumps(tidy(x), ensure_ascii=False, separators=(",", ":"))


def tidy(x: Any) -> Any:
    """Whole numbers without a point; what JSON can't hold is null."""
    if isinstance(x, float):
        if x != x or x in (float("inf"), float("-inf")):
            return None
        return int(x) if x.is_integer() and abs(x) < 2**53 else x
    if isinstance(x, dict):
        return {k: tidy(v) for k, v in x.items()}
    return [tidy(v) for v in x] if isinstance(x, list) else x


def coerce(n: Node, spec: Spec, ctx: Context) -> Any:
    """The value of a node as a type; raises Bad.

    A type that comes back to itself on the same node (an array of itself that would
    wrap a scalar, say) doesn't fit, so recursion always steps into the value. What a
    union makes of a node is remembered, as several options may ask for it; only for
    nodes that no type around it holds, as the rule above depends on these.
    """
    way = _WAYS[type(spec)]
    if not isinstance(spec, Union | Tagged | Struct | Array | Map):
        return way(n, spec, ctx)
    key = (id(n), id(spec))
    if key in ctx.active:
        raise Bad("a type within itself on the same value")
    if len(ctx.active) >= MAX_DEPTH:
        raise Bad("nested too deeply")
    keep = isinstance(spec, Union) and not ctx.within.get(id(n))
    if keep and key in ctx.memo:
        _, value, error = ctx.memo[key]
        if error:
            raise error
        return value
    before = dict(ctx.checks) if keep else None
    ctx.active.add(key)
    ctx.within[id(n)] = ctx.within.get(id(n), 0) + 1
    try:
        value = way(n, spec, ctx)
    except Bad as e:
        if keep and ctx.checks == before:
            ctx.memo[key] = (n, None, e)  # holds the node, so that its id stays its own
        raise
    finally:
        ctx.active.discard(key)
        ctx.within[id(n)] -= 1
    if keep and ctx.checks == before:
        ctx.memo[key] = (n, value, None)
    return value


def _string(n: Node, spec: String, ctx: Context) -> str:
    return js_text(n)


def _number(n: Node, spec: Number, ctx: Context) -> float:
    if n.kind not in ("num", "bool", "str"):
        raise Bad(f"{n.kind} is no number")
    try:
        v = S.number(n.value) if n.kind == "str" else float(n.value)
    except OverflowError:
        v = math.inf
    if not math.isfinite(v):
        raise Bad("a number beyond a double")
    return v


def _bool(n: Node, spec: Bool, ctx: Context) -> bool:
    if n.kind == "bool":
        return n.value
    if n.kind == "num":
        return n.value != 0
    if n.kind == "str":
        return S.boolean(n.value)
    raise Bad(f"{n.kind} is no boolean")


def _null(n: Node, spec: Null, ctx: Context) -> None:
    return None


def _fenced_null(n: Node) -> bool:
    return n.kind == "str" and bool(re.search(r"```json\s*null\s*```", n.value, re.IGNORECASE))


def _absent(n: Node, spec: Optional | Nullable, ctx: Context) -> Any:
    if n.kind == "null" and not isinstance(core(spec), Null) or isinstance(core(spec), Enum) and _fenced_null(n):
        return None
    try:
        return coerce(n, spec.item, ctx)
    except Bad:
        return None


def _enum(n: Node, spec: Enum, ctx: Context) -> str:
    if n.kind == "str":
        return S.enum_value(spec, n.value)
    if n.kind == "arr":
        for x in n.value:
            try:
                return _enum(x, spec, ctx)
            except Bad:
                continue
    if n.kind in ("null", "arr"):
        raise Bad(f"{n.kind} is none of {list(spec.values)}")
    return S.enum_value(spec, js_text(n))


def _literal(n: Node, spec: Literal, ctx: Context) -> Any:
    want = spec.value
    if n.kind == "obj":
        if len(n.value) == 1 and n.value[0][1].kind in ("str", "num", "bool"):
            return _literal(n.value[0][1], spec, ctx)
        raise Bad("an object is no literal")
    if n.kind in ("num", "bool") and not isinstance(want, str) and isinstance(want, bool) == (n.kind == "bool") and n.value == want:
        return want
    if n.kind == "str":
        return S.literal_string(want, n.value) if isinstance(want, str) else S.literal_in_prose(want, n.value)
    raise Bad(f"not {want!r}")


_SEPARATORS = re.compile(r"[-_\s]")


def squeeze(k: str) -> str:
    return _short_squeezed(k) if len(k) <= 64 else _SEPARATORS.sub("", k.lower())


@functools.lru_cache(4096)
def _short_squeezed(k: str) -> str:
    return _SEPARATORS.sub("", k.lower())


def match_field(key: str, spec: Struct) -> Any:
    """The field that a key means, remembered with the type for a few thousand keys."""
    known = spec.__dict__.get("_known")
    if known is None:
        known = {}
        object.__setattr__(spec, "_known", known)
    if key not in known:
        if len(known) > 4000:
            known.clear()
        known[key] = find_field(key, spec)
    return known[key]


def find_field(key: str, spec: Struct) -> Any:
    """Exact, trimmed, case-folded, by its other names, then without separators."""
    t = key.strip()
    tests = (
        lambda f: f.name == key,
        lambda f: f.name.strip() == t,
        lambda f: f.name.lower() == t.lower(),
        lambda f: t in f.aliases or t.lower() in FIELD_NAMES.get(f.name.lower(), ()),
        lambda f: squeeze(t) in {squeeze(f.name), *map(squeeze, f.aliases)},
    )
    for test in tests:
        for f in spec.fields:
            if test(f):
                return f
    return None


def joined(a: Node, b: Node) -> Node:
    """What two entries with the same key make: of objects that overlap one, with the later that isn't null; else an array."""
    if a.kind == b.kind == "obj" and {k for k, _ in a.value} & {k for k, _ in b.value}:
        both = dict(a.value)
        for k, v in b.value:
            if v.kind != "null" or k not in both:
                both[k] = v
        return Node("obj", list(both.items()), a.complete and b.complete)
    return Node("arr", [a, b], a.complete and b.complete)


def _entries(n: Node) -> list[tuple[str, Node]]:
    """An object's entries; values of an equal key joined."""
    out: dict[str, Node] = {}
    gathered: set[str] = set()
    for k, v in n.value:
        if k in gathered:
            out[k] = Node("arr", [*out[k].value, v], out[k].complete and v.complete)
        elif k in out:
            both = joined(out[k], v)
            if both.kind == "arr":
                gathered.add(k)
            out[k] = both
        else:
            out[k] = v
    return list(out.items())


def default(spec: Spec) -> Any:
    """What stands for a value that has not come yet."""
    if isinstance(spec, Check | Lazy):
        return default(spec.get() if isinstance(spec, Lazy) else spec.item)
    if isinstance(spec, State):
        return {"value": None, "state": "Pending"}
    return {String: "", Number: 0, Bool: False, Array: [], Map: {}, Struct: {}}.get(type(spec)) if not isinstance(spec, Struct) else {f.name: default(f.spec) for f in spec.fields}


def _struct(n: Node, spec: Struct, ctx: Context) -> dict:
    if n.kind == "str" and re.match(r"\s*\{", n.value):
        for read in (strict, lambda t: lenient(t)[0]):
            try:
                return _struct(read(n.value), spec, ctx)
            except ValueError:
                continue
    if n.kind != "obj":
        if len(spec.fields) == 1 and n.kind != "null":
            f = spec.fields[0]
            return {f.name: coerce(n, f.spec, ctx)}
        raise Bad(f"{n.kind} is no object")
    found: dict[str, Node] = {}
    last: dict[str, Node] = {}
    for k, v in n.value:
        if f := match_field(k, spec):
            last[f.name] = v
    if len(dict(n.value)) == len(n.value):
        found = last
    else:
        for k, v in _entries(n):
            if f := match_field(k, spec):
                found[f.name] = v
    if not found and len(spec.fields) == 1 and n.value and not isinstance(core(spec.fields[0].spec), String | Number | Bool | Enum | Literal):
        f = spec.fields[0]
        return {f.name: coerce(n, f.spec, ctx)}
    out = {}
    filling = ctx.partial and not n.complete
    broken: list[str] = []
    before: dict[str, bool] = {}
    try:
        for f in spec.fields:
            try:
                out[f.name] = _field(found.get(f.name), last.get(f.name), f, filling, ctx)
            except Broken as e:  # the other fields may break constraints too
                before = before if broken else dict(ctx.checks)
                broken += e.parts
    except Bad as e:
        if not broken:
            raise
        broken.append(str(e))
    if broken:
        # what fields after the first failure found isn't of a value
        ctx.checks.clear()
        ctx.checks.update(before)
        raise Broken(broken)
    return out


def _field(v: Node | None, last: Node | None, f: Field, filling: bool, ctx: Context) -> Any:
    """The value of a field found as `v`, or of one that misses."""
    if v is not None and f.done and not v.complete:
        out = None
    elif v is not None:
        try:
            out = coerce(v, f.spec, ctx)
        except Bad as e:
            if last is not v:  # of repeated keys that make no array the last counts
                out = coerce(last, f.spec, ctx)
            elif ctx.partial and not v.complete:
                out = default(f.spec)
            elif isinstance(e, Broken):
                raise Broken([f"{f.name}: {p}" for p in e.parts]) from e
            else:
                raise Bad(f"{f.name}: {e}") from e
    elif isinstance(f.spec, State):
        out = default(f.spec)
    elif filling:
        out = default(f.spec)
    elif _may_miss(f.spec):
        out = None
    else:
        raise Bad(f"{f.name} is missing")
    if f.not_null and out is None:
        raise Bad(f"{f.name} is null")
    return out


def _may_miss(spec: Spec) -> bool:
    while isinstance(spec, Check):
        spec = spec.item
    return isinstance(spec, Optional) or isinstance(spec, Nullable) and isinstance(spec.item, Optional)


def _array(n: Node, spec: Array, ctx: Context) -> list:
    if n.kind == "null":
        raise Bad("null is no array")
    if n.kind != "arr":
        return [coerce(n, spec.item, ctx)]
    out = []
    for x in n.value:
        try:
            out.append(coerce(x, spec.item, ctx))
        except Bad:
            if isinstance(item := core(spec.item), Struct) and x.kind == "obj":
                # objects of a union that stands in a field of the element
                for f in item.fields:
                    if isinstance(core(f.spec), Union | Tagged):
                        try:
                            out.append(coerce(Node("obj", [(f.name, x)], x.complete), spec.item, ctx))
                            break
                        except Bad:
                            continue
    if n.value and not out and not (ctx.partial and not n.complete):
        raise Bad("no element fits")
    return out


def _map(n: Node, spec: Map, ctx: Context) -> dict:
    if n.kind == "str" and re.match(r"\s*\{", n.value):
        try:
            n = lenient(n.value)[0]
        except Unreadable:
            pass
    if n.kind != "obj":
        return {}
    out = {}
    for k, v in _entries(n):
        _key(k, spec.key)
        try:
            out[k] = coerce(v, spec.value, ctx)
        except Bad:
            if isinstance(core(spec.value), Struct) and v.kind == "obj":
                fields = {f.name: x for key, x in v.value if (f := match_field(key, core(spec.value)))}
                out[k] = {f.name: _or_none(fields.get(f.name), f.spec, ctx) for f in core(spec.value).fields}
            elif isinstance(core(spec.value), String | Union):
                out[k] = plain(v)
            elif not (ctx.partial and not v.complete):
                raise
    return out


def _or_none(n: Node | None, spec: Spec, ctx: Context) -> Any:
    try:
        return None if n is None else coerce(n, spec, ctx)
    except Bad:
        return None


def _key(k: str, spec: Spec) -> None:
    spec = core(spec)
    if isinstance(spec, Union):
        for o in spec.options:
            try:
                return _key(k, o)
            except Bad:
                continue
        raise Bad(f"key {k!r} is none of the options")
    if isinstance(spec, Enum) and k not in spec.values or isinstance(spec, Literal) and k != str(spec.value):
        raise Bad(f"key {k!r} is not allowed")


_EXACT = {"str": String, "num": Number, "bool": Bool, "null": Null}


def _union(n: Node, spec: Union, ctx: Context) -> Any:
    if n.kind == "str" and "```" in n.value:
        from mendery.kernel.scan import fences

        for c in fences(n.value):
            try:
                return _union(c.node, spec, ctx)
            except Bad:
                continue
    cores = [core(o) for o in spec.options]
    literals = [c for c in cores if isinstance(c, Literal)]
    if literals and n.kind == "str":
        if S.cut_quote(n.value):
            raise Bad("cut-off quoted text")
        if S.several_literals(literals, n.value):
            raise Ambiguous("several literals in text")
    errors = []
    for o, c in zip(spec.options, cores, strict=True):
        if isinstance(c, _EXACT.get(n.kind, ())):
            try:
                return coerce(n, o, ctx)
            except Bad as e:
                errors.append(str(e))
    best = None
    for i, (o, c) in enumerate(zip(spec.options, cores, strict=True)):
        saved = dict(ctx.checks)
        try:
            v = coerce(n, o, ctx)
        except Ambiguous:
            raise
        except Bad as e:
            errors.append(str(e))
            ctx.checks.clear()
            ctx.checks.update(saved)
            continue
        rank = (score(n, c), sum(ctx.checks.values()) - sum(saved.values()))
        got = (rank, -i, v, dict(ctx.checks))
        ctx.checks.clear()
        ctx.checks.update(saved)
        if best is None or got[:2] > best[:2]:
            best = got
    if best:
        ctx.checks.update(best[3])
        return best[2]
    if n.kind == "str":
        for o, c in zip(spec.options, cores, strict=True):
            try:  # a scalar in prose, as the options come
                if isinstance(c, Number):
                    return coerce(Node("num", S.number_in_prose(n.value, ctx.signed)), o, ctx)
                if isinstance(c, Bool):
                    return coerce(Node("bool", S.boolean(n.value)), o, ctx)
            except Bad:
                continue
    for o in spec.options:
        if isinstance(o, Nullable | Optional):
            return None
    if ctx.fabricate and all(isinstance(c, String | Number | Bool | Null) for c in cores):
        return next((d for c in cores if (d := default(c)) is not None), None)
    raise Bad("no option fits: " + "; ".join(errors)[:300])


def score(n: Node, spec: Spec) -> int:
    """How well a node suits an option: fixed values."""
    spec = core(spec)
    if isinstance(spec, String):
        return 100 if n.kind == "str" else 10
    if isinstance(spec, Number):
        return 100 if n.kind == "num" else 50 if n.kind == "str" and S._ALONE.fullmatch(n.value) else 10
    if isinstance(spec, Bool):
        return 100 if n.kind == "bool" else 50 if n.kind == "str" and n.value.strip().lower() in ("true", "false") else 10
    if isinstance(spec, Literal):
        if n.kind == "obj":
            return 60
        if n.kind == "str" and isinstance(spec.value, str):
            t = S.unquoted(n.value).strip()
            return 100 if t == spec.value else 90 if t.lower() == spec.value.lower() else 70 if S.normal(t) == S.normal(spec.value) else 20
        return 100 if n.kind != "str" and n.value == spec.value else 10
    if isinstance(spec, Enum):
        return 100 if n.kind == "str" and n.value in spec.values else 60
    if isinstance(spec, Null):
        return 100 if n.kind == "null" else 5
    if isinstance(spec, Array):
        if n.kind != "arr":
            return 20
        if isinstance(core(spec.item), Union | Tagged) or isinstance(spec.item, Lazy):
            return 120
        return 100 + (sum(score(x, spec.item) for x in n.value) // len(n.value) // 10 if n.value else 0)
    if isinstance(spec, Struct):
        if n.kind != "obj":
            return 20
        names = {f.name for k, _ in n.value if (f := match_field(k, spec))}
        return 100 + 10 * len(names) - 2 * sum(match_field(k, spec) is None for k, _ in n.value)
    if isinstance(spec, Map):
        return 95 if n.kind == "obj" else 15
    if isinstance(spec, Union):
        return max(score(n, o) for o in spec.options)
    return 50


def _tags(spec: Tagged) -> list[tuple[Spec, list[str]]]:
    """The options with the texts of their tags, remembered with the type."""
    known = spec.__dict__.get("_known")
    if known is None:
        known = []
        for o in spec.options:
            want = core(next(f.spec for f in o.fields if f.name == spec.tag))
            known.append((o, [str(want.value)] if isinstance(want, Literal) else list(getattr(want, "values", ()))))
        object.__setattr__(spec, "_known", known)
    return known


def _tagged(n: Node, spec: Tagged, ctx: Context) -> Any:
    if n.kind == "str":
        from mendery.kernel.scan import candidates

        for c in candidates(n.value):
            try:
                return _tagged(c.node, spec, ctx)
            except Bad:
                continue
    if n.kind != "obj":
        raise Bad(f"{n.kind} is no tagged object")
    tag = next((v for k, v in n.value if k == spec.tag), None) or next((v for k, v in n.value if squeeze(k) == squeeze(spec.tag)), None)
    if tag is not None:
        got = js_text(tag)
        for exact in (True, False):
            for o, wants in _tags(spec):
                if got in wants or not exact and squeeze(got) in map(squeeze, wants):
                    return coerce(n, o, ctx)
    for o in spec.options:
        try:
            return coerce(n, o, ctx)
        except Bad:
            continue
    raise Bad("no tagged option fits")


def _state(n: Node, spec: State, ctx: Context) -> dict:
    try:
        value = coerce(n, spec.item, ctx)
    except Bad:
        if n.complete:
            raise
        value = None
    return {"value": value, "state": "Complete" if n.complete else "Incomplete"}


def _check(n: Node, spec: Check, ctx: Context) -> Any:
    chain = [spec]
    while isinstance(chain[-1].item, Check):
        chain.append(chain[-1].item)
    v = coerce(n, chain[-1].item, ctx)
    broken: list[str] = []
    for c in reversed(chain):
        if v is None and isinstance(c.item, Optional | Nullable):
            continue
        try:
            ok = bool(c.test(v))
        except Exception:  # a predicate that can't take the value doesn't hold
            ok = False
        if c.hard and not ok:
            broken.append(f"constraint {c.name} fails")
        if not c.hard and not broken:
            ctx.checks[c.name] = ctx.checks.get(c.name, True) and ok
    if broken:
        raise Broken(broken)
    return v


_WAYS = {
    String: _string,
    Number: _number,
    Bool: _bool,
    Null: _null,
    Optional: _absent,
    Nullable: _absent,
    Enum: _enum,
    Literal: _literal,
    Struct: _struct,
    Array: _array,
    Map: _map,
    Union: _union,
    Tagged: _tagged,
    State: _state,
    Check: _check,
    Lazy: lambda n, s, c: coerce(n, c.target(s), c),
}
