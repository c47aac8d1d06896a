"""One text to one value: strategies in turn until one gives a value that fits the type."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from mendery.kernel import scalars as S
from mendery.kernel.coerce import Context, coerce, compact
from mendery.kernel.loads import Node, lenient, strict, without_tail
from mendery.kernel.repair import repair
from mendery.kernel.scalars import Ambiguous, Bad, Broken
from mendery.kernel.scan import candidates
from mendery.types import Array, Bool, Check, Enum, Lazy, Literal, Map, Nullable, Number, Optional, Spec, String, Struct, Tagged, Union, core


_OPENS = re.compile(r"\s*[\[{\"'`]")


@dataclass(frozen=True)
class Options:
    """allow_malformed is accepted for allow_fixes; incomplete_tail is keep or drop."""

    allow_as_string: bool = True
    allow_extract: bool = True
    allow_fixes: bool = True
    allow_partial: bool = False
    allow_malformed: bool | None = None
    incomplete_tail: str = "keep"
    signed_numbers: bool = False
    fabricate_defaults: bool = False


@dataclass
class Result:
    value: Any = None
    ok: bool = False
    error: str | None = None
    strategy: str | None = None
    fixes: list[str] = field(default_factory=list)
    complete: bool = True
    checks: dict[str, bool] = field(default_factory=dict)

    @property
    def json(self) -> str | None:
        return compact({"v": self.value}) if self.ok else None


def _unions(spec: Spec) -> list[Spec]:
    c = core(spec)
    return [core(o) for o in c.options] if isinstance(c, Union | Tagged) else [c]


def _compound(spec: Spec) -> bool:
    """Whether a structure may fit, remembered with the type."""
    known = spec.__dict__.get("_structured")
    if known is None:
        known = any(isinstance(c, Struct | Array | Map | Tagged) for c in _unions(spec))
        object.__setattr__(spec, "_structured", known)
    return known


def _same(a: Node, b: Node) -> bool:
    """Whether two nodes are alike in all that a type can ask for."""
    if a.kind != b.kind or a.complete != b.complete:
        return False
    if a.kind == "obj":
        return len(a.value) == len(b.value) and all(k == q and _same(v, w) for (k, v), (q, w) in zip(a.value, b.value, strict=True))
    if a.kind == "arr":
        return len(a.value) == len(b.value) and all(map(_same, a.value, b.value))
    return type(a.value) is type(b.value) and a.value == b.value


def _raw_string(text: str, spec: Spec, ctx: Context) -> Any:
    """The text itself as a checked string; a nullable one may be null."""
    if isinstance(spec, Check):
        from mendery.kernel.coerce import _check

        return _check(Node("str", text), Check(String(), spec.name, spec.test, spec.hard), ctx)
    return text


def decode(text: str | None, spec: Spec, opts: Options = Options()) -> Result:
    """The value of a text as `spec`, how it was found, and why not if not."""
    if text is None:
        return Result(error="no text", complete=False)
    kind = core(spec)
    ctx = Context(opts.allow_partial, opts.fabricate_defaults, opts.signed_numbers, text)
    fixing = opts.allow_fixes or bool(opts.allow_malformed)
    errors: list[str] = []
    violations: set[str] = set()
    failed: list[tuple[Node, str]] = []  # nodes that didn't fit: another strategy often reads the same

    def done(value: Any, strategy: str, fixes: list[str] = (), complete: bool = True) -> Result:
        return Result(value, True, None, strategy, list(fixes), complete, dict(ctx.checks))

    def tried(node: Node, fixes: list[str], strategy: str) -> Result | None:
        if opts.incomplete_tail == "drop":
            node = without_tail(node)
        for other, error in failed:
            if _same(node, other):
                errors.append(error)
                return None
        try:
            ctx.checks.clear()
            return done(coerce(node, spec, ctx), strategy, fixes, node.complete)
        except Ambiguous as e:
            errors.append(f"ambiguous: {e}")
        except Bad as e:
            errors.append(str(e))
            if isinstance(e, Broken):
                violations.add(str(e))
        if len(failed) < 4:
            failed.append((node, errors[-1]))
        return None

    options = _unions(spec)
    if isinstance(kind, Union) and any(isinstance(o, Literal) for o in options) and S.cut_quote(text):
        return Result(error="cut-off quoted text")
    if isinstance(kind, String):
        absent = text.strip() == "null" and any(isinstance(s, Nullable) for s in _wrappers(spec))
        try:
            return done(None if absent else _raw_string(text, spec, ctx), "text")
        except Bad as e:
            return Result(error=str(e))
    quoted = len(text) > 1 and text[0] == text[-1] == '"'
    if isinstance(kind, Union) and quoted and any(isinstance(o, String) for o in options) and not _compound(spec):
        if got := tried(Node("str", text), [], "text"):
            return got

    try:
        if got := tried(strict(text), [], "json"):
            return got
    except ValueError:
        pass

    found = None
    if opts.allow_extract and _compound(spec):
        found = candidates(text)
        objects = [c for c in found if c.node.kind == "obj"] if isinstance(kind, Array) else []
        if len(objects) > 1 and len(objects) == len(found):
            values, fixes = [], []
            for c in objects:
                try:
                    values.append(coerce(c.node, kind.item, ctx))
                    fixes += c.fixes
                except Bad as e:
                    errors.append(str(e))
            if values:
                return done(values, "objects", dict.fromkeys(fixes), objects[-1].node.complete)
        for c in found:
            if not fixing and c.fixes:
                continue
            if isinstance(kind, Struct) and c.node.kind == "arr" and any(o.node.kind == "obj" for o in found):
                continue
            if got := tried(c.node, c.fixes, "extract" if c.node.complete or not opts.allow_partial else "partial"):
                return got

    if fixing:
        fixed = repair(text)
        if fixed != text:
            try:
                if not isinstance(kind, String) and (got := tried(strict(fixed), ["repaired text"], "repair")):
                    return got
            except ValueError:
                pass
        if _compound(spec) and _OPENS.match(text):
            try:
                node, fixes = lenient(text)
                if got := tried(node, fixes, "lenient"):
                    return got
            except ValueError as e:
                errors.append(str(e))

    if isinstance(kind, Number | Bool | Enum):
        try:
            ctx.checks.clear()
            if isinstance(kind, Enum):
                if any(isinstance(s, Optional | Nullable) for s in _wrappers(spec)) and re.search(r"```json\s*null\s*```", text, re.IGNORECASE):
                    return done(None, "prose")
                value = S.enum_value(kind, text)
            else:
                value = S.boolean(text) if isinstance(kind, Bool) else S.number_in_prose(text, opts.signed_numbers)
            node = Node({Number: "num", Bool: "bool"}.get(type(kind), "str"), value)
            return done(coerce(node, spec, ctx), "prose")
        except Bad as e:
            if any(isinstance(s, Optional | Nullable) for s in _wrappers(spec)) and not isinstance(e, Ambiguous):
                return done(None, "prose")
            return Result(error=f"{'ambiguous: ' if isinstance(e, Ambiguous) else ''}{e}")

    if opts.allow_as_string and not (found and _compound(spec)) and not (errors and errors[-1].startswith("ambiguous")):
        if got := tried(Node("str", text), [], "text"):
            return got
    error = (errors or ["no strategy fits"])[-1]
    return Result(error=error if error in violations else error[:500], complete=False)


def _wrappers(spec: Spec) -> list[Spec]:
    out = []
    while isinstance(spec, Optional | Nullable | Check | Lazy):
        out.append(spec)
        spec = spec.get() if isinstance(spec, Lazy) else spec.item
    return out
