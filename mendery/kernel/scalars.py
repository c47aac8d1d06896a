"""Scalars out of text: numbers, booleans, enum values and literals."""

from __future__ import annotations

import functools
import re
import unicodedata
from typing import Any

from mendery.types import Enum, Literal


class Bad(ValueError):
    """A value that can't be what is asked for."""


class Broken(Bad):
    """A value that breaks hard constraints; `parts` has all of them, by field."""

    def __init__(self, parts: list[str]):
        super().__init__("; ".join(parts))
        self.parts = parts


class Ambiguous(Bad):
    """A text that names several values."""


_LEAD = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
_WORD = r"(?<![A-Za-z0-9_]){}(?![A-Za-z0-9_])"


def word(pattern: str, flags: int = 0) -> re.Pattern:
    """A whole-word pattern with ASCII word characters."""
    return re.compile(_WORD.format(pattern), flags)


_TRUE, _FALSE = word("true", re.IGNORECASE), word("false", re.IGNORECASE)


def lead_number(s: str) -> float | None:
    """The number that a text begins with."""
    m = _LEAD.match(s)
    return float(m[1]) if m else None


def number(s: str) -> float:
    """A number from text: separators, a currency sign, a fraction, a trailing dot; else the number it begins with."""
    t = s.strip().replace(",", "")
    t = t[1:].lstrip() if t.startswith("$") else t
    parts = t.split("/")
    if len(parts) == 2:
        a, b = lead_number(parts[0]), lead_number(parts[1])
        if a is not None and b:
            return a / b
    got = lead_number(t.removesuffix("."))
    if got is None:
        raise Bad(f"no number: {s[:60]!r}")
    return got


_ALONE = re.compile(r"\s*[-+]?\$?\s*[-+]?(?:[\d,]+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\.?(?:\s*/\s*[\d.]+)?\s*")


def number_in_prose(s: str, signed: bool = False) -> float:
    """The first number of a text; a text that is one number is read whole."""
    if _ALONE.fullmatch(s):
        return number(s)
    m = re.search(r"-?\d+(?:\.\d+)?" if signed else r"\d+(?:\.\d+)?", s)
    if not m:
        raise Bad("no number in text")
    return float(m[0])


def boolean(s: str) -> bool:
    """true or false as the whole text or as its only such word."""
    t = s.strip().strip("*").strip().lower()
    if t in ("true", "false"):
        return t == "true"
    yes, no = bool(_TRUE.search(s)), bool(_FALSE.search(s))
    if yes and no:
        raise Ambiguous("both true and false in text")
    if yes or no:
        return yes
    raise Bad("no boolean in text")


def enum_value(spec: Enum, s: str) -> str:
    """Exact, unquoted, case-folded, then in the text."""
    ways = {v: v for v in spec.values} | spec.aliases
    if s in ways:
        return ways[s]
    bare = re.sub(r"^[\"']|[\"']$", "", s.strip())
    if bare in ways:
        return ways[bare]
    folded = {ways[w] for w in ways if w.lower() == bare.strip().lower()}
    if len(folded) == 1:
        return folded.pop()
    return enum_in_prose(spec, s)


def enum_in_prose(spec: Enum, s: str) -> str:
    """The one value that a text names. Exact case goes before other case; several values are ambiguous, unless the
    first is quoted or is followed by a colon or dash and no other value comes after it."""
    text = s.replace("*", "")
    ways = {v: v for v in spec.values} | spec.aliases
    exact, loose = {}, {}
    for w, v in ways.items():
        m = word(re.escape(w)).search(text)
        if m:
            if v not in exact or m.start() < exact[v].start():
                exact[v] = m
        elif m := word(re.escape(w), re.IGNORECASE).search(text):
            loose.setdefault(v, m)
    loose = {v: m for v, m in loose.items() if v not in exact}
    if len(exact) + len(loose) == 1:
        return next(iter(exact or loose))
    if not exact and not loose:
        raise Bad(f"none of {list(spec.values)} in text")
    if len(exact) == 1:
        return next(iter(exact))
    if not exact:
        raise Ambiguous(f"several of {list(spec.values)} in text")
    v, m = min(exact.items(), key=lambda e: (e[1].start(), -len(e[0])))
    if text[max(0, m.start() - 1) : m.start()] in ('"', "'") and text[m.end() : m.end() + 1] in ('"', "'"):
        return v
    rest = text[m.end() :]
    if re.match(r"\s*[:-]", rest) and not any(word(re.escape(w), re.IGNORECASE).search(rest) for w, x in ways.items() if x != v):
        return v
    raise Ambiguous(f"several of {list(spec.values)} in text")


def unquoted(s: str) -> str:
    """Without the quotes around a text: a fence, triple, back, double or single."""
    t = s.strip()
    for q in ("```", '"""', "'''", "`", '"', "'"):
        if len(t) >= 2 * len(q) and t.startswith(q) and t.endswith(q):
            t = t[len(q) : -len(q)]
            return t.split("\n", 1)[1] if q == "```" and "\n" in t else t
    return t


def normal(s: str) -> str:
    """Word characters, spaces and dashes, squeezed, in lower case."""
    return re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9_\s-]", "", s)).strip().lower()


def plain_letters(s: str) -> str:
    """In lower case without accents."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ")).lower()


def cut_quote(s: str) -> bool:
    """Whether a text opens with a quote that nothing closes."""
    return bool(re.match(r'\s*"[^"]*\Z', s))


def literal_string(want: str, s: str) -> str:
    """`want` if a text means it; of short texts, which come again and again, the outcome is remembered."""
    if s == want:
        return want
    if len(s) > 64:
        return _literal_string(want, s)
    error = _short_literal(want, s)
    if error is not None:
        raise Bad(error)
    return want


@functools.lru_cache(4096)
def _short_literal(want: str, s: str) -> str | None:
    """Why a text isn't `want`, nothing if it is."""
    try:
        _literal_string(want, s)
    except Bad as e:
        return str(e)
    return None


def _literal_string(want: str, s: str) -> str:
    if cut_quote(s):
        raise Bad("cut-off quoted text")
    t = unquoted(s).strip()
    w = want.strip()
    if t == w or t.lower() == w.lower() or normal(t) == normal(w) != "" or plain_letters(t) == plain_letters(w):
        return want
    return literal_in_prose(want, s)


def literal_in_prose(want: Any, s: str) -> Any:
    if re.match(r"\s*[\[{]", s) and re.search(r"[\]}]\s*\Z", s):
        raise Bad("a structure, not a text")
    if isinstance(want, bool):
        if boolean(s) == want:
            return want
    elif word(re.escape(str(want)), re.IGNORECASE if isinstance(want, str) else 0).search(s):
        return want
    raise Bad(f"no {want!r} in text")


def several_literals(options: list[Literal], s: str) -> bool:
    """Whether a text names more than one number or boolean of the options."""

    def has(x: Any) -> bool:
        return bool(word(re.escape(str(x).lower() if isinstance(x, bool) else str(x)), re.IGNORECASE).search(s))

    return sum(has(o.value) for o in options if not isinstance(o.value, str)) > 1
