"""Repairs of JSON-like text, text to text, none of which touches what stands in double quotes."""

from __future__ import annotations

import json
import re

from mendery.kernel.loads import Unreadable, lenient, plain

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"|"(?:[^"\\]|\\.)*\Z', re.DOTALL)


def outside(text: str, change) -> str:
    """`change` applied to what is outside of double-quoted strings."""
    out, at = [], 0
    for m in _STRING.finditer(text):
        out += [change(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, change(text[at:])])


def trailing_commas(text: str) -> str:
    marked = outside(text, lambda s: s)
    spans = [(m.start(), m.end()) for m in _STRING.finditer(marked)]
    inside = lambda i: any(a <= i < b for a, b in spans)
    return re.sub(r",(\s*[}\]])", lambda m: m[0] if inside(m.start()) else m[1], text)


def thousands(text: str) -> str:
    """Numbers without thousands separators."""
    return outside(text, lambda s: re.sub(r"(?<![\d.])(-?\d{1,3}(?:,\d{3})+(?:\.\d+)?)(?!\d)", lambda m: m[1].replace(",", ""), s))


def comments(text: str) -> str:
    return outside(text, lambda s: re.sub(r"//[^\n]*|/\*.*?\*/", "", s, flags=re.DOTALL))


def missing_commas(text: str) -> str:
    return outside(text, lambda s: re.sub(r"\b(null|true|false|\d)(\s*[\[{])", r"\1,\2", s))


def close_open(text: str) -> str:
    """With the string and the brackets that are open at the end closed, innermost first."""
    stack, quoted, i = [], False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack and stack[-1] == c:
            stack.pop()
        i += 1
    return text + '"' * quoted + "".join(reversed(stack))


def valid(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def repair(text: str) -> str:
    """Valid JSON text if the repairs in turn make it so, else what they make."""
    t = text.strip()
    if valid(t):
        return t
    for step in (thousands, comments, trailing_commas, missing_commas, close_open, trailing_commas):
        before, t = t, step(t)
        if t != before and valid(t):
            return t
    try:
        node, _ = lenient(text)
    except Unreadable:
        return t
    return json.dumps(plain(node), ensure_ascii=False) if node.kind in ("obj", "arr") else t
