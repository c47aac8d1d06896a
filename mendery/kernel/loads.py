"""A lenient reader of JSON-like text: text to a tree of nodes, with what it repaired."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import accumulate
from typing import Any


@dataclass(slots=True)
class Node:
    """kind: str, num, bool, null, obj (list of key and node, duplicates kept) or arr. `complete`: the text held all of it."""

    kind: str
    value: Any
    complete: bool = True


class Unreadable(ValueError):
    pass


_SPECIAL = {q: re.compile(rf"[\\{q}]") for q in "\"'`"}
_STOPS = re.compile(r"[()\n,}\]/]")
_LITERAL = re.compile(r"(?:null|true|false|-?\d+(?:\.\d+)?)(?=[{\[])")
_BARE_KEY = re.compile(r"[:\n,}]")
_QUOTES = "\"'`"
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_GROUPED = re.compile(r"[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?")
_KEY = re.compile(r"""\s*(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[A-Za-z_$][\w$-]*(?: [\w$-]+){0,3}|\d+(?:\.\d+)?)\s*:(?!//)""")
_NOISE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))*", re.DOTALL)
MAX_DEPTH = 120


def dedent(text: str) -> str:
    """Without blank first and last lines and the indentation that all lines share."""
    lines = text.split("\n")
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()
    margin = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    return "\n".join(x[margin:] if x.strip() else "" for x in lines)


def sniff(word: str) -> Node:
    """An unquoted word as number, boolean, null or string."""
    low = word.lower()
    if low in ("true", "false"):
        return Node("bool", low == "true")
    if low == "null":
        return Node("null", None)
    if _NUMBER.fullmatch(word):
        return Node("num", _number(word))
    if _GROUPED.fullmatch(word):
        return Node("num", _number(word.replace(",", "")))
    return Node("str", word)


def _number(s: str) -> int | float:
    return int(s) if re.fullmatch(r"[-+]?\d{1,300}", s) else float(s)


class Reader:
    """Reads one value from `pos` on; `pos` is behind it afterwards."""

    def __init__(self, text: str, pos: int = 0):
        self.text, self.pos, self.end = text, pos, len(text)
        self.fixes: list[str] = []

    def fix(self, what: str) -> None:
        if what not in self.fixes:
            self.fixes.append(what)

    def skip(self) -> str:
        """Past white space and comments; the next character, or nothing at the end."""
        c = self.text[self.pos : self.pos + 1]
        if c == " ":
            self.pos += 1
            c = self.text[self.pos : self.pos + 1]
        if c != "/" and not c.isspace():
            return c
        at = _NOISE.match(self.text, self.pos).end()
        if "/" in self.text[self.pos : at]:
            self.fix("removed comment")
        self.pos = at
        return self.text[at : at + 1]

    def value(self, within: str = "top", depth: int = 0) -> Node:
        c = self.skip()
        if not c:
            raise Unreadable("no value")
        if depth > MAX_DEPTH:
            raise Unreadable(f"nested deeper than {MAX_DEPTH}")
        if c == "{":
            return self.object(depth)
        if c == "[":
            return self.array(depth)
        if c in _QUOTES:
            return self.string(within)
        return self.bare(within)

    def object(self, depth: int) -> Node:
        self.pos += 1
        entries: list[tuple[str, Node]] = []
        while True:
            c = self.skip()
            if not c:
                self.fix("closed object")
                return Node("obj", entries, False)
            if c == "}":
                self.pos += 1
                return Node("obj", entries)
            if c == ",":
                self.pos += 1
                if self.skip() in ("}", ""):
                    self.fix("removed trailing comma")
                continue
            if c == "]":  # closes something that was never opened here
                self.fix("closed object")
                return Node("obj", entries)
            if c == "{":  # a new object begins where a key should stand
                self.fix("merged embedded object")
                inner = self.object(depth + 1)
                entries += inner.value
                if not inner.complete:
                    return Node("obj", entries, False)
                continue
            key = self.key()
            if key is None:
                self.fix("closed object")
                return Node("obj", entries, False)
            c = self.skip()
            if c == ":":
                self.pos += 1
                c = self.skip()
            elif c:
                self.fix("added missing colon")
            if not c:
                return Node("obj", [*entries, (key, Node("null", None, False))], False)
            if c in ",}":
                self.fix("missing value is null")
                entries.append((key, Node("null", None)))
                continue
            item = self.value("obj", depth + 1)
            entries.append((key, item))
            if not item.complete:
                if item.kind in ("obj", "arr") or self.pos >= self.end:
                    self.fix("closed object")
                    return Node("obj", entries, False)
            if self.skip() not in (",", "}", "", "]"):
                self.fix("added missing comma")

    def array(self, depth: int) -> Node:
        self.pos += 1
        items: list[Node] = []
        while True:
            c = self.skip()
            if not c:
                self.fix("closed array")
                return Node("arr", items, False)
            if c == "]":
                self.pos += 1
                return Node("arr", items)
            if c == ",":
                self.pos += 1
                if self.skip() == "]":
                    self.fix("removed trailing comma")
                continue
            if c == "}":
                self.fix("closed array")
                return Node("arr", items)
            before = self.pos
            item = self.value("arr", depth + 1)
            items.append(item)
            if self.pos == before:
                self.pos += 1
            if not item.complete and self.pos >= self.end:
                self.fix("closed array")
                return Node("arr", items, False)
            if self.skip() not in (",", "]", "", "}"):
                self.fix("added missing comma")

    def key(self) -> str | None:
        """A quoted or bare key; nothing if the text ends within it."""
        c = self.text[self.pos]
        if c in _QUOTES:
            node = self.string("key")
            return node.value if node.complete else None
        self.fix("quoted key")
        stop = _BARE_KEY.search(self.text, self.pos)
        if not stop:
            self.pos = self.end
            return None
        word = self.text[self.pos : stop.start()].strip()
        self.pos = stop.start()
        if not word:
            self.pos += 1
        return word

    def string(self, within: str) -> Node:
        q = self.text[self.pos]
        start = self.pos + 1
        if self.text.startswith(q * 3, self.pos) and not (q == "'" and within == "key"):
            return self.block(q * 3)
        if q != "`" and self.text.startswith(q, start):
            after = self.text[start + 1 : start + 2]
            if after and after not in ",]}:" and not after.isspace():
                close = re.compile(rf"{q}{q}(?=\s*(?:[,\]}}:]|\Z))").search(self.text, start + 1)
                if close:  # the quotes are doubled, so one of each belongs to the text
                    self.fix("kept doubled quotes")
                    self.pos = close.end()
                    return Node("str", q + self.text[start + 1 : close.start()] + q)
        out, i = [], start
        special = _SPECIAL[q]
        while i < self.end:
            m = special.search(self.text, i)
            if not m:
                out.append(self.text[i:])
                break
            out.append(self.text[i : m.start()])
            i, c = m.start(), m[0]
            if c == "\\" and i + 1 < self.end:
                e = self.text[i + 1]
                if e == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", self.text[i + 2 : i + 6]):
                    out.append(chr(int(self.text[i + 2 : i + 6], 16)))
                    i += 6
                    continue
                out.append(_ESCAPES.get(e, e))
                i += 2
                continue
            if c == q:
                if self.closes(i, within):
                    self.pos = i + 1
                    if q != '"':
                        self.fix("converted quotes")
                    return Node("str", _surrogates("".join(out)))
                self.fix("kept unescaped quote")
            out.append(c)
            i += 1
        self.pos = self.end
        self.fix("closed string")
        return Node("str", _surrogates("".join(out)), False)

    def block(self, q: str) -> Node:
        """A string in triple quotes; a fence's first line is its language if it is one word."""
        start = self.pos + 3
        close = self.text.find(q, start)
        while close >= 0 and not re.compile(r"\s*(?:[,\]}:]|\Z|\"|'|//)").match(self.text, close + 3):
            close = self.text.find(q, close + 3)
        body = self.text[start : close if close >= 0 else self.end]
        self.pos = close + 3 if close >= 0 else self.end
        if q == "```" and (m := re.match(r"[A-Za-z]*[ \t]*\n", body)):
            body = body[m.end() :]
        self.fix("converted triple quotes")
        return Node("str", dedent(body), close >= 0)

    def closes(self, i: int, within: str) -> bool:
        """Whether the quote at `i` ends the string: what follows must continue the structure that it stands in."""
        j = _NOISE.match(self.text, i + 1).end()
        c = self.text[j : j + 1]
        if not c:
            return True
        if within == "key":
            return c == ":" or bool(re.match(r"[\"'{\[\d]", c)) and j > i + 1
        if within == "arr":
            return c in ",]" or c == "}" and not self.text[j + 1 :].strip()
        if within == "obj":
            if c == "}":
                return True
            if c == "]":
                return bool(re.compile(r"\]\s*[}\]]*\s*\Z").match(self.text, j)) and "[" not in self.text[max(0, i - 200) : i]
            if c == ",":
                k = _NOISE.match(self.text, j + 1).end()
                return self.text[k : k + 1] in ("}", "", "{") or bool(_KEY.match(self.text, j + 1))
            return "\n" in self.text[i:j] and bool(_KEY.match(self.text, j))
        return not self.text[j:].strip()

    def bare(self, within: str) -> Node:
        """An unquoted value. In an object it runs on over lines and commas until a new key or the object's end."""
        start, i, depth = self.pos, self.pos, 0
        text = self.text
        m = _LITERAL.match(text, start)
        if m:
            self.pos = m.end()
            return sniff(m[0])
        while i < self.end:
            m = _STOPS.search(text, i)
            if not m:
                i = self.end
                break
            i, c = m.start(), m[0]
            if c == "(":
                depth += 1
            elif c == ")":
                depth = max(0, depth - 1)
            elif within == "top":
                pass
            elif within == "arr":
                if c in ",]" and not depth or c in "}\n":
                    break
            elif c == "}":
                break
            elif c == "," and not depth:
                k = _NOISE.match(text, i + 1).end()
                if text[k : k + 1] in ("}", "") or _KEY.match(text, i + 1):
                    break
            elif c == "\n" and _KEY.match(text, i):
                break
            elif c == "/" and i > start and text[i - 1].isspace() and text[i : i + 2] in ("//", "/*"):
                break
            i += 1
        word = text[start:i].strip()
        self.pos = i
        node = sniff(word)
        if node.kind == "str":
            self.fix("quoted value")
        elif node.kind == "num" and "," in word:
            self.fix("removed thousands separators")
        node.complete = i < self.end or within == "top"
        return node


def _surrogates(s: str) -> str:
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in s) else s


def lenient(text: str) -> tuple[Node, list[str]]:
    """The first value of a text; what follows it is ignored."""
    if got := quick(text):
        return got
    r = Reader(text)
    return r.value(), r.fixes


class _Pairs(list):
    pass


def _refuse(name: str):
    raise Unreadable(name)


_DECODER = json.JSONDecoder(object_pairs_hook=_Pairs, parse_constant=_refuse)


def strict(text: str) -> Node:
    """The value of valid JSON text, duplicate keys kept."""

    try:
        return of(_DECODER.decode(text))
    except RecursionError as e:
        raise Unreadable("nested too deeply") from e


_KINDS = {str: "str", int: "num", float: "num", bool: "bool", type(None): "null"}
#: Strings without anything that means something in JSON-like text, short plain numbers, words and punctuation.
_INNER = r"[^\"'`\\{}\[\]:,/\x00-\x1f\ud800-\udfff]"
_SIMPLE = re.compile(rf"""[ \t\n]*+[{{\[](?:[ \t\n{{}}\[\]:,]++|"{_INNER}++"|'{_INNER}++'|-?\d{{1,15}}+(?:\.\d{{1,15}}+)?+|[A-Za-z_]\w*+)*+""", re.ASCII)
_SIMPLE_KEY = re.compile(r"([{,][ \t\n]*)([A-Za-z_]\w*)(?=[ \t\n]*:)", re.ASCII)
_TRAILING = re.compile(r",(?=[ \t\n]*[}\]])")
_BRACKET = re.compile(r"[{}\[\]]")


def quick(text: str) -> tuple[Node, list[str]] | None:
    """What the Reader makes of a text that is one simple structure, by the JSON decoder; nothing for other texts.

    Simple: but for single quotes, bare keys and trailing commas it is JSON, and its
    strings hold no quotes, brackets, colons, commas, slashes or backslashes, so
    these repairs can be made on the whole text.
    """
    if not _SIMPLE.fullmatch(text):
        return None
    brackets = _BRACKET.findall(text)
    if len(brackets) > MAX_DEPTH and max(accumulate(1 if b in "{[" else -1 for b in brackets)) > MAX_DEPTH:
        return None
    found = []
    fixed = text
    if (at := text.find("'")) >= 0:
        found.append((at, "converted quotes"))
        fixed = text.replace("'", '"')
    if m := _SIMPLE_KEY.search(text):
        found.append((m.start(2), "quoted key"))
        fixed = _SIMPLE_KEY.sub(r'\1"\2"', fixed)
    if m := _TRAILING.search(text):
        found.append((m.start(), "removed trailing comma"))
        fixed = _TRAILING.sub("", fixed)
    try:
        return strict(fixed), [what for _, what in sorted(found)]
    except ValueError:
        return None


def of(x: Any) -> Node:
    """The node of a Python value."""
    kind = _KINDS.get(type(x))
    if kind:
        return Node(kind, x)
    if isinstance(x, _Pairs):
        return Node("obj", [(k, of(v)) for k, v in x])
    if isinstance(x, dict):
        return Node("obj", [(str(k), of(v)) for k, v in x.items()])
    if isinstance(x, list | tuple):
        return Node("arr", [of(v) for v in x])
    if isinstance(x, bool):
        return Node("bool", x)
    if x is None:
        return Node("null", None)
    return Node("str", x) if isinstance(x, str) else Node("num", x)


def plain(n: Node) -> Any:
    """The Python value of a node; of equal keys the last wins."""
    if n.kind == "obj":
        return {k: plain(v) for k, v in n.value}
    return [plain(v) for v in n.value] if n.kind == "arr" else n.value


def without_tail(n: Node, top: bool = True) -> Node:
    """Without the element or field that the text's end cut off."""
    if n.complete or n.kind not in ("obj", "arr"):
        return n
    if n.kind == "arr":
        return Node("arr", n.value[:-1] if n.value and not n.value[-1].complete else n.value, False)
    if n.value and not n.value[-1][1].complete:
        k, last = n.value[-1]
        return Node("obj", [*n.value[:-1], *([(k, without_tail(last, False))] if last.kind in ("obj", "arr") else [])], False)
    return n
