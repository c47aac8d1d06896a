"""Candidates for a value inside prose: fenced blocks first, then objects and arrays in order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from mendery.kernel.loads import Node, Reader, Unreadable, lenient, quick, strict

_FENCE = re.compile(r"```(?:json|javascript)?[ \t]*\n?(.*?)\n?[ \t]*```", re.DOTALL)
_OPEN = re.compile(r"```(?:json|javascript)?[ \t]*\n(.*)\Z", re.DOTALL)
_PROSE = re.compile(r"\n[ \t]*\n?[A-Z][a-z]+ [a-z]+[^\n{}\[\]\":]*(?:\n|\Z)")


@dataclass
class Candidate:
    """origin: fence, object or array; `text` as it stands, `node` as it reads."""

    origin: str
    text: str
    node: Node
    fixes: list[str] = field(default_factory=list)


def _read(text: str) -> tuple[Node, list[str]] | None:
    try:
        return strict(text), []
    except ValueError:
        pass
    try:
        return lenient(text)
    except Unreadable:
        return None


def fences(text: str) -> list[Candidate]:
    """Closed fenced blocks; if there are none, the rest behind an open fence."""
    bodies = [m[1] for m in _FENCE.finditer(text)] or [m[1] for m in _OPEN.finditer(text)]
    out = []
    for b in bodies:
        b = b.strip()
        if b and (got := _read(b)):
            node, fixes = got
            if node.kind == "str" and (inner := structures(b)):
                out += [Candidate("fence", c.text, c.node, c.fixes) for c in inner]
            else:
                out.append(Candidate("fence", b, node, fixes))
    return out


def meaningful_end(text: str) -> str:
    """A cut-off structure without prose behind it."""
    m = _PROSE.search(text)
    return text[: m.start()] if m else text


def structures(text: str) -> list[Candidate]:
    """Outermost objects and arrays, each read where it begins; the reader finds its end, so quotes in prose do no harm."""
    out, at = [], 0
    begin = re.compile(r"[{\[]")
    while m := begin.search(text, at):
        if not at and (got := quick(text[m.start() :])):  # the rest is one structure
            return [Candidate("object" if m[0] == "{" else "array", text[m.start() :].rstrip(), *got)]
        r = Reader(text, m.start())
        try:
            node = r.value()
        except Unreadable:
            at = m.start() + 1
            continue
        end = max(r.pos, m.start() + 1)
        if not node.complete and (shorter := meaningful_end(text[m.start() :])) != text[m.start() :]:
            try:
                node, r.fixes = lenient(shorter)
                end = m.start() + len(shorter)
            except Unreadable:
                pass
        out.append(Candidate("object" if m[0] == "{" else "array", text[m.start() : end], node, r.fixes))
        at = end
    return out


class candidates:
    """Candidates of a text in order, as a sequence; what stands outside of fences is read when it is asked for."""

    def __init__(self, text: str):
        self.text, self.first, self._all = text, fences(text), None

    @property
    def all(self) -> list[Candidate]:
        if self._all is None:
            self._all = [*self.first, *structures(self.text)]
        return self._all

    def __iter__(self):
        yield from self.first
        yield from self.all[len(self.first) :]

    def __len__(self) -> int:
        return len(self.all)

    def __getitem__(self, i):
        return self.all[i]
