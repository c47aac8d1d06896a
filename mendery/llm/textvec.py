"""Texts as numpy arrays of code points: words, hashes and token ids of many texts at once."""

from __future__ import annotations

import functools

import numpy as np

#: Character classes of the pre-tokeniser pattern; EDGE is the mark between texts.
OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
_M = np.uint64


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = kind
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters them (the splitmix64 finaliser)."""
    x = x ^ (x >> _M(30))
    x = x * _M(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _M(27))
    x = x * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


_STEP = _M(0x9E3779B97F4A7C15)
#: Three code points of 21 bits make a block; longer pieces than LONG are hashed by xxHash instead.
_MASKS = np.array([0, 2**21 - 1, 2**42 - 1, 2**63 - 1], np.uint64)
LONG = 48


def blocks(cps: np.ndarray) -> np.ndarray:
    """At each place the code point and the two after it, as one word."""
    out = cps.astype(np.uint64)
    for k in (1, 2):
        out[:-k] |= cps[k:].astype(np.uint64) << _M(21 * k)
    return out


def unequal(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which pieces of n code points differ, given as places in the blocks() of two arrays."""
    out = np.zeros(len(n), bool)
    for i in np.flatnonzero(n > LONG).tolist():
        k = int(n[i]) - 2
        out[i] = (a[at[i] : at[i] + k] != b[bt[i] : bt[i] + k]).any()
    live = np.flatnonzero(n <= LONG)
    for j in range(0, LONG, 3):
        live = live[n[live] > j]
        if not len(live):
            break
        out[live] |= (a[at[live] + j] ^ b[bt[live] + j]) & _MASKS[np.minimum(n[live] - j, 3)] != 0
    return out


class Texts:
    """Several texts in one array of code points, each followed by a mark."""

    def __init__(self, texts: list[str]):
        self.joined = "\0".join(texts) + "\0"
        self.cps = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate(([0], np.cumsum(self.lengths + 1)))
        self.marks = self.starts[1:] - 1
        self._of, self._from = None, self.cps

    @property
    def text(self) -> str:
        """The texts as they are now, in one string."""
        if self._from is not self.cps:
            self.joined, self._from = self.cps.tobytes().decode("utf-32-le", "surrogatepass"), self.cps
        return self.joined

    @property
    def blocks(self) -> np.ndarray:
        if self._of is not self.cps:
            self._blocks, self._of = blocks(self.cps), self.cps
        return self._blocks

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the pieces [begin, end): the same for equal pieces, wherever they stand.

        Each step is a bijection of the hash so far and of the next block, so no
        family of strings collides by construction; equal hashes of unequal
        pieces are a matter of chance (2^-64 a pair).
        """
        n = end - begin
        h = mix(n.astype(np.uint64) + _STEP)
        if not len(n):
            return h
        x = self.blocks
        far = n > LONG
        if far.any():
            import xxhash

            for i in np.flatnonzero(far).tolist():
                h[i] = xxhash.xxh3_64_intdigest(self.cps[begin[i] : end[i]].tobytes(), seed=7)
        live, begin, n = (np.flatnonzero(~far), begin[~far], n[~far]) if far.any() else (None, begin, n)
        own = h if live is None else h[live]
        most = int(n.max()) if len(n) else 0
        if most:
            own = mix(own * _STEP + (x[begin] & _MASKS[np.minimum(n, 3)]))
        some = np.arange(len(n))
        for j in range(3, most, 3):
            some = some[n[some] > j]
            own[some] = mix(own[some] * _STEP + (x[begin[some] + j] & _MASKS[np.minimum(n[some] - j, 3)]))
        if live is None:
            return own
        h[live] = own
        return h

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """begin, end and text number of every match of the byte-level BPE pattern
        's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ in order."""
        cps, n = self.cps, len(self.cps)
        c = classes()[cps]
        c[self.marks] = EDGE
        after = np.append(c[1:], EDGE)
        before = np.concatenate(([EDGE], c[:-1]))
        space = c == SPACE
        # the last white space of a run parts from it, unless the text ends there
        last = space & (after != SPACE) & (after != EDGE)
        joins = last & (cps == 32)
        start = np.where(space, last | (before != SPACE), (c != before) & ~np.concatenate(([False], joins[:-1])))
        start[self.marks] = True
        q = np.flatnonzero((cps == 39) & start)
        if len(q):
            at = lambda k: cps[np.minimum(q + k, n - 1)]
            one, two = at(1), at(2)
            short = np.isin(one, [115, 116, 109, 100])
            long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            for hit, size in ((short, 1), (long & ~short, 2)):
                p = q[hit]
                start[p + 1] = False
                rest = p + 1 + size
                start[rest[c[rest] == LETTER]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)
        keep = c[begin] != EDGE
        begin, end = begin[keep], end[keep]
        return begin, end, np.searchsorted(self.starts, begin, "right") - 1

    def words(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """begin, end and text number of every run of characters but ASCII white space; `lower` folds A-Z in place."""
        if lower:
            up = (self.cps >= 65) & (self.cps <= 90)
            self.cps = self.cps + (up * np.uint32(32))
        white = (self.cps == 32) | ((self.cps >= 9) & (self.cps <= 13))
        white[self.marks] = True
        edge = np.diff(np.concatenate(([1], white.view(np.int8))))
        begin = np.flatnonzero(edge == -1)
        end = np.flatnonzero(edge == 1)
        return begin, end, np.searchsorted(self.starts, begin, "right") - 1


def runs(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of `counts`, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class PieceCache:
    """What a function gives for each distinct piece of text, as arrays, kept over many batches.

    `compute(pieces)` gets new pieces and returns their values in one flat array
    and their numbers. Pieces are found by 64-bit hash and then compared code point
    by code point; the few that share a hash with another piece are kept by their
    text. Beyond `most` values or code points the cache starts anew, so its memory
    is bounded whatever the corpus.
    """

    def __init__(self, compute, most: int = 2_000_000, dtype=np.int32):
        self.compute, self.most, self.dtype = compute, most, dtype
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)  # sorted
        self.row = np.empty(0, np.int64)  # of each key
        self.others: dict[str, int] = {}  # rows of pieces whose hash stands for another piece
        self.first = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.at = np.empty(0, np.int64)  # where the piece's code points begin
        self.size = np.empty(0, np.int64)
        self.flat = np.empty(0, self.dtype)
        self.known = np.empty(0, np.uint64)  # blocks of the pieces' code points

    def _add(self, pieces: list[str]) -> np.ndarray:
        values, counts = self.compute(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rows = len(self.first) + np.arange(len(pieces))
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(counts) - counts))
        self.count = np.concatenate((self.count, counts))
        self.at = np.concatenate((self.at, len(self.known) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, np.asarray(values, self.dtype)))
        self.known = np.concatenate((self.known, blocks(np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32))))
        return rows

    def rows(self, t: Texts, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each piece its row: flat[first[row] : first[row] + count[row]] are its values. `t` may have changed case in place."""
        keys, where, back = np.unique(t.hashes(begin, end), return_index=True, return_inverse=True)
        if len(self.flat) > self.most or len(self.known) > self.most:
            self.clear()

        whole = t.text

        def text(i: int) -> str:
            return whole[begin[i] : end[i]]

        at = np.searchsorted(self.keys, keys)
        have = at < len(self.keys)
        have[have] = self.keys[at[have]] == keys[have]
        if not have.all():
            rows = self._add([text(i) for i in where[~have].tolist()])
            merged = np.concatenate((self.keys, keys[~have]))
            order = np.argsort(merged, kind="stable")
            self.keys, self.row = merged[order], np.concatenate((self.row, rows))[order]
            at = np.searchsorted(self.keys, keys)
        own = self.row[at][back]
        n = end - begin
        wrong = self.size[own] != n
        wrong[~wrong] = unequal(t.blocks, begin[~wrong], self.known, self.at[own[~wrong]], n[~wrong])
        for i in np.flatnonzero(wrong).tolist():
            piece = text(i)
            if piece not in self.others:
                self.others[piece] = int(self._add([piece])[0])
            own[i] = self.others[piece]
        return own

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The values of all pieces, one after another."""
        n = self.count[rows]
        return self.flat[np.repeat(self.first[rows], n) + runs(n)]


@functools.cache
def _ranks(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # the pieces come already split, so the pattern takes a piece whole
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def encode_pieces(path: str):
    """A function for PieceCache: BPE ids of pieces by the ranks in `path`."""

    def compute(pieces: list[str]):
        enc = _ranks(path)
        ids = [enc.encode_ordinary(p) for p in pieces]
        return np.fromiter((i for x in ids for i in x), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    return compute
