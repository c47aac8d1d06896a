"""Token ids of many texts at once, each distinct piece encoded once."""

from __future__ import annotations

import numpy as np

from mendery.llm.common import only
from mendery.llm.textvec import PieceCache, Texts, encode_pieces

#: The one special token of the public byte-level vocabulary, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


class Encoder:
    """Byte-level BPE by the ranks in a file; pieces are cut by the vocabulary's pattern."""

    def __init__(self, path: str):
        self.cache = PieceCache(encode_pieces(path))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        t = Texts(texts)
        begin, end, of = t.matches()
        if not len(begin):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        rows = self.cache.rows(t, begin, end)
        counts = np.bincount(of, self.cache.count[rows], len(texts)).astype(np.int64)
        return self.cache.gather(rows), counts

    def encode_special(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), but the special token's string is its id, as a tokenizer with that added token gives."""
        if not any(SPECIAL in x for x in texts):
            return self.encode(texts)
        parts = [x.split(SPECIAL) for x in texts]
        ids, n = self.encode([p for x in parts for p in x])
        cut = np.split(ids, np.cumsum(n)[:-1])
        out, counts, at = [], [], 0
        for x in parts:
            own = cut[at : at + len(x)]
            at += len(x)
            for i, p in enumerate(own):
                out += [[SPECIAL_ID], p] if i else [p]
            counts.append(sum(map(len, own)) + len(x) - 1)
        return np.concatenate([np.asarray(p, np.int32) for p in out]), np.asarray(counts, np.int64)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file."""
    return only(("encoder", path), lambda: Encoder(path))
