"""Linear-chain conditional random fields over many chains at once, in numpy."""

from __future__ import annotations

import math

import numpy as np


def chains(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of chains of at most `most` items; sequence i has counts[i] items, one after another."""
    n = -(-counts // most)
    base = np.cumsum(counts) - counts
    ends = np.cumsum(n)
    k = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    return np.repeat(base, n) + k * most, np.minimum(np.repeat(counts, n) - k * most, most)


def whole(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the sequences that have items."""
    base = np.cumsum(counts) - counts
    return base[counts > 0], counts[counts > 0]


class Crf:
    """Transition and start weights of L labels; emissions are given for each item."""

    def __init__(self, labels: int):
        self.trans = np.zeros((labels, labels))
        self.start = np.zeros(labels)

    def marginals(self, emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pairs: bool = False, block: int | None = None):
        """Forward-backward over whole chains: each item's label probabilities; with `pairs` also the expected transitions and starts.

        Chains are worked off in blocks, all at once, about as long as the longest
        chain has blocks. A block of a longer chain is an L x L operator on
        messages; the messages between blocks go through these, so nothing is cut
        at a block's edge.
        """
        block = block or max(64, math.isqrt(int(lengths.max())) if len(lengths) else 0)
        x = np.exp(emit - emit.max(axis=1, keepdims=True)) if len(emit) else emit
        t = np.exp(self.trans - self.trans.max())
        begin = np.exp(self.start - self.start.max())
        n_blocks = -(-lengths // block)
        s, n = chains(lengths, block)
        s = np.repeat(starts - (np.cumsum(lengths) - lengths), n_blocks) + s if len(s) else s
        first = np.cumsum(n_blocks) - n_blocks  # a chain's first block
        into = np.empty((len(s), len(t)))  # message to a block's first item, before its emission
        into[first] = begin
        back = np.ones((len(s), len(t)))  # message to its last item from what follows
        if len(long := np.flatnonzero(n_blocks > 1)):
            own = np.concatenate([np.arange(first[i], first[i] + n_blocks[i]) for i in long.tolist()])
            op = np.empty((len(s), len(t), len(t)))
            op[own] = self._operators(x, t, s[own], n[own])
            for k in range(int(n_blocks[long].max()) - 1):
                i = first[long[n_blocks[long] > k + 1]] + k
                v = np.einsum("na,nab->nb", into[i], op[i]) @ t
                into[i + 1] = v / v.sum(axis=1, keepdims=True)
                some = long[n_blocks[long] > k + 1]
                j = first[some] + n_blocks[some] - 1 - k
                v = np.einsum("nab,nb->na", op[j], back[j]) @ t.T
                back[j - 1] = v / v.sum(axis=1, keepdims=True)
        a, b = np.empty_like(x), np.ones_like(x)
        order = np.argsort(-n, kind="stable")
        s, n, into, back = s[order], n[order], into[order], back[order]
        longest = int(n[0]) if len(n) else 0
        live = np.searchsorted(-n, -np.arange(longest), "left")  # blocks longer than k
        if longest:
            b[s + n - 1] = back
        for k in range(longest):
            i = s[: live[k]] + k
            v = x[i] * (into if k == 0 else a[i - 1] @ t)
            a[i] = v / v.sum(axis=1, keepdims=True)
        for k in range(longest - 2, -1, -1):
            i = s[: live[k + 1]] + k
            v = (x[i + 1] * b[i + 1]) @ t.T
            b[i] = v / v.sum(axis=1, keepdims=True)
        m = a * b
        m /= m.sum(axis=1, keepdims=True) if len(m) else 1
        if not pairs:
            return m
        inner = np.ones(len(x), bool)
        inner[starts] = False
        j = np.flatnonzero(inner)
        ahead = x[j] * b[j]
        z = ((a[j - 1] @ t) * ahead).sum(axis=1, keepdims=True)
        return m, (a[j - 1] / z).T @ ahead * t, m[starts].sum(axis=0)

    @staticmethod
    def _operators(x: np.ndarray, t: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each block diag(x_1) prod(T diag(x_i)), up to a factor."""
        order = np.argsort(-n, kind="stable")
        s, n = s[order], n[order]
        op = np.eye(len(t))[None] * x[s][:, None]
        live = np.searchsorted(-n, -np.arange(int(n[0])), "left")
        for k in range(1, int(n[0])):
            v = (op[: live[k]].reshape(-1, len(t)) @ t).reshape(-1, *t.shape) * x[s[: live[k]] + k][:, None]
            op[: live[k]] = v / v.sum(axis=(1, 2), keepdims=True)
        out = np.empty_like(op)
        out[order] = op
        return out


class Adam:
    """Ascent steps for several arrays of weights."""

    def __init__(self, rate: float):
        self.rate, self.n, self.state = rate, 0, {}

    def step(self, **pairs: tuple[np.ndarray, np.ndarray]) -> None:
        self.n += 1
        for name, (w, g) in pairs.items():
            m, v = self.state.setdefault(name, (np.zeros_like(w), np.zeros_like(w)))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.99**self.n)) + 1e-8)


def fit(crf: Crf, emit, grad, labels: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: int, rate: float = 0.1, decay: float = 1e-6, block: int | None = None) -> None:
    """Maximise the conditional likelihood of `labels`. emit() gives the emissions, grad(residuals) takes (observed - expected)
    and returns pairs (weights, gradient) by name for the feature weights."""
    size = len(crf.start)
    seen = np.eye(size)[labels]
    inner = np.ones(len(labels), bool)
    inner[starts] = False
    j = np.flatnonzero(inner)
    moves = np.zeros_like(crf.trans)
    np.add.at(moves, (labels[j - 1], labels[j]), 1)
    first = seen[starts].sum(axis=0)
    adam = Adam(rate)
    for _ in range(steps):
        m, expected, begun = crf.marginals(emit(), starts, lengths, True, block)
        pairs = grad(seen - m)
        pairs |= {"trans": (crf.trans, moves - expected), "start": (crf.start, first - begun)}
        adam.step(**{k: (w, g / len(labels) - decay * w) for k, (w, g) in pairs.items()})
