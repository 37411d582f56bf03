"""Conditional random fields over tokens: tokens of a slice of texts, hashed features, a linear chain.

Labels are O (0), begin (1), inside (2). A label that O beats whatever labels its neighbours may still
have is on no best path (dead-end elimination, round by round). ``decode``
drops tokens that only O is left to and decodes the runs between them: the same path as over the whole text.
"""

from __future__ import annotations

import numpy as np

from . import textkit as tk

BUCKETS = 1 << 12
LABELS = 3


def _kinds(inner: str) -> np.ndarray:
    """0: space, 1: characters that values are made of (and all beyond ASCII), 2: other marks."""
    t = np.full(256, 2, np.uint8)
    t[list(inner.encode())] = 1
    t[48:58] = t[65:91] = t[97:123] = 1
    t[128:] = 1
    t[[32, 9, 10, 11, 12, 13]] = 0
    return t


_FORM = np.arange(256, dtype=np.uint8)
_FORM[48:58], _FORM[65:91], _FORM[97:123] = 48, 65, 97


class Tokens:
    """Tokens of a slice: runs of one kind of character. Positions are bytes of the slice."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, inner: str):
        kind = _kinds(inner)[buf]
        n = len(buf)
        first = np.zeros(n + 1, bool)
        first[offs[:-1]] = True
        change = first[:n].copy()
        change[1:] |= kind[1:] != kind[:-1]
        cuts = np.append(np.flatnonzero(change), n)
        keep = kind[cuts[:-1]] != 0 if n else np.zeros(0, bool)
        self.buf, self.offs = buf, offs
        self.s, self.e = cuts[:-1][keep], cuts[1:][keep]
        self.doc = np.searchsorted(offs, self.s, "right") - 1
        self.kind = kind[self.s]
        self.h = tk.hashes(tk.lower(buf), self.s, self.e)
        share = lambda lo, hi: self._count((buf >= lo) & (buf <= hi))
        self.n = self.e - self.s
        self.digits, self.upper, self.lower = share(48, 57), share(65, 90), share(97, 122)
        self.high = share(128, 255)
        cls = np.zeros(n, np.uint8)
        cls[(buf >= 48) & (buf <= 57)] = 1
        cls[(buf >= 65) & (buf <= 90)] = 2
        swap = np.zeros(n, bool)
        swap[1:] = cls[1:] != cls[:-1]
        self.swaps = self._count(swap)

    def _count(self, flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return c[self.e] - c[self.s]

    def shape(self) -> np.ndarray:
        """A number below 1024: length band, kinds of characters, mixture."""
        length = np.searchsorted([3, 6, 8, 12, 16, 24, 32], self.n, "right")
        marks = self.n - self.digits - self.upper - self.lower - self.high
        has = (self.digits > 0) * 1 + (self.upper > 0) * 2 + ((self.lower > 0) | (self.high > 0)) * 4 + (marks > 0) * 8
        mix = np.searchsorted([2, 5, 9], self.swaps, "right")
        return ((length * 16 + has) * 4 + mix) * 2 + (self.high > 0)

    def pattern(self) -> np.ndarray:
        """A bucket for each form of token with digits, once digits and letters are made alike; 0 for the rest."""
        out = np.zeros(len(self.s), np.int64)
        at = np.flatnonzero(self.digits > 0)
        out[at] = (tk.hashes(_FORM[self.buf], self.s[at], self.e[at]) >> np.uint64(52)).astype(np.int64)
        return out

    def shifted(self, x: np.ndarray, by: int, none: int) -> np.ndarray:
        """x of the token ``by`` further on in the same text; ``none`` beyond its ends."""
        out = np.full(len(x), none, x.dtype)
        if by > 0:
            same = self.doc[by:] == self.doc[:-by]
            out[:-by][same] = x[by:][same]
        else:
            same = self.doc[:by] == self.doc[-by:]
            out[-by:][same] = x[:by][same]
        return out


def emissions(feats: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(feats[0]), LABELS), np.float32)
    for f, w in zip(feats, weights):
        out += w[f]
    return out


def chain_marginals(E: np.ndarray, T: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals, and expected transition counts, of one sequence."""
    n = len(E)
    X = np.exp(E - E.max(1, keepdims=True))
    A = np.exp(T)
    f, b = np.empty_like(X), np.ones_like(X)
    f[0] = X[0] / X[0].sum()
    for i in range(1, n):
        v = (f[i - 1] @ A) * X[i]
        f[i] = v / v.sum()
    for i in range(n - 2, -1, -1):
        v = A @ (X[i + 1] * b[i + 1])
        b[i] = v / v.sum()
    p = f * b
    p /= p.sum(1, keepdims=True)
    pair = f[:-1, :, None] * A * (X[1:] * b[1:])[:, None, :]
    pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
    return p, pair.sum(0)


def fit(seqs: list[tuple[list[np.ndarray], np.ndarray]], sizes: list[int], epochs: int = 6, rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights of each feature family (size x labels) and transitions, by AdaGrad on the log likelihood of (features, labels) sequences."""
    rng = np.random.default_rng(seed)
    W = [np.zeros((k, LABELS)) for k in sizes]
    G = [np.full((k, LABELS), 1e-2) for k in sizes]
    T, GT = np.zeros((LABELS, LABELS)), np.full((LABELS, LABELS), 1e-2)
    for _ in range(epochs):
        for i in rng.permutation(len(seqs)):
            feats, y = seqs[i]
            E = sum(w[f] for w, f in zip(W, feats))
            p, pair = chain_marginals(E, T)
            d = -p
            d[np.arange(len(y)), y] += 1
            for w, g, f in zip(W, G, feats):
                u, inv = np.unique(f, return_inverse=True)
                grad = np.zeros((len(u), LABELS))
                np.add.at(grad, inv, d)
                grad -= decay * w[u]
                g[u] += grad * grad
                w[u] += rate * grad / np.sqrt(g[u])
            seen = np.zeros_like(T)
            np.add.at(seen, (y[:-1], y[1:]), 1)
            grad = seen - pair - decay * T
            GT += grad * grad
            T += rate * grad / np.sqrt(GT)
    return [w.astype(np.float32) for w in W], T


def open_tokens(E: np.ndarray, T: np.ndarray, doc: np.ndarray, slack: float = 0.0, rounds: int = 8) -> np.ndarray:
    """Tokens that may be other than O on a best path, or within ``slack`` of it.

    Taking O for a token's label k changes its emission and two transitions. Where that gains for all
    labels that the neighbours may have, k is ruled out, which leaves the neighbours fewer in the next round.
    """
    n = len(E)
    before, after = T - T[:, :1], T - T[:1]  # gain of k over O after label a: [a, k]; ahead of label b: [k, b]
    gain = [E[:, k] - E[:, 0] + slack for k in range(LABELS)]
    may = [np.ones(n, bool)] + [gain[k] + (max(before[:, k].max(), 0) + max(after[k].max(), 0)) >= 0 for k in range(1, LABELS)]
    some = np.flatnonzero(may[1] | may[2])
    for _ in range(rounds):
        left, right = some - 1, np.minimum(some + 1, n - 1)
        first, last = (some == 0) | (doc[left] != doc[some]), (some == n - 1) | (doc[right] != doc[some])
        fresh = []
        for k in range(1, LABELS):
            lead, tail = np.full(len(some), before[0, k]), np.full(len(some), after[k, 0])
            for x in range(1, LABELS):
                lead = np.where(may[x][left], np.maximum(lead, before[x, k]), lead)
                tail = np.where(may[x][right], np.maximum(tail, after[k, x]), tail)
            fresh.append(may[k][some] & (gain[k][some] + np.where(first, 0, lead) + np.where(last, 0, tail) >= 0))
        same = all((f == may[k][some]).all() for k, f in enumerate(fresh, 1))
        for k, f in enumerate(fresh, 1):
            may[k][some] = f
        some = some[fresh[0] | fresh[1]]
        if same or not len(some):
            break
    return may[1] | may[2]


def viterbi(E: np.ndarray, T: np.ndarray) -> np.ndarray:
    """The best labels of one sequence; ties to the smaller label."""
    n = len(E)
    back = np.zeros((n, LABELS), np.int64)
    v = E[0].astype(np.float64)
    for i in range(1, n):
        m = v[:, None] + T
        back[i] = m.argmax(0)
        v = m.max(0) + E[i]
    y = np.empty(n, np.int64)
    y[-1] = v.argmax()
    for i in range(n - 1, 0, -1):
        y[i - 1] = back[i, y[i]]
    return y


def decode(E: np.ndarray, T: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Labels of all tokens of a slice, text by text."""
    y = np.zeros(len(E), np.int64)
    at = np.flatnonzero(open_tokens(E, T, doc)) if len(E) else np.zeros(0, int)
    if not len(at):
        return y
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(doc[at]) != 0)) + 1
    for run in np.split(at, cut):
        lo, hi = run[0], run[-1] + 1
        left = lo > 0 and doc[lo - 1] == doc[lo]
        right = hi < len(E) and doc[hi] == doc[hi - 1]
        e = E[lo:hi].astype(np.float64)
        if left:  # the certain O before and after
            e[0] += T[0]
        if right:
            e[-1] += T[:, 0]
        y[lo:hi] = viterbi(e, T)
    return y


def spans(y: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last token of each labelled stretch. Inside after O begins one."""
    prev = np.zeros(len(y), np.int64)
    prev[1:] = np.where(doc[1:] == doc[:-1], y[:-1], 0)
    begin = (y == 1) | ((y == 2) & (prev == 0))
    nxt = np.zeros(len(y), np.int64)
    nxt[:-1] = np.where(doc[1:] == doc[:-1], y[1:], 0)
    last = (y > 0) & (nxt != 2)
    return np.flatnonzero(begin), np.flatnonzero(last)
