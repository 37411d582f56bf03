"""Array kernels over Arrow string batches: word bounds, 64-bit word hashes, shingles.

All work on bytes of UTF-8; a null text counts as empty. Texts are taken in slices of a few
MB, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
K1, K2, K3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
SLICE = 1 << 21

# Bytes of [\x20\x09-\x0D].
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE, rows: int = 2000):
    """(first row, row past the last, bytes, offsets from the slice's start) of each slice."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1), lo + rows)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def fmix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * K2
    h = (h ^ (h >> U(27))) * K3
    return h ^ (h >> U(31))


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes as they are."""
    return _LOWER[buf]


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of true bytes within one text."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of ``[^\\x20\\x09-\\x0D]``."""
    return runs(~_SPACE[buf], offs)


def hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes at a time."""
    n = e - s
    h = n.astype(U) * K1
    if not len(s):
        return h
    room = -len(buf) % 8 + 16
    wide = np.concatenate([buf, np.zeros(room, np.uint8)]).view("<u8")
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
    at, k = np.arange(len(s)), 0
    while len(at):
        p = s[at] + k
        left = np.minimum(n[at] - k, 8)
        shift = ((p & 7) << 3).astype(U)
        i = p >> 3
        x = (wide[i] >> shift) | ((wide[i + 1] << (U(63) - shift)) << U(1))
        g = (h[at] ^ (x & mask[left])) * K2
        h[at] = g ^ (g >> U(29))
        k += 8
        at = at[n[at] > k]
    return fmix(h)


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of k hashes; h[i] heads window i. Only len(h) - k + 1 windows."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, k, U)
    for i in range(k):
        out = (out + h[i : i + n]) * K1
        out ^= out >> U(32)
    return fmix(out)


def chars_before(buf: np.ndarray) -> np.ndarray:
    """Code points that begin before each byte, and in all."""
    return np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
