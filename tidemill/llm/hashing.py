"""Polynomial prefix hashes modulo 2**64 over byte or word sequences, and sliding minima, all in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20260101)
#: A random value for each byte, so that the hash does not follow byte order.
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
BASE_INVERSE = pow(BASE, -1, 2**64)
SECOND_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
SECOND_INVERSE = pow(SECOND_BASE, -1, 2**64)
U = np.uint64
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1)."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        a[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(a)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits; the low bits of a polynomial hash modulo 2**64 are weak."""
    h = h ^ (h >> U(32))
    h = h * U(0x9E3779B97F4A7C15)
    h = h ^ (h >> U(29))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


class Prefix:
    """Prefix hashes of a sequence: the hash of any stretch takes two lookups."""

    def __init__(self, values: np.ndarray, base: int = BASE, inverse: int = BASE_INVERSE):
        n = len(values)
        self.n = n
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])
        self.down = powers(inverse, n + 1)

    def every(self, width: int) -> np.ndarray:
        """Mixed hashes of all stretches of this width."""
        if self.n < width:
            return np.zeros(0, dtype=np.uint64)
        return mixed((self.sums[width:] - self.sums[: self.n + 1 - width]) * self.down[: self.n + 1 - width])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hashes of [start, end)."""
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of [start, end), told apart by length."""
        return mixed(self.raw(start, end) + (end - start).astype(np.uint64) * U(0x632BE59BD9B4E019))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from running minima of blocks of w."""
    n = len(h)
    if n < w:
        return h[:0]
    blocks = np.full((-(-n // w), w), np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks.ravel()[:n] = h
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def zones(values: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[Prefix, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut the window starts of several concatenated documents into zones that share a minimizer.

    values: a hash for each symbol; ends: for each symbol, where its document ends. A window's anchor is the leftmost
    of its least gram hashes, so equal windows have equal anchors at equal offsets.
    Returns the prefix hashes, each zone's first and last window start, its anchor and the anchor's gram hash."""
    prefix = Prefix(values)
    none = np.zeros(0, dtype=np.int64)
    n = len(values)
    if n < window:
        return prefix, none, none, none, none.view(np.uint64)
    grams = prefix.every(gram)
    order = (grams & ~U(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(order, window - gram + 1) & U(0xFFFFFF)).astype(np.int64)
    ok = np.arange(n - window + 1) + window <= ends[: n - window + 1]
    starts = np.flatnonzero(ok)
    if not len(starts):
        return prefix, none, none, none, none.view(np.uint64)
    a = anchor[starts]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = np.flatnonzero(new)
    lo, hi = starts[first], starts[np.append(first[1:], len(starts)) - 1]
    return prefix, lo, hi, a[first], grams[a[first]]
