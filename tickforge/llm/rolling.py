"""Vectorised hashing of byte runs and windows, and winnowing; NumPy only.

Hashes are polynomials over 64-bit words with wrap-around and a random 64-bit value per symbol, mixed at the end, so
the hash of any window follows from two prefix sums. Values are stable between runs and machines.
"""

from __future__ import annotations

import functools

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE, dtype=np.uint64)
    down = np.full(n, INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(n).bit_length()))


class Prefix:
    """Window hashes of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def windows(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of [lo, hi) for arrays of bounds."""
        return mix64((self.sums[hi] - self.sums[lo]) * self.down[lo])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all windows of k symbols, not yet mixed: ``mix64`` makes those of ``windows`` of them."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        out = self.sums[k:] - self.sums[:-k]
        out *= self.down[: n - k + 1]
        return out


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def word_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return Prefix(BYTE_VALUES[data]).windows(lo, hi)


def _slide(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """The best of each window of w values, by doubling; as long as x minus w - 1."""
    k = 1
    while 2 * k <= w:
        x = best(x[:-k], x[k:])
        k *= 2
    return best(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least gram hash (its upper 32 bits) in each window of w grams; ties are all kept, so what is
    chosen in a window depends on its content alone."""
    n = len(grams)
    if n < w:
        return np.zeros(0, dtype=np.int64)
    high = (grams >> np.uint64(32)).astype(np.uint32)
    # a position is chosen if it is the least of some window that holds it: the largest of those windows' least values
    wide = np.zeros(n + w - 1, dtype=np.uint32)
    wide[w - 1 : n] = _slide(high, w, np.minimum)
    return np.flatnonzero(_slide(wide, w, np.maximum) == high)
