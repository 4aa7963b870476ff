"""64-bit hashing of byte strings and integers with numpy; all arithmetic wraps."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LIMIT = 1 << 20
_tables: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = np.asarray(x).astype(U) + U((seed * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(32))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64, kept between calls up to a fixed length."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, min(_LIMIT, 2 * n)), base, U)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(steps)
        if len(have) <= 16 * _LIMIT:
            _tables[base] = have
    return have[:n]


class PrefixHash:
    """Polynomial hashes of any substrings of one byte buffer."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, U)
            np.cumsum((data.astype(U) + U(1)) * _powers(_BASE, n), out=self.sums[1:])
        self.shift = _powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.shift[start] + (end - start).astype(U))

    def windows(self, length: int) -> np.ndarray:
        """Hash of every substring of this length, in order."""
        with np.errstate(over="ignore"):
            return mix((self.sums[length:] - self.sums[:-length]) * self.shift[: len(self.sums) - length])


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space in a byte buffer."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
