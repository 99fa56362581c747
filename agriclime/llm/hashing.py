"""Vectorised words and 64-bit hashes over flat text buffers.

A span's hash is a polynomial in the bytes' random numbers modulo 2^64, taken from
prefix sums, and mixed; equal bytes give equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

_NUMBERS = np.random.default_rng(64)
_BYTE = _NUMBERS.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Words are runs of anything but blanks and the control characters 9 to 13.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, count, dtype=np.uint64)


def words(data: np.ndarray, starts: np.ndarray, blank: np.ndarray = BLANK):
    """Start and end of every word, and each text's first word (one more at the end)."""
    inside = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    begin = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return begin, end, np.searchsorted(begin, starts)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    if count:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes any span's hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    raw = (sums[end] - sums[begin]) * _powers(_INVERSE, len(sums))[begin]
    return mix(raw + (end - begin).astype(np.uint64))
