"""Positions on a Hilbert curve of many dimensions."""

from __future__ import annotations

import numpy as np


def positions(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of grid cells (row x dimension, numbers under 2^bits).

    dimension x bits may not exceed 63. Bits are handled from the highest down: a bit that
    is set mirrors the lower bits of the first dimension, one that is not swaps them with
    it; the result in Gray code is then decoded, and the dimensions' bits interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(dims):
            is_set = (x[i] >> bit) & 1
            swap = np.where(is_set == 1, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(is_set == 1, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out
