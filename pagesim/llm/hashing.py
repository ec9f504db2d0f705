"""64-bit hashes of all words, and of all runs of words, of a batch of texts at once."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20_240_601)
_BYTES = _RANDOM.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the base modulo 2**64."""
    steps = np.full(n, base % (1 << 64), np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


#: Powers of the base and of its inverse within a block; any other is one of these times a power of a whole block's.
_WITHIN, _BACK_WITHIN = _powers(_BASE, _BLOCK), _powers(_BACK, _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class ByteSums:
    """Running sums from which the hash of any part of a byte string is a difference."""

    def __init__(self, data: np.ndarray):
        blocks = len(data) // _BLOCK + 1
        self.back = _powers(pow(_BACK, _BLOCK, 1 << 64), blocks)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        for k, power in enumerate(_powers(pow(_BASE, _BLOCK, 1 << 64), blocks)):
            part = data[k * _BLOCK:(k + 1) * _BLOCK]
            self.sums[1 + k * _BLOCK:][:len(part)] = _BYTES[part] * (_WITHIN[:len(part)] * power)
        np.cumsum(self.sums, out=self.sums)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal parts have equal hashes, wherever they lie."""
        back = _BACK_WITHIN[starts % _BLOCK] * self.back[starts // _BLOCK]
        return mix((self.sums[ends] - self.sums[starts]) * back)
