"""A keyed permutation of 0 .. n-1: balanced Feistel rounds on the next even bit width, with cycle-walking.

Vectorised: `rank(k)` of an index array costs a few numpy passes. The domain is below 4 n, so cycle-walking takes fewer than four rounds on average.
"""

from __future__ import annotations

import numpy as np

from metaweave.llm.common import U64, mix


class Permutation:
    def __init__(self, n: int, key: int, rounds: int = 6):
        if n < 0:
            raise ValueError("n must not be negative")
        self.n = n
        self.half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.keys = mix(np.arange(1, rounds + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(key & (2**64 - 1)))

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        half, mask = U64(self.half), U64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        # the halves are swapped at the end, so that the inverse is the same network with its keys reversed
        return (right << half) | left

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        x = np.asarray(x).astype(U64)
        if len(x) and int(x.max()) >= self.n:
            raise ValueError("index beyond the domain")
        y = self._once(x, keys)
        out = np.flatnonzero(y >= U64(self.n))
        while len(out):
            y[out] = self._once(y[out], keys)
            out = out[y[out] >= U64(self.n)]
        return y.astype(np.int64)

    def rank(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys)

    def index(self, rank: np.ndarray) -> np.ndarray:
        return self._walk(rank, self.keys[::-1])
