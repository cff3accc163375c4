"""Hashes of all stretches of a byte string from one pass of prefix sums."""

from __future__ import annotations

import numpy as np


class Rolling:
    """A random hash of bytes: the stretch s..e of ``b`` hashes to (sums[e] - sums[s]) * shift[s], wherever it stands."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
        self.base = int(rng.integers(0, 1 << 62)) * 4 + 3
        self.back = pow(self.base, -1, 1 << 64)
        self.p = self.q = np.ones(1, np.uint64)

    def sums(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, shift) of the bytes ``b``, each one longer than ``b``."""
        n = len(b)
        while len(self.p) < n + 1:
            m = len(self.p)
            self.p = np.concatenate([self.p, self.p * np.uint64(pow(self.base, m, 1 << 64))])
            self.q = np.concatenate([self.q, self.q * np.uint64(pow(self.back, m, 1 << 64))])
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[b] * self.p[:n])]), self.q[: n + 1]
