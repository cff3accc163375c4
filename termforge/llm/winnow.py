"""Winnowing: positions of a byte string chosen by content, at least one in every stretch of ``span`` bytes.

A string shorter than ``span``, the empty one too, has no such stretch and no positions.
"""

from __future__ import annotations

import numpy as np

from termforge.llm.rolling import Rolling

_ROLL = Rolling(20240301)


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """The mixed 64-bit hash of each ``k`` consecutive bytes."""
    g, q = _ROLL.sums(b)
    x = (g[k:] - g[:-k]) * q[: len(b) - k + 1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _slide(x: np.ndarray, w: int, op, fill) -> np.ndarray:
    """``op`` over each ``w`` consecutive values, by running values within blocks of ``w`` from both ends."""
    n = len(x)
    y = np.concatenate([x, np.full(-n % w, fill, x.dtype)]).reshape(-1, w)
    left = op.accumulate(y, axis=1).ravel()
    right = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - w + 1], left[w - 1 : n])


def anchors(b: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the chosen grams: of each ``span`` consecutive bytes, the grams with the least hash.

    Which grams a stretch chooses depends on its bytes alone, so equal stretches choose the same.
    """
    w = span - k + 1
    if len(b) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(b, k)
    low = _slide(h, w, np.minimum, ~np.uint64(0))
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), w, np.maximum, np.uint64(0)) == h)
    return at, h[at]
