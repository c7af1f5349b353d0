"""SetSketch registers of hashed sets, and likelihood estimates from two of them.

A register holds ``floor(1 - log_b(x))``, cut to ``0 .. LIMIT``, for the least of the
exponential variates that the set's elements draw for it (rate ``RATE``).  Thus registers
of a union are the element-wise maxima, and two registers are equal with a probability
that grows with the sets' similarity, for a base near 1 nearly the Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

BASE = 1.001
RATE = 20.0
LIMIT = (1 << 16) - 1


def _multipliers(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    return rng.integers(0, 2**63, m, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, m, np.uint64)


def registers(elements: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """``m`` registers for each stretch of ``elements`` that begins at ``starts``; none is empty."""
    by, plus = _multipliers(m)
    least = np.empty((len(starts), m), np.uint64)
    for j in range(m):
        least[:, j] = np.minimum.reduceat((elements ^ plus[j]) * by[j], starts)
    uniform = (least.astype(np.float64) + 1.0) * 2.0**-64
    variate = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1.0 - np.log(variate) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def merge(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(one, two)


def jaccard(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity, pair by pair, given registers (rows) and set sizes.

    The counts of greater, smaller and equal registers are multinomial; their
    probabilities depend on the similarity alone once sizes are known.  The
    log-likelihood is concave, so its slope is bisected.
    """
    share = n_one / (n_one + n_two)
    other = 1.0 - share
    more, less = (one > two).sum(1), (one < two).sum(1)
    same = one.shape[1] - more - less
    scale = (BASE - 1) / BASE

    def p(x):
        return -np.log1p(-scale * x) / np.log(BASE)

    def dp(x):
        return scale / (1 - scale * x) / np.log(BASE)

    low, high = np.zeros(len(share)), np.minimum(share / other, other / share)
    for _ in range(40):
        mid = (low + high) / 2
        x, y = np.maximum(share - other * mid, 1e-12), np.maximum(other - share * mid, 1e-12)
        px, py, dx, dy = p(x), p(y), -other * dp(x), -share * dp(y)
        slope = more * dx / px + less * dy / py - same * (dx + dy) / np.maximum(1 - px - py, 1e-12)
        up = slope > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2
