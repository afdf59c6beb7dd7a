"""The lower real branch of Lambert's W function, on [-1/e, 0)."""

from __future__ import annotations

import numpy as np


def lambert_wm1(x: np.ndarray) -> np.ndarray:
    """W with W exp(W) = x and W <= -1; NaN outside the domain.

    In logarithms the equation is w = ln(-x) - ln(-w): Newton's method on f(w) = w + ln(-w) - ln(-x), from a series
    around the branch point near -1/e and from the asymptotic expansion near 0.
    """
    x = np.asarray(x, dtype=float)
    out = np.full(x.shape, np.nan)
    ok = (x >= -1 / np.e) & (x < 0)
    z = x[ok]
    log = np.log(-z)
    p = -np.sqrt(np.maximum(0.0, 2 * (1 + np.e * z)))
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(z < -0.25, -1 + p - p * p / 3 + 11 / 72 * p**3, log - np.log(-log) + np.log(-log) / log)
        for _ in range(12):
            step = (w + np.log(-w) - log) / (1 + 1 / w)
            step = np.where(np.isfinite(step), step, 0.0)
            w = np.minimum(w - step, -1.0)
    out[ok] = w
    return out
