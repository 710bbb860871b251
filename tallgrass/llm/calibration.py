"""Monotone calibration of scores, on bounded samples."""

from __future__ import annotations

import numpy as np


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x ascending, y not falling) of the isotonic regression of labels on scores: pool adjacent violators over tied scores. Each pool counts half a case of either label more, so that no knot says 0 or 1."""
    x, at = np.unique(scores, return_inverse=True)
    n = np.bincount(at).astype(float)
    s = np.bincount(at, weights=labels.astype(float))
    pools: list[list[float]] = []  # sum, count, first x, last x
    for k in range(len(x)):
        pools.append([s[k], n[k], x[k], x[k]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            b = pools.pop()
            a = pools[-1]
            a[0] += b[0]
            a[1] += b[1]
            a[3] = b[3]
    xs, ys = [], []
    for total, count, lo, hi in pools:
        y = (total + 0.5) / (count + 1)
        xs += [lo] if lo == hi else [lo, hi]
        ys += [y] if lo == hi else [y, y]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


def apply(knots: tuple[np.ndarray, np.ndarray], scores: np.ndarray) -> np.ndarray:
    """Between knots the calibrated score is linear, beyond them constant; without knots it is one half."""
    xs, ys = knots
    return np.interp(scores, xs, ys) if len(xs) else np.full(len(scores), 0.5)
