"""Interpolating cubic spline through a handful of points (driver helper of
the calibration, M8/M10).

Not-a-knot end conditions: an interpolating smoothing spline with zero
smoothing places its interior knots at ``x[2] … x[-3]``, which is the same
curve.  Outside the data the end pieces are extended (extrapolation).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class CubicSpline:
    x: np.ndarray
    y: np.ndarray
    sigma: np.ndarray  # second derivatives at the knots

    def __call__(self, t) -> np.ndarray:
        t = np.asarray(t, dtype=float)
        x, y, s = self.x, self.y, self.sigma
        i = np.clip(np.searchsorted(x, t, side="right") - 1, 0, len(x) - 2)
        h = x[i + 1] - x[i]
        a = x[i + 1] - t
        b = t - x[i]
        return (s[i] * a ** 3 / (6 * h) + s[i + 1] * b ** 3 / (6 * h)
                + (y[i] / h - s[i] * h / 6) * a + (y[i + 1] / h - s[i + 1] * h / 6) * b)


def fit_not_a_knot(x, y) -> CubicSpline:
    """Fit through ``(x, y)``; ``x`` must be strictly increasing, len ≥ 4."""
    x = np.asarray(x, dtype=float)
    y = np.asarray(y, dtype=float)
    n = len(x)
    if n < 4:
        raise ValueError("need at least four points")
    h = np.diff(x)
    if np.any(h <= 0):
        raise ValueError("x must be strictly increasing")
    a = np.zeros((n, n))
    r = np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1] = h[i - 1]
        a[i, i] = 2 * (h[i - 1] + h[i])
        a[i, i + 1] = h[i]
        r[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    # third derivative continuous at x[1] and x[n-2]
    a[0, 0], a[0, 1], a[0, 2] = h[1], -(h[0] + h[1]), h[0]
    a[n - 1, n - 3], a[n - 1, n - 2], a[n - 1, n - 1] = h[n - 2], -(h[n - 3] + h[n - 2]), h[n - 3]
    sigma = np.linalg.solve(a, r)
    return CubicSpline(x, y, sigma)


def make_increasing(x, eps: float = 1e-12) -> tuple[np.ndarray, bool]:
    """Isotonic guard (D27): running maximum plus a tiny step where values tie
    or fall.  Returns the guarded values and whether anything changed."""
    x = np.asarray(x, dtype=float).copy()
    changed = False
    for i in range(1, len(x)):
        floor = x[i - 1] + eps * max(1.0, abs(x[i - 1]))
        if x[i] < floor:
            x[i] = floor
            changed = True
    return x, changed
