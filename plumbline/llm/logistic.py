"""Logistic calibration of a raw score, or of a few that are weighed together."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3) -> tuple[float | np.ndarray, float]:
    """Slope and offset of P(y = 1) = 1 / (1 + exp(-(slope * x + offset))), by Newton steps.

    With one class only, the slope is 1 and the offset is far on that side. ``x`` may have
    several columns, each of which speaks for y = 1; then there is a slope for each, and one
    that would be negative is 0.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    if x.ndim == 2:
        slopes, kept = np.zeros(x.shape[1]), np.arange(x.shape[1])
        while len(kept):
            found, offset = _fit(x[:, kept], y, weight, ridge)
            if found.min() >= 0 or len(kept) == 1:
                slopes[kept] = found
                break
            kept = np.delete(kept, found.argmin())
        return slopes, offset
    slopes, offset = _fit(x[:, None], y, weight, ridge)
    return float(slopes[0]), offset


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None, ridge: float) -> tuple[np.ndarray, float]:
    if len(x) == 0:
        return np.ones(x.shape[1]), 0.0
    if y.min() == y.max():
        return np.ones(x.shape[1]), 3.0 if y[0] else -3.0
    weight = np.ones(len(x)) if weight is None else np.asarray(weight, float)
    weight = weight / weight.sum() * len(x)
    centre, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    b = np.zeros(z.shape[1])
    penalty = np.diag([ridge * len(x)] * x.shape[1] + [1e-9])

    def loss(b):
        m = z @ b
        return float(weight @ (np.logaddexp(0, m) - y * m) + b @ penalty @ b / 2)

    now = loss(b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -35, 35)))
        slope = z.T @ (weight * (p - y)) + penalty @ b
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty + np.eye(len(b)) * 1e-9
        step = np.linalg.solve(curve, slope)
        t = 1.0
        while t > 1e-6 and loss(b - t * step) > now:
            t /= 2
        b = b - t * step
        last, now = now, loss(b)
        if abs(last - now) < 1e-9 * (1 + abs(now)):
            break
    return b[:-1] / scale, float(b[-1] - (b[:-1] * centre / scale).sum())
