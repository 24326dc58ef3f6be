"""Linear models over sparse indicator rows, fitted on the driver.

A row is an ascending array of distinct feature numbers.  Only bounded samples
come here (the callers' documented parameter); models are plain arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def log_count_ratios(rows: Sequence[np.ndarray], y: np.ndarray, dims: int, alpha: float = 1.0) -> np.ndarray:
    """Per feature log((p / |p|) / (q / |q|)) of its smoothed counts in class 1 and 0."""
    p, q = np.full(dims, alpha), np.full(dims, alpha)
    for row, label in zip(rows, y, strict=True):
        (p if label else q)[row] += 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: Sequence[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 0.1, epochs: int = 8, seed: int = 5, dense: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Hinge loss by dual coordinate descent: weights (already times scale), dense weights, bias.

    Minimises |w|^2 / 2 + c * sum of max(0, 1 - y (w x + b)) over x = scale of
    each present feature, length-normalised, and the dense columns.
    """
    n, dims = len(rows), len(scale)
    dense = np.zeros((n, 0)) if dense is None else dense
    w, v, b = np.zeros(dims), np.zeros(dense.shape[1]), 0.0
    sign = np.where(np.asarray(y) > 0, 1.0, -1.0)
    values = [scale[r] for r in rows]
    norm = np.array([1.0 / max(np.sqrt(float(x @ x)), 1e-9) for x in values])
    values = [x * k for x, k in zip(values, norm, strict=True)]
    diag = np.array([float(x @ x) for x in values]) + 1.0 + (dense**2).sum(axis=1)
    alpha, order = np.zeros(n), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(n):
            r, x, s = rows[i], values[i], sign[i]
            gradient = s * (float(w[r] @ x) + float(v @ dense[i]) + b) - 1.0
            new = min(max(alpha[i] - gradient / diag[i], 0.0), c)
            step = (new - alpha[i]) * s
            if step:
                alpha[i] = new
                w[r] += step * x
                v += step * dense[i]
                b += step
    return w, v, b


def decision(rows: Sequence[np.ndarray], scale: np.ndarray, w: np.ndarray, b: float, dense: np.ndarray | None = None, v: np.ndarray | None = None) -> np.ndarray:
    out = np.empty(len(rows))
    for i, r in enumerate(rows):
        x = scale[r]
        out[i] = float(w[r] @ x) / max(np.sqrt(float(x @ x)), 1e-9) + b
    return out if dense is None else out + dense @ v


def sigmoid_fit(f: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Platt's scaling: P(y = 1) = 1 / (1 + exp(-(a f + b))), by Newton steps."""
    y = np.asarray(y, dtype=float)
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, np.log((up + 1) / (down + 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -35, 35)))
        g, s = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * f * f).sum() + 1e-3, (s * f).sum()], [(s * f).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, np.array([(g * f).sum() + 1e-3 * (a - 1.0), g.sum()]))
        size = np.abs(d).max()
        d *= min(1.0, 2.0 / max(size, 1e-12))
        a, b = a - d[0], b - d[1]
        if size < 1e-8:
            break
    return float(a), float(b)


def probability(f: np.ndarray, a: float, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * f + b, -35, 35)))
