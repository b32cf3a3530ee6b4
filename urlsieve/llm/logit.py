"""Logistic regression on hashed n-grams, fitted on a bounded labelled sample and scored in Arrow batches.

Features are means over a row's n-grams, one group of n-grams after another, so a score needs one gather per n-gram.
The fit is full-batch gradient descent with per-coordinate step sizes: no randomness, so the same sample gives the same
weights on every run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SCALE = 24.0


@dataclass
class Logit:
    """``weights`` over buckets, ``bias``, and the calibration ``a * score + b`` of the log-odds."""

    weights: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * (score + self.bias) + self.b, -500, 500)))


def row_means(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Mean of ``values`` by row; 0 for rows without any."""
    count = np.bincount(rows, minlength=n)
    return np.bincount(rows, values, minlength=n) / np.maximum(count, 1)


def score(weights: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Sum over groups (bucket and row of each n-gram) of the row's scaled mean weight."""
    total = np.zeros(n)
    for buckets, rows in groups:
        total += SCALE * row_means(weights[buckets], rows, n)
    return total


Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def entries(groups: list[tuple[np.ndarray, np.ndarray]], n: int, dim: int) -> Entries:
    """Bucket, row and value of each nonzero feature of ``n`` rows, in 12 bytes an entry."""
    out = []
    for b, r in groups:
        key, count = np.unique(r.astype(np.int64) * dim + b, return_counts=True)
        row = (key // dim).astype(np.int32)
        size = np.maximum(np.bincount(r, minlength=n), 1)
        out.append(((key % dim).astype(np.int32), row, (SCALE * count / size[row]).astype(np.float32)))
    return tuple(map(np.concatenate, zip(*out)))


def fit(features: Entries, y: np.ndarray, dim: int, l2: float = 1e-3, steps: int = 150, rate: float = 0.3) -> Logit:
    """Weights for P(y = 1); every fourth row is held out of the fit and calibrates the probabilities (Platt scaling).

    With a single class, or no rows, the model is the constant base rate (smoothed)."""
    n = len(y)
    base = (float(y.sum()) + 0.5) / (n + 1)
    if n < 8 or y.min() == y.max():
        return Logit(np.zeros(dim, np.float32), float(np.log(base / (1 - base))))
    held = np.arange(n) % 4 == 3
    if y[~held].min() == y[~held].max() or y[held].min() == y[held].max():
        held[:] = False
    bucket, row, value = features
    train = ~held
    use = train[row]
    b, r, v = bucket[use], row[use], value[use]
    w, bias, seen, seen0 = np.zeros(dim), float(np.log(base / (1 - base))), np.full(dim, 1e-8), 1e-8
    m = train.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(r, w[b] * v, minlength=n) + bias)))
        d = np.where(train, p - y, 0) / m
        g = np.bincount(b, d[r] * v, minlength=dim) + l2 * w / m
        seen += g * g
        w -= rate * g / np.sqrt(seen)
        seen0 += d.sum() ** 2
        bias -= rate * d.sum() / np.sqrt(seen0)
    model = Logit(w.astype(np.float32), bias)
    if held.any():
        model.a, model.b = _platt(np.bincount(row, model.weights[bucket] * value, minlength=n)[held] + bias, y[held])
    return model


def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method for P(y) = 1 / (1 + exp(-(a s + b))) with smoothed targets; ``a`` stays positive."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -500, 500)))
        d, h = p - target, p * (1 - p) + 1e-9
        g0, g1 = (d * s).sum() + 1e-3 * (a - 1), d.sum()
        h00, h01, h11 = (h * s * s).sum() + 1e-3, (h * s).sum(), h.sum()
        det = h00 * h11 - h01 * h01
        if det <= 0:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        size = max(abs(da), abs(db), 1.0)
        a, b = a - da / size, b - db / size
        if abs(da) + abs(db) < 1e-9:
            break
    return max(a, 1e-3), b
