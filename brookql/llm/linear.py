"""Small linear models over sparse rows, fitted with numpy on bounded samples.

The corpus classifiers fit on at most a documented number of labelled rows and score
all documents on the executors; this module holds the shared fitting code.
"""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of (column, value); bounds[i]:bounds[i+1] is row i."""

    def __init__(self, bounds: np.ndarray, column: np.ndarray, value: np.ndarray, width: int) -> None:
        self.bounds, self.column, self.value, self.width = bounds, column, value, width
        self.row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @classmethod
    def of(cls, rows: list[np.ndarray], width: int) -> Sparse:
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        column = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        return cls(bounds, column, np.ones(len(column)), width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], minlength=len(self))

    def dot_t(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * x[self.row], minlength=self.width)

    def only(self, columns: np.ndarray) -> Sparse:
        """The same rows without the columns that are not set in `columns`."""
        return Sparse(self.bounds, self.column, self.value * columns[self.column], self.width)

    def take(self, rows: np.ndarray) -> Sparse:
        size = np.diff(self.bounds)[rows]
        bounds = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(bounds[-1]) + np.repeat(self.bounds[rows] - bounds[:-1], size)
        return Sparse(bounds, self.column[at], self.value[at], self.width)


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, float)))


def logistic(x: Sparse, dense: np.ndarray, y: np.ndarray, l2: float = 2e-4, steps: int = 1500, weight: np.ndarray | None = None):
    """(sparse weights, dense weights, bias) of an L2 logistic regression, by accelerated gradient steps."""
    n = max(len(y), 1)
    weight = np.ones(len(y)) if weight is None else weight
    u, v, b = np.zeros(x.width), np.zeros(dense.shape[1]), 0.0
    pu, pv, pb = u.copy(), v.copy(), b
    # the largest eigenvalue of the Hessian, at most a quarter of the largest squared row norm's sum
    norm = np.bincount(x.row, x.value**2, minlength=len(x)) + (dense**2).sum(axis=1) + 1
    rate = 1.0 / (0.25 * float((weight * norm).sum() / n) + l2) if len(y) else 1.0
    for t in range(steps):
        m = t / (t + 3)
        qu, qv, qb = u + m * (u - pu), v + m * (v - pv), b + m * (b - pb)
        g = weight * (sigmoid(x.dot(qu) + dense @ qv + qb) - y) / n
        pu, pv, pb = u, v, b
        u = qu - rate * (x.dot_t(g) + l2 * qu)
        v = qv - rate * (dense.T @ g + l2 * qv)
        b = qb - rate * float(g.sum())
    return u, v, b


def hinge(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, epochs: int = 30, seed: int = 7):
    """(weights, bias) of a linear support vector machine on dense rows; y is -1 or 1.  Averaged Pegasos."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(x.shape[1]), 0.0
    aw, ab, n = np.zeros_like(w), 0.0, 0
    t = 0
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            t += 1
            rate = 1 / (l2 * (t + 1000))
            active = y[batch] * (x[batch] @ w + b) < 1
            rows = batch[active]
            w *= 1 - rate * l2
            w += rate / max(len(batch), 1) * (y[rows] @ x[rows])
            b += rate / max(len(batch), 1) * 0.1 * float(y[rows].sum())
            if epoch >= epochs // 2:
                aw += w
                ab += b
                n += 1
    return aw / max(n, 1), ab / max(n, 1)


def folds(ids: np.ndarray, k: int) -> np.ndarray:
    """A fold for each id, the same whatever the other ids are."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % k
