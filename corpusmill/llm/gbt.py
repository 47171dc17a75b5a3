"""Gradient-boosted trees: fitted on a bounded table on the driver, applied as a SQL expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class BoostedTrees:
    """Logistic boosting of depth-limited trees over numeric features; deterministic."""

    def __init__(self, features: list[str], trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 8):
        self.features, self.count, self.depth, self.rate, self.bins, self.least = features, trees, depth, rate, bins, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.base, self.trees = float(np.log(share / (1 - share))), []
        if len(np.unique(y)) < 2:
            return self
        cuts = [self._cuts(x[:, j]) for j in range(x.shape[1])]
        raw = np.full(len(y), self.base)
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(x, y - p, p * (1 - p), cuts, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            raw += self._apply(tree, x)
        return self

    def _cuts(self, values: np.ndarray) -> np.ndarray:
        seen = np.unique(values)
        if len(seen) > self.bins:
            seen = np.unique(np.quantile(values, np.linspace(0, 1, self.bins + 1)))
        return (seen[1:] + seen[:-1]) / 2

    def _grow(self, x, gradient, hessian, cuts, rows, depth):
        g, h = gradient[rows].sum(), hessian[rows].sum()
        leaf = float(self.rate * g / (h + 1))
        best = (1e-6, None, None)
        if depth:
            for j, points in enumerate(cuts):
                if not len(points):
                    continue
                place = np.searchsorted(points, x[rows, j], side="right")
                gl = np.cumsum(np.bincount(place, gradient[rows], len(points) + 1))[:-1]
                hl = np.cumsum(np.bincount(place, hessian[rows], len(points) + 1))[:-1]
                nl = np.cumsum(np.bincount(place, minlength=len(points) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(nl < self.least) | (len(rows) - nl < self.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, float(points[k]))
        _, j, point = best
        if j is None:
            return leaf
        left = x[rows, j] < point
        return j, point, self._grow(x, gradient, hessian, cuts, rows[left], depth - 1), self._grow(x, gradient, hessian, cuts, rows[~left], depth - 1)

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        j, point, left, right = tree
        return np.where(x[:, j] < point, self._apply(left, x), self._apply(right, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + sum((self._apply(t, x) for t in self.trees), np.zeros(len(x))))))

    def expression(self, of) -> Column:
        """The probability as a SQL expression; of(name) is a feature's column."""
        raw = F.lit(self.base)
        for tree in self.trees:
            raw = raw + self._case(tree, of)
        return 1 / (1 + F.exp(-raw))

    def _case(self, tree, of) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        j, point, left, right = tree
        return F.when(of(self.features[j]) < point, self._case(left, of)).otherwise(self._case(right, of))


def threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest cut at which the accepted rows of a held-out table have the precision; 2 (nothing passes) if there is none."""
    order = np.argsort(-score)
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(right >= precision)
    return float(score[order][fine[-1]]) - 1e-9 if len(fine) else 2.0
