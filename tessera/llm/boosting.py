"""A small gradient-boosted tree classifier: fitted on the driver from a bounded labelled table, evaluated as a Spark expression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Boosted:
    """Logistic boosting with depth-limited trees, Newton leaves and Platt calibration."""

    features: list[str]
    rounds: int = 24
    depth: int = 3
    rate: float = 0.3
    ridge: float = 1.0
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    trees: list = field(default_factory=list)

    def _grow(self, x, g, h, depth):
        leaf = float(-self.rate * g.sum() / (h.sum() + self.ridge))
        if not depth or len(x) < 8:
            return leaf
        gain = lambda a, b: a * a / (b + self.ridge)
        best = (1e-6, None, None)
        for j in range(x.shape[1]):
            for t in np.unique(x[:, j])[1:]:
                left = x[:, j] < t
                gl, hl = g[left].sum(), h[left].sum()
                new = gain(gl, hl) + gain(g.sum() - gl, h.sum() - hl) - gain(g.sum(), h.sum())
                if new > best[0]:
                    best = (new, j, float(t))
        if best[1] is None:
            return leaf
        left = x[:, best[1]] < best[2]
        return (best[1], best[2], self._grow(x[left], g[left], h[left], depth - 1), self._grow(x[~left], g[~left], h[~left], depth - 1))

    def _tree(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        j, t, low, high = tree
        return np.where(x[:, j] < t, self._tree(low, x), self._tree(high, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((self._tree(t, x) for t in self.trees), np.zeros(len(x)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Trees from all rows; probabilities are uncalibrated until calibrate()."""
        rate = min(max(y.mean(), 0.01), 0.99)
        self.bias, self.trees = float(np.log(rate / (1 - rate))), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-self.margin(x)))
            self.trees.append(self._grow(x, p - y, p * (1 - p), self.depth))
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt's slope and shift from rows the trees were not fitted on."""
        m, w = self.margin(x), np.array([1.0, 0.0])
        for _ in range(60):  # Newton steps of bounded length, held near (1, 0) by a weak prior
            p = 1 / (1 + np.exp(-np.clip(w[0] * m + w[1], -30, 30)))
            d = np.stack([m, np.ones_like(m)])
            step = np.linalg.solve((d * (p * (1 - p))) @ d.T + np.eye(2), d @ (p - y) + (w - [1, 0]))
            w = w - step / max(1.0, 4 * float(np.abs(step).max()))
        self.slope, self.shift = max(float(w[0]), 0.05), float(w[1])

    def threshold(self, x: np.ndarray, y: np.ndarray, precision: float) -> float:
        """The probability from which on these rows reach the precision; above 1 if none does.

        It lies half way between the lowest such probability that occurs and the next lower one.
        """
        p = self.predict(x)
        seen = np.unique(p)
        good = [i for i, c in enumerate(seen) if y[p >= c].mean() >= precision]
        return float((seen[good[0]] + (seen[good[0] - 1] if good[0] else 0.0)) / 2) if good else 1.1

    def expression(self, row: Column) -> Column:
        """The calibrated probability as a Spark expression over a struct with the features."""

        def node(tree):
            if isinstance(tree, float):
                return F.lit(tree)
            j, t, low, high = tree
            return F.when(row[self.features[j]] < t, node(low)).otherwise(node(high))

        total = F.lit(self.bias)
        for t in self.trees:
            total = total + node(t)
        return 1 / (1 + F.exp(-(self.slope * total + self.shift)))
