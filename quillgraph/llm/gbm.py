"""Gradient-boosted trees of depth two for two classes, in numpy: small enough to be sent along with a function."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Boosted trees under logistic loss; splits are searched over ``bins`` quantiles of each feature."""

    def __init__(self, rounds: int = 40, rate: float = 0.3, bins: int = 24) -> None:
        self.rounds, self.rate, self.bins = rounds, rate, bins
        self.base = 0.0
        self.trees: list[tuple] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        f = np.full(len(y), self.base)
        everything = np.ones(len(y), bool)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            top = self._split(x, g, h, cuts, everything)
            if top is None:
                break
            j, c = top
            parts = []
            for side in (x[:, j] <= c, x[:, j] > c):
                sub = self._split(x, g, h, cuts, side)
                if sub is None:
                    w = self._weight(g, h, side)
                    parts.append((0, np.inf, w, w))
                else:
                    k, d = sub
                    low = side & (x[:, k] <= d)
                    parts.append((k, d, self._weight(g, h, low), self._weight(g, h, side & ~low)))
            self.trees.append((j, c, *parts))
            f = self.margin(x)
        return self

    def _weight(self, g: np.ndarray, h: np.ndarray, side: np.ndarray) -> float:
        return float(self.rate * g[side].sum() / (h[side].sum() + 1.0))

    @staticmethod
    def _split(x, g, h, cuts, side):
        best, at = 1e-6, None
        gs, hs = g[side], h[side]
        G, H = gs.sum(), hs.sum()
        for j, cs in enumerate(cuts):
            v = x[side, j]
            for c in cs:
                low = v <= c
                a, b = gs[low].sum(), hs[low].sum()
                if not 0 < low.sum() < len(v):
                    continue
                gain = a * a / (b + 1) + (G - a) ** 2 / (H - b + 1) - G * G / (H + 1)
                if gain > best:
                    best, at = gain, (j, float(c))
        return at

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        f = np.full(len(x), self.base)
        for j, c, left, right in self.trees:
            first = x[:, j] <= c
            for side, (k, d, low, high) in ((first, left), (~first, right)):
                f[side] += np.where(x[side, k] <= d, low, high)
        return f

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))
