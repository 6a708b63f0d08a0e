"""Gradient-boosted trees for a yes/no decision, small enough to travel inside a closure."""

from __future__ import annotations

import numpy as np


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: how many edges of its column lie below it."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)


class BoostedTrees:
    """Logistic loss, depth-limited trees on quantile bins. Cases that share all bins are one row with their number, so any number of cases can be fitted on."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def shares(self) -> np.ndarray:
        """The shares of all values that lie below the edges of the bins."""
        return np.linspace(0, 1, self.bins + 1)[1:-1]

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, j], self.shares())) for j in range(x.shape[1])]
        return self.fit_counted(edges, binned(x, edges), np.ones(len(x)), y)

    def fit_counted(self, edges: list[np.ndarray], bins: np.ndarray, n: np.ndarray, positive: np.ndarray) -> BoostedTrees:
        """Fit on rows of bins that stand for `n` cases each, `positive` of them with a yes."""
        d = bins.shape[1]
        rate = float(np.clip(positive.sum() / n.sum(), 1e-4, 1 - 1e-4))
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(bins), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = positive - n * p, n * p * (1 - p)
            nodes = (1 << self.depth) - 1
            feature, cut, leaf = np.zeros(nodes, dtype=int), np.full(nodes, np.inf), np.zeros(1 << self.depth)
            at = np.zeros(len(bins), dtype=int)
            for level in range(self.depth):
                for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                    rows = np.flatnonzero(at == k)
                    best, last = 1e-6, np.inf
                    if len(rows):
                        gs, hs = g[rows].sum(), h[rows].sum()
                        for j in range(d):
                            m = len(edges[j]) + 1
                            gl = np.cumsum(np.bincount(bins[rows, j], g[rows], m))[:-1]
                            hl = np.cumsum(np.bincount(bins[rows, j], h[rows], m))[:-1]
                            gain = gl**2 / (hl + self.least) + (gs - gl) ** 2 / (hs - hl + self.least) - gs**2 / (hs + self.least)
                            if len(gain) and gain.max() > best:
                                last = int(gain.argmax())
                                best, feature[k], cut[k] = gain[last], j, edges[j][last]
                        at[rows] = 2 * k + 1 + (bins[rows, feature[k]] > last)
            at -= nodes
            for k in range(1 << self.depth):
                rows = at == k
                leaf[k] = self.rate * g[rows].sum() / (h[rows].sum() + self.least)
            score += leaf[at]
            self.trees.append((feature, cut, leaf))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            score += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-score))
