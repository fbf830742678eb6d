"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # go right if the value is above
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Each tree fits the loss's gradient; a level's nodes are split by their best gain."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin, out = np.full(n, base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p) + 1e-9
        feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            best = np.zeros(nodes)
            for j in range(width):
                code = (at - first) * bins + binned[:, j]
                g = np.cumsum(np.bincount(code, grad, nodes * bins).reshape(nodes, bins), 1)
                h = np.cumsum(np.bincount(code, hess, nodes * bins).reshape(nodes, bins), 1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
                gain = gain[:, : len(edges[j])]
                if gain.shape[1]:
                    top = gain.argmax(1)
                    value = gain[np.arange(nodes), top]
                    for k in np.flatnonzero(value > best + 1e-9):
                        best[k], feature[first + k], cut[first + k] = value[k], j, edges[j][top[k]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        at -= (1 << depth) - 1
        g, h = (np.bincount(at, v, 1 << depth) for v in (grad, hess))
        leaf = -rate * g / (h + ridge)
        margin += leaf[at]
        for store, value in zip(out, (feature, cut, leaf)):
            store.append(value)
    return Trees(base, *map(np.stack, out))
