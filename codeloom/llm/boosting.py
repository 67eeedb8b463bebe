"""Gradient-boosted trees for binary labels on dense features, with isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of depth-limited trees over quantile bins, second-order gains with L2 penalty."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, penalty: float = 1.0, least: int = 5):
        self.n_trees, self.depth, self.rate, self.bins, self.penalty, self.least = trees, depth, rate, bins, penalty, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(p / (1 - p)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1)
        margin = np.full(len(y), self.base)
        for _ in range(self.n_trees if len(y) and 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += tree["leaf"][self._leaf(tree, x)]
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> dict:
        n_nodes = (1 << self.depth) - 1
        feature, cut = np.full(n_nodes, -1), np.zeros(n_nodes)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            first, width = (1 << level) - 1, 1 << level
            local = node - first
            best = np.full(width, 1e-9)
            for f, edges in enumerate(self.edges):
                k = len(edges) + 1
                if k < 2:
                    continue
                at = local * k + binned[:, f]
                gs, hs, ns = (np.bincount(at, w, width * k).reshape(width, k).cumsum(1) for w in (g, h, np.ones(len(g))))
                total_g, total_h, total_n = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                score = lambda a, b: a * a / (b + self.penalty)
                gain = score(gs, hs) + score(total_g - gs, total_h - hs) - score(total_g, total_h)
                gain[(ns < self.least) | (total_n - ns < self.least)] = 0
                gain = gain[:, :-1]
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best = np.where(better, gain[np.arange(width), top], best)
                feature[first : first + width][better] = f
                cut[first : first + width][better] = edges[top[better]]
            f = feature[node]
            value = np.zeros(len(g), bool)
            for j in np.unique(f[f >= 0]):
                own = f == j
                value[own] = binned[own, j] > np.searchsorted(self.edges[j], cut[node[own]])
            node = 2 * node + 1 + value
        leaf = node - n_nodes
        gs, hs = (np.bincount(leaf, w, n_nodes + 1) for w in (g, h))
        return {"feature": feature, "cut": cut, "leaf": -self.rate * gs / (hs + self.penalty)}

    def _leaf(self, tree: dict, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = tree["feature"][node]
            node = 2 * node + 1 + ((f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] >= tree["cut"][node]))
        return node - len(tree["feature"])

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree["leaf"][self._leaf(tree, x)]
        return out


class Isotonic:
    """Pool-adjacent-violators fit of label on margin; between block centres the fit is interpolated, so order is kept."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, sum of margins, rows
        for m, label in zip(margin[order].tolist(), y[order].tolist()):
            blocks.append([label, m, 1])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
                a, b, c = blocks.pop()
                blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + b, blocks[-1][2] + c]
        self.at = np.array([b[1] / b[2] for b in blocks] or [0.0])
        # Half a row of each label keeps the ends off 0 and 1.
        self.value = np.maximum.accumulate(np.array([(b[0] + 0.5) / (b[2] + 1) for b in blocks] or [0.5]))
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        inner = np.interp(margin, self.at, self.value)
        # Outside the fitted range the score still rises with the margin, towards 0 and 1.
        low, high = np.minimum(margin - self.at[0], 0), np.maximum(margin - self.at[-1], 0)
        return np.where(low < 0, self.value[0] * np.exp(low), np.where(high > 0, 1 - (1 - self.value[-1]) * np.exp(-high), inner))
