"""Histogram gradient-boosted trees in numpy, kept as flat arrays."""

from __future__ import annotations

import numpy as np


class Trees:
    """Binary classifier: complete trees of one depth.  Node i has children 2i+1 and
    2i+2; ``feature`` and ``cut`` are (trees, inner nodes), ``leaf`` (trees, leaves)."""

    def __init__(self, depth: int = 4, trees: int = 60, bins: int = 64, rate: float = 0.15, least: int = 20, shrink: float = 1.0):
        self.depth, self.trees, self.bins, self.rate, self.least, self.shrink = depth, trees, bins, rate, least, shrink
        self.feature = self.cut = self.leaf = None
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, f = x.shape
        inner = (1 << self.depth) - 1
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        raw = np.full(n, self.base)
        self.feature, self.cut, self.leaf = [], [], []
        width = self.bins
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
            for level in range(self.depth):
                first, many = (1 << level) - 1, 1 << level
                at = node - first
                best = np.full(many, 1e-6)
                choice = [(0, -1)] * many
                tot = [np.bincount(at, weights=v, minlength=many) for v in (g, h)]
                for j in range(f):
                    key = at * width + binned[:, j]
                    sums = [np.bincount(key, weights=v, minlength=many * width).reshape(many, width).cumsum(1) for v in (g, h)]
                    count = np.bincount(key, minlength=many * width).reshape(many, width).cumsum(1)
                    gl, hl = sums[0], sums[1]
                    gr, hr = tot[0][:, None] - gl, tot[1][:, None] - hl
                    gain = gl ** 2 / (hl + self.shrink) + gr ** 2 / (hr + self.shrink) - (tot[0] ** 2 / (tot[1] + self.shrink))[:, None]
                    gain[(count < self.least) | (count[:, -1:] - count < self.least)] = -np.inf
                    gain[:, len(edges[j]):] = -np.inf
                    b = gain.argmax(1)
                    for k in np.flatnonzero(gain[np.arange(many), b] > best):
                        best[k], choice[k] = gain[k, b[k]], (j, int(b[k]))
                right = np.zeros(n, bool)
                for k, (j, b) in enumerate(choice):
                    if b >= 0:
                        feature[first + k], cut[first + k] = j, edges[j][b]
                        right |= (at == k) & (binned[:, j] > b)
                node = 2 * node + 1 + right
            at = node - inner
            gs, hs = (np.bincount(at, weights=v, minlength=1 << self.depth) for v in (g, h))
            leaf = -self.rate * gs / (hs + self.shrink)
            raw += leaf[at]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        self.feature, self.cut, self.leaf = (np.stack(v) for v in (self.feature, self.cut, self.leaf))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Every row walks all trees at once, level by level."""
        if self.leaf is None:
            return np.full(len(x), 0.5)
        out = np.empty(len(x))
        tree = np.arange(len(self.leaf))[None, :]
        for k in range(0, len(x), 4096):
            some = x[k:k + 4096]
            row = np.arange(len(some))[:, None]
            node = np.zeros((len(some), len(self.leaf)), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (some[row, self.feature[tree, node]] > self.cut[tree, node])
            raw = self.base + self.leaf[tree, node - ((1 << self.depth) - 1)].sum(1)
            out[k:k + 4096] = 1 / (1 + np.exp(-raw))
        return out
