"""Histogram gradient-boosted trees for a binary label, in numpy.

Features are cut at quantiles into at most ``BINS`` bins; every level of a tree is grown from histograms of
gradients and Hessians. Trees are complete and kept as flat arrays, so scoring walks all rows through all
trees at once, one array step per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Forest:
    """Node ``i`` of a tree has the children ``2i+1`` and ``2i+2``; ``leaf`` holds the last level's values."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; right when above
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        n, (trees, inner) = len(x), self.feature.shape
        if not trees or not n:
            return np.full(n, 1 / (1 + np.exp(-self.start)))
        node, t, rows = np.zeros((n, trees), np.int64), np.arange(trees), np.arange(n)[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
        return 1 / (1 + np.exp(-(self.start + self.leaf[t, node - inner].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, l2: float = 2.0, least: float = 3.0) -> Forest:
    """Newton boosting of the logistic loss. Without rows of both labels the forest has no trees."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    positive = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(positive / (1 - positive)))
    if not len(y) or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    n, d = x.shape
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    cell = np.arange(d) * BINS + binned
    margin = np.full(n, start)
    out = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), start)
    for tree in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (d * BINS) + cell).ravel()
            hg, hh = (np.bincount(at, np.repeat(v, d), width * d * BINS).reshape(width, d, BINS).cumsum(axis=2) for v in (g, h))
            sg, sh = hg[:, :1, -1:], hh[:, :1, -1:]
            gain = hg**2 / (hh + l2) + (sg - hg) ** 2 / (sh - hh + l2) - sg**2 / (sh + l2)
            gain[(hh < least) | (sh - hh < least)] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            for k, b in enumerate(best):
                f, cut = divmod(int(b), BINS)
                if gain[k, f, cut] > 1e-6 and cut < len(edges[f]):
                    out.feature[tree, first + k], out.threshold[tree, first + k] = f, edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[tree, node]] > out.threshold[tree, node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        out.leaf[tree] = value
        margin += value[leaf]
    return out
