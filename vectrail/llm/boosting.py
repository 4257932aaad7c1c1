"""Gradient-boosted trees for two classes: logistic loss, histogram splits, complete trees.

Defined results: of equal splits the first feature's lowest cut is taken; a node that no split improves
sends all its rows left; rows of one class only give its log-odds, bounded; no rows to judge give none.
Training holds all its rows in memory: they are few, and made.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # (trees, 2^depth - 1)
    cut: np.ndarray
    value: np.ndarray  # (trees, 2^depth)
    depth: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - len(f)]
        return out


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 50, depth: int = 5, rate: float = 0.25, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Newton boosting; each level takes the best split of every node over all features' bins."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]
    # Features of two values need no histogram: one product adds up all of them.
    two = [j for j in range(m) if len(edges[j]) == 1]
    more = [j for j in range(m) if len(edges[j]) > 1]
    low = np.stack([binned[j] == 0 for j in two], axis=1).astype(float) if two else np.empty((n, 0))
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    z = np.full(n, base)
    inner, leaves = (1 << depth) - 1, 1 << depth
    out = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), depth)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            node = (at - first) * bins
            ga, ha = (np.bincount(at - first, w, width)[:, None] for w in (g, h))
            gains = np.full((m, width), -np.inf)
            cuts = np.zeros((m, width), np.int64)

            def gain(gs: np.ndarray, hs: np.ndarray) -> np.ndarray:
                return gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)  # noqa: B023

            if two:
                own = np.zeros((2, width, n))
                own[0, at - first, np.arange(n)], own[1, at - first, np.arange(n)] = g, h
                gains[two] = gain(own[0] @ low, own[1] @ low).T
            for j in more:
                key = node + binned[j]
                gs, hs = (np.bincount(key, w, width * bins).reshape(width, bins).cumsum(1)[:, : len(edges[j])] for w in (g, h))
                found = gain(gs, hs)
                cuts[j] = found.argmax(1)
                gains[j] = found[np.arange(width), cuts[j]]
            best = gains.round(9).argmax(0)
            for w in np.flatnonzero(gains[best, np.arange(width)] > 1e-6):
                j = best[w]
                out.feature[t, first + w], out.cut[t, first + w] = j, edges[j][cuts[j, w]]
            at = 2 * at + 1 + (x[np.arange(n), out.feature[t, at]] > out.cut[t, at])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        out.value[t] = -rate * gs / (hs + ridge)
        z += out.value[t, leaf]
    return out
