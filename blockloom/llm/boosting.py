"""Histogram gradient-boosted trees in numpy, flattened into arrays.

Trees are complete binary trees of one depth: node ``i`` has the children
``2 i + 1`` and ``2 i + 2``, so traversal is arithmetic on whole arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    bias: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; larger values go right
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1e-3) -> Forest:
    """Logistic loss; second-order gains over histograms of at most ``bins`` quantile bins per feature."""
    inner = 2**depth - 1
    p = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(p / (1 - p)))
    empty = Forest(bias, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(y) == 0 or y.min() == y.max():
        return empty
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin, made = np.full(n, bias), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-9)
        at = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            here = at - first
            best = np.full(width, least)
            for j in range(k):
                if len(edges[j]) == 0:
                    continue
                size = len(edges[j]) + 1
                cell = here * size + binned[:, j]
                hg = np.bincount(cell, weights=g, minlength=width * size).reshape(width, size)
                hh = np.bincount(cell, weights=h, minlength=width * size).reshape(width, size)
                gl, hl = hg.cumsum(axis=1)[:, :-1], hh.cumsum(axis=1)[:, :-1]
                gt, ht = hg.sum(axis=1, keepdims=True), hh.sum(axis=1, keepdims=True)
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                c = gain.argmax(axis=1)
                top = gain[np.arange(width), c]
                better = top > best
                best[better] = top[better]
                nodes = first + np.flatnonzero(better)
                feature[nodes], threshold[nodes] = j, edges[j][c[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        end = at - inner
        leaf = -rate * np.bincount(end, weights=g, minlength=inner + 1) / (np.bincount(end, weights=h, minlength=inner + 1) + l2)
        margin += leaf[end]
        made.append((feature, threshold, leaf))
    return Forest(bias, *(np.stack(c) for c in zip(*made)))
