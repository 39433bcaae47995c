"""Gradient-boosted trees on binned features and isotonic calibration, in numpy, for bounded training samples."""

from __future__ import annotations

import numpy as np


class Trees:
    """Logistic boosting with level-wise trees of a fixed depth over at most 64 quantile bins per feature."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, ridge: float = 2.0, least: float = 4.0, bins: int = 64):
        self.trees, self.depth, self.rate, self.ridge, self.least, self.bins = trees, depth, rate, ridge, least, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        b = self._bin(x)
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.nodes = float(np.log(rate / (1 - rate))), []
        f = np.full(len(y), self.base)
        for _ in range(self.trees if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, p - y, p * (1 - p))
            self.nodes.append(tree)
            f += self._walk(tree, b)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.int64) if len(x) else np.zeros(x.shape, np.int64)

    def _grow(self, b, g, h):
        n, m = b.shape
        at = np.zeros(n, np.int64)
        feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins)
        for level in range(self.depth):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-6)
            for j in range(m):
                k = (at - first) * (self.bins + 1) + b[:, j]
                gs = np.bincount(k, g, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(k, h, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < self.least * 0.05) | (ht - hs < self.least * 0.05)] = 0
                c = gain.argmax(1)
                better = gain[np.arange(width), c] > best
                best = np.where(better, gain[np.arange(width), c], best)
                feature[first : first + width][better], cut[first : first + width][better] = j, c[better]
            at = 2 * at + 1 + (b[np.arange(n), feature[at]] > cut[at])
        leaf = at - (2**self.depth - 1)
        gs, hs = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
        return feature, cut, -self.rate * gs / (hs + self.ridge)

    def _walk(self, tree, b):
        feature, cut, value = tree
        at, row = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(self.depth):
            at = 2 * at + 1 + (b[row, feature[at]] > cut[at])
        return value[at - (2**self.depth - 1)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.base + sum((self._walk(t, b) for t in self.nodes), np.zeros(len(x)))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (margin, probability) of the pooled-adjacent-violators fit, smoothed by half a count at either end."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of margin, of y, count
    for m, t in zip(margin[order], y[order], strict=True):
        blocks.append([m, t, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    knots = np.array([[b[0] / b[2], (b[1] + 0.25) / (b[2] + 0.5)] for b in blocks]) if blocks else np.array([[0.0, 0.5]])
    return knots[:, 0], np.maximum.accumulate(knots[:, 1])


def calibrated(x, y, fold, folds: int = 3, **kind):
    """Trees on all rows, and isotonic knots from margins of rows that a fold's trees haven't seen."""
    out = np.zeros(len(y))
    for k in range(folds):
        own = fold % folds == k
        out[own] = Trees(**kind).fit(x[~own], y[~own]).margin(x[own])
    return Trees(**kind).fit(x, y), isotonic(out, y)
