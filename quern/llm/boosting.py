"""Gradient-boosted trees on logistic loss over binned features, and isotonic calibration.  Plain NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: for each tree, the inner nodes' features and thresholds, and the leaves."""

    base: float
    feature: np.ndarray  # trees x (2^depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2^depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), int)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (2**depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: float = 3.0) -> Trees:
    """Trees for labels y in {0, 1}.  Ties between splits go to the lower feature, then the lower cut."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(1) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], axis=1) if n else np.zeros((0, k), int)
    rate0 = (y.sum() + 0.5) / (n + 1.0) if n else 0.001  # nothing learned: nothing flagged
    base = float(np.log(rate0 / (1 - rate0)))
    margin = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    feats, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feat, cut = np.zeros(inner, int), np.full(inner, np.inf)
        at = np.zeros(n, int)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = at - first
            gain = np.full(count, 1e-6)
            size = bins + 1
            for j in range(k):
                if not len(edges[j]):
                    continue
                cell = local * size + binned[:, j]
                gs = np.bincount(cell, g, count * size).reshape(count, size).cumsum(axis=1)
                hs = np.bincount(cell, h, count * size).reshape(count, size).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                m = len(edges[j])
                gl, hl = gs[:, :m], hs[:, :m]
                gr, hr = gt - gl, ht - hl
                score = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gt**2 / (ht + ridge)
                score[(hl < least * 0.05) | (hr < least * 0.05)] = -1
                b = score.argmax(axis=1)
                s = score[np.arange(count), b]
                better = s > gain + 1e-12
                gain[better] = s[better]
                feat[first : first + count][better] = j
                cut[first : first + count][better] = edges[j][b[better]]
            at = 2 * at + 1 + (x[np.arange(n), feat[at]] > cut[at])
        local = at - inner
        leaf = rate * np.bincount(local, g, leaves) / (np.bincount(local, h, leaves) + ridge)
        margin += leaf[local]
        feats.append(feat), cuts.append(cut), values.append(leaf)
    return Trees(base, np.array(feats), np.array(cuts), np.array(values))


@dataclass
class Isotonic:
    """A rising step function with linear parts between the blocks' middles."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, v: np.ndarray) -> np.ndarray:
        return np.interp(v, self.x, self.y)


def isotonic(v: np.ndarray, y: np.ndarray, smooth: float = 0.5) -> Isotonic:
    """Pool adjacent violators; a block's value is shrunk towards the overall rate by `smooth` cases."""
    if not len(v):
        return Isotonic(np.array([-1.0, 1.0]), np.array([0.0, 1.0]))
    order = np.argsort(v, kind="stable")
    v, y = v[order], y[order].astype(float)
    blocks: list[list[float]] = []  # sum, count, sum of v
    for a, b in zip(v, y):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    rate = y.mean()
    xs = np.array([b[2] / b[1] for b in blocks])
    ys = np.array([(b[0] + smooth * rate) / (b[1] + smooth) for b in blocks])
    return Isotonic(xs, np.maximum.accumulate(ys))
