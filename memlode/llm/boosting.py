"""Small gradient-boosted trees on numpy: logistic loss, histogram splits, calibrated on rows held out."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Complete trees of one depth: node i splits on ``feature[i] > cut[i]`` to 2i + 2, else 2i + 1."""

    depth: int
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(x) + self.shift, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, held_out: float = 0.25, seed: int = 5) -> BoostedTrees:
    """Fits on part of the rows; the rest calibrates the probability (logistic) and picks the threshold of best F1."""
    rng = np.random.default_rng(seed)
    out_rows = rng.random(len(x)) < held_out
    xt, yt = x[~out_rows], y[~out_rows].astype(float)
    made = BoostedTrees(depth)
    share = np.clip(yt.mean() if len(yt) else 0.5, 0.01, 0.99)
    made.base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(xt[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    edges = [np.unique(np.concatenate([e, (np.unique(xt[:, j])[:-1] + np.unique(xt[:, j])[1:]) / 2])) if len(np.unique(xt[:, j])) <= bins else e for j, e in enumerate(edges)]
    codes = np.stack([np.searchsorted(e, xt[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = max(len(e) for e in edges) + 1
    margin = np.full(len(xt), made.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - yt, p * (1 - p)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(xt), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                at = (node - first) * width + codes[:, j]
                gs = np.bincount(at, g, minlength=many * width).reshape(many, width).cumsum(1)
                hs = np.bincount(at, h, minlength=many * width).reshape(many, width).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                gain = gain[:, : len(e)]
                k = gain.argmax(1)
                better = gain[np.arange(many), k] > best
                best[better] = gain[np.arange(many), k][better]
                feature[first : first + many][better], cut[first : first + many][better] = j, e[k[better]]
            node = 2 * node + 1 + (xt[np.arange(len(xt)), feature[node]] > cut[node])
        leaf_of = node - (2**depth - 1)
        leaf = -rate * np.bincount(leaf_of, g, minlength=2**depth) / (np.bincount(leaf_of, h, minlength=2**depth) + ridge)
        margin += leaf[leaf_of]
        made.features.append(feature)
        made.cuts.append(cut)
        made.leaves.append(leaf)
    xv, yv = x[out_rows], y[out_rows].astype(float)
    if len(yv) and 0 < yv.sum() < len(yv):
        m = made.margin(xv)
        a, b = 1.0, 0.0
        for _ in range(25):  # Newton steps of the calibration, with a weak pull to the identity
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            hess = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1]])
            step = np.linalg.solve(hess, [((p - yv) * m).sum() + (a - 1), (p - yv).sum() + b])
            a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -0.5, 0.5)
        made.scale, made.shift = float(a), float(b)
        p = made.probability(xv)
        grid = np.linspace(0.2, 0.8, 25)
        f1 = [2 * (yv * (p > t)).sum() / max((yv.sum() + (p > t).sum()), 1) for t in grid]
        good = grid[np.array(f1) >= max(f1) - 2e-3]
        made.threshold = float(good[np.abs(good - 0.5).argmin()])
    return made
