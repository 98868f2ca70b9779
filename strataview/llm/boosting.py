"""Gradient-boosted trees on dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BoostedTrees:
    """Logistic loss, second-order gains over quantile bins, trees of fixed
    depth stored level by level (feature, threshold, leaf values)."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    ridge: float = 1.0
    bins: int = 32
    start: float = 0.0
    model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T, strict=True)], axis=1)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            prob = _sigmoid(score)
            g, h = prob - y, prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            feat = np.zeros(2**self.depth - 1, np.int64)
            cut = np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.zeros(width)
                pick = np.full(width, -1)
                for f in range(x.shape[1]):
                    k = len(cuts[f])
                    if not k:
                        continue
                    at = node * (k + 1) + codes[:, f]
                    gs = np.bincount(at, g, width * (k + 1)).reshape(width, k + 1).cumsum(1)
                    hs = np.bincount(at, h, width * (k + 1)).reshape(width, k + 1).cumsum(1)
                    gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + self.ridge) + (ga - gl) ** 2 / (ha - hl + self.ridge) - ga**2 / (ha + self.ridge)
                    gain[(hl < 1) | (ha - hl < 1)] = 0
                    j = gain.argmax(1)
                    top = gain[np.arange(width), j]
                    better = top > best + 1e-9
                    best[better] = top[better]
                    feat[first : first + width][better] = f
                    cut[first : first + width][better] = cuts[f][j[better]]
                    pick[better] = j[better]
                right = x[np.arange(len(y)), feat[first + node]] > cut[first + node]
                node = node * 2 + right
            leaf = -np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.ridge) * self.rate
            score += leaf[node]
            self.model.append((feat, cut, leaf))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feat, cut, leaf in self.model:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, feat[at]] > cut[at])
            out += leaf[node]
        return out


@dataclass
class Isotonic:
    """Pool adjacent violators; between the pools' centres the map is linear."""

    x: np.ndarray = field(default_factory=lambda: np.zeros(1))
    y: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        pools: list[list[float]] = [[0.0, 0.5, 1.0]]  # sum of scores, sum of labels, weight: a prior at each end
        pools[0] = [float(score.min()) - 1, 0.0, 1.0]
        for s, t in [*zip(score[order], y[order], strict=True), (float(score.max()) + 1, 1.0)]:
            pools.append([float(s), float(t), 1.0])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                a = pools.pop()
                pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2] + a[2]]
        self.x = np.array([p[0] / p[2] for p in pools])
        self.y = np.array([p[1] / p[2] for p in pools])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
