"""Gradient-boosted trees with logistic loss, and isotonic calibration, for a bounded sample on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Regression trees on binned features; each tree is three arrays over a complete binary tree: feature, threshold, value."""

    rounds: int = 60
    depth: int = 4
    rate: float = 0.2
    least_bend: float = 0.5
    shrink: float = 1.0
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        weight = np.ones(len(y)) if weight is None else weight
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T] if len(x) else []
        binned = np.stack([np.searchsorted(k, c, side="right") for k, c in zip(cuts, x.T)], axis=1) if len(x) else np.zeros((0, 0), int)
        mean = np.clip(np.average(y, weights=weight) if weight.sum() else 0.5, 1e-4, 1 - 1e-4)
        self.start, self.trees = float(np.log(mean / (1 - mean))), []
        score = np.full(len(y), self.start)
        for _ in range(self.rounds if len(y) and y.min() < y.max() else 0):
            p = 1 / (1 + np.exp(-score))
            tree, step = self._grow(binned, cuts, weight * (y - p), weight * np.maximum(p * (1 - p), 1e-9))
            self.trees.append(tree)
            score += step
        return self

    def _grow(self, binned: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, bend: np.ndarray):
        nodes = 2 ** (self.depth + 1) - 1
        feature, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        where = np.zeros(len(binned), np.int64)
        width = binned.shape[1]
        cell = binned + np.arange(width) * BINS
        for level in range(self.depth + 1):
            first, many = 2**level - 1, 2**level
            local = np.where(where >= first, where - first, many)  # rows that stopped earlier go to a spare node
            g, h = np.bincount(local, slope, many + 1)[:many], np.bincount(local, bend, many + 1)[:many]
            value[first : first + many] = self.rate * g / (h + self.shrink)
            if level == self.depth:
                break
            key = (local[:, None] * (width * BINS) + cell).ravel()
            shape = (many + 1, width, BINS)
            left_g = np.cumsum(np.bincount(key, np.repeat(slope, width), np.prod(shape)).reshape(shape), axis=2)[:many, :, :-1]
            left_h = np.cumsum(np.bincount(key, np.repeat(bend, width), np.prod(shape)).reshape(shape), axis=2)[:many, :, :-1]
            g, h = g[:, None, None], h[:, None, None]
            gain = left_g**2 / (left_h + self.shrink) + (g - left_g) ** 2 / (h - left_h + self.shrink) - g**2 / (h + self.shrink)
            gain[(left_h < self.least_bend) | (h - left_h < self.least_bend)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            f, at = np.divmod(best, BINS - 1)
            split = gain.reshape(many, -1)[np.arange(many), best] > 1e-6
            chosen = np.concatenate([split, [False]])[local]
            f, at = np.append(f, 0), np.append(at, 0)
            right = binned[np.arange(len(binned)), f[local]] > at[local]
            for node in np.nonzero(split)[0]:
                feature[first + node], threshold[first + node] = f[node], cuts[f[node]][at[node]]
            where = np.where(chosen, 2 * where + 1 + right, where)
        return (feature, threshold, value), value[where]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for feature, threshold, value in self.trees:
            where = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[where]
                inner = f >= 0
                right = x[np.arange(len(x)), np.maximum(f, 0)] >= threshold[where]
                where = np.where(inner, 2 * where + 1 + right, where)
            total += value[where]
        return total


@dataclass
class Isotonic:
    """Non-decreasing calibration by pooling adjacent violators; linear between the pools' means."""

    at: np.ndarray = field(default_factory=lambda: np.zeros(1))
    to: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))

    def fit(self, score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        pools: list[list[float]] = []  # weighted score, weighted y, weight
        for s, t, w in zip(score[order], y[order], weight[order]):
            pools.append([s * w, t * w, w])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        if pools:
            self.at, self.to = np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.to)


def cross_scores(x: np.ndarray, y: np.ndarray, weight: np.ndarray, folds: int = 3) -> np.ndarray:
    """Scores of rows by models that did not see them, for the calibration."""
    fold = np.arange(len(y)) % folds
    out = np.zeros(len(y))
    for k in range(folds):
        out[fold == k] = Boosted().fit(x[fold != k], y[fold != k], weight[fold != k]).score(x[fold == k])
    return out
