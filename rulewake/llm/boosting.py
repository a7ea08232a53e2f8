"""Gradient boosted trees for small tables of binned features, with logistic loss."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 16


@dataclass
class Trees:
    """Trees of one depth as arrays: split feature and highest bin that goes left by node, and a value by leaf."""

    depth: int
    start: float
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of bins."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.features, self.cuts, self.values):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.score(x))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: float = 1.0) -> Trees:
    """Trees that predict y (0 or 1) from rows of bins 0..BINS-1. Ties between splits go to the first feature and bin."""
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    model = Trees(depth, float(np.log(share / (1 - share))))
    score = np.full(len(y), model.start)
    # one column per split that parts the rows: 1 where the row goes left; all histograms of a level are then one product
    splits = [(j, c) for j in range(x.shape[1]) for c in np.unique(x[:, j])[:-1]]
    left = np.stack([x[:, j] <= c for j, c in splits], 1).astype(float) if splits else np.zeros((len(y), 0))
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, BINS, dtype=np.int64)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            member = np.eye(wide)[node - first]
            sums = np.hstack([member * gradient[:, None], member * weight[:, None]])
            at_left, total = left.T @ sums, sums.sum(0)
            g, h, total_g, total_h = at_left[:, :wide], at_left[:, wide:], total[:wide], total[wide:]
            gain = g**2 / (h + least) + (total_g - g) ** 2 / (total_h - h + least) - total_g**2 / (total_h + least)
            for k in range(wide if splits else 0):
                best = int(gain[:, k].argmax())
                if gain[best, k] > 1e-9:
                    feature[first + k], cut[first + k] = splits[best]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = np.bincount(leaf, gradient, 2**depth) / (np.bincount(leaf, weight, 2**depth) + least) * rate
        model.features.append(feature)
        model.cuts.append(cut)
        model.values.append(value)
        score = score + value[leaf]
    return model
