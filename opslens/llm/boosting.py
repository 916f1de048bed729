"""Gradient-boosted trees for small, bounded training samples (NumPy)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Binary trees of equal depth over binned features, summed to log-odds."""

    edges: list[np.ndarray]  # per feature, rising bin borders
    base: float
    features: np.ndarray  # [trees, nodes]
    cuts: np.ndarray  # [trees, nodes]: go right above this bin
    leaves: np.ndarray  # [trees, leaves]

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1]))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, most_bins: int = 32, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss."""
    edges = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > most_bins:
            values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, most_bins + 1)[1:-1], method="lower"))
        edges.append(values[:-1] if len(values) > 1 else values)
    bins = binned(x, edges)
    width = max(len(e) for e in edges) + 1
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    nodes, leaves = 2**depth - 1, 2**depth
    features, cuts, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(nodes, np.int64), np.full(nodes, width, np.int64)
        for level in range(depth):
            low, count = 2**level - 1, 2**level
            slot = (node - low) * width
            best = np.full(count, 1e-9)
            for j in range(x.shape[1]):
                g = np.bincount(slot + bins[:, j], gradient, count * width).reshape(count, width).cumsum(axis=1)
                h = np.bincount(slot + bins[:, j], curvature, count * width).reshape(count, width).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                at = gain[:, :-1].argmax(axis=1)
                found = gain[np.arange(count), at]
                better = found > best
                best[better] = found[better]
                feature[low : low + count][better] = j
                cut[low : low + count][better] = at[better]
            node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - nodes
        value = rate * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, curvature, leaves) + ridge)
        margin += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(edges, base, np.array(features), np.array(cuts), np.array(values))


def threshold(margin: np.ndarray, y: np.ndarray, precision: float, least: int = 20, count: np.ndarray | None = None) -> float:
    """The lowest margin at which held-back rows are right often enough; infinite with too few of them.

    With ``count`` each entry stands for so many rows, ``y`` of them right.
    The share of right ones is smoothed by one wrong, so a handful of rows proves little.
    """
    order = np.argsort(-margin, kind="stable")
    right = np.cumsum(y[order])
    taken = np.arange(1, len(y) + 1) if count is None else np.cumsum(count[order])
    last_of_tie = np.append(margin[order][1:] != margin[order][:-1], True) if len(y) else np.zeros(0, bool)
    good = (right / (taken + 1) >= precision) & (right >= least) & last_of_tie
    return float(margin[order][np.flatnonzero(good)[-1]]) if good.any() else float("inf")
