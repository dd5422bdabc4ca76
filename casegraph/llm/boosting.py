"""Gradient-boosted trees for a few classes: softmax loss, Newton steps, histogram splits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth: node k has children 2k+1 and 2k+2; value at or below its threshold goes left."""

    feature: np.ndarray  # [tree, inner node]
    threshold: np.ndarray  # [tree, inner node]
    leaf: np.ndarray  # [tree, leaf]
    classes: int
    depth: int
    start: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities [row, class]."""
        out = np.tile(self.start, (len(x), 1))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t][at]] > self.threshold[t][at])
            out[:, t % self.classes] += self.leaf[t][at - (len(self.leaf[t]) - 1)]
        out -= out.max(axis=1, keepdims=True)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 30, depth: int = 4, rate: float = 0.25, ridge: float = 1.0, least: int = 5) -> Forest:
    """Newton boosting, one tree for each class and round."""
    n, features = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    width = BINS
    start = np.log(np.bincount(y, minlength=classes) / n + 1e-6)
    margin = np.tile(start, (n, 1))
    target = np.eye(classes)[y]
    inner, leaves = 2**depth - 1, 2**depth
    all_f, all_t, all_v = [], [], []
    offsets = np.arange(features) * width
    flat = binned + offsets
    for _ in range(rounds):
        p = np.exp(margin - margin.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for c in range(classes):
            g, h = p[:, c] - target[:, c], np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                first = 2**level - 1
                for node in range(first, 2 * first + 1):
                    rows = np.flatnonzero(at == node)
                    if len(rows) < 2 * least:
                        continue
                    cells = flat[rows].ravel()
                    size = features * width
                    sums = [np.bincount(cells, np.repeat(v[rows], features), size).reshape(features, width).cumsum(axis=1) for v in (g, h)]
                    number = np.bincount(cells, minlength=size).reshape(features, width).cumsum(axis=1)
                    gl, hl, nl = sums[0][:, :-1], sums[1][:, :-1], number[:, :-1]
                    gt, ht = g[rows].sum(), h[rows].sum()
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] > 1e-3 and b < len(edges[f]):
                        feature[node], threshold[node] = f, edges[f][b]
                at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
            leaf_at = at - inner
            gs, hs = np.bincount(leaf_at, g, leaves), np.bincount(leaf_at, h, leaves)
            value = -rate * gs / (hs + ridge)
            margin[:, c] += value[leaf_at]
            all_f.append(feature)
            all_t.append(threshold)
            all_v.append(value)
    return Forest(np.array(all_f), np.array(all_t), np.array(all_v), classes, depth, start)
