"""Gradient-boosted regression trees on a bounded sample, flattened into NumPy node arrays.

Logistic loss, histogram splits, depth-limited trees.  A feature with constraint -1 (or +1) may only
lower (raise) the score: a split that orders its children the other way is rejected, and the bounds
of a node's value are handed down to its children, so the whole ensemble is monotone in it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Node arrays of all trees; a leaf points to itself, so that every row takes ``depth`` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 2.0, least: float = 5.0) -> Forest:
    """``y`` in {0, 1}.  With no rows or a single class the forest is a constant."""
    n = len(x)
    mean = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        i = len(feature)
        feature.append(0), threshold.append(0.0), left.append(i), right.append(i), value.append(v)
        return i

    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
        margin = np.full(n, base)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            weight = lambda a, b: -a / (b + l2)
            best = (1e-6, None)
            if level < depth and hs > 2 * least / 4:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    k = code[rows, j]
                    gl = np.cumsum(np.bincount(k, g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(k, h[rows], len(c) + 1))[:-1]
                    gr, hr = gs - gl, hs - hl
                    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs**2 / (hs + l2)
                    gain[(hl < least / 4) | (hr < least / 4)] = -1
                    if sign := monotone.get(j):
                        gain[sign * (weight(gr, hr) - weight(gl, hl)) < 0] = -1
                    b = int(np.argmax(gain))
                    if gain[b] > best[0]:
                        best = (gain[b], j, b, np.clip(weight(gl[b], hl[b]), low, high), np.clip(weight(gr[b], hr[b]), low, high))
            if best[1] is None:
                v = float(np.clip(weight(gs, hs), low, high)) * rate
                margin[rows] += v
                return leaf(v)
            _, j, b, wl, wr = best
            i = leaf(0.0)
            feature[i], threshold[i] = j, float(cuts[j][b])
            mid, sign = (wl + wr) / 2, monotone.get(j, 0)
            side = code[rows, j] <= b
            left[i] = grow(rows[side], g, h, level + 1, mid if sign < 0 else low, mid if sign > 0 else high)
            right[i] = grow(rows[~side], g, h, level + 1, mid if sign > 0 else low, mid if sign < 0 else high)
            return i

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -np.inf, np.inf))
    as_int = lambda v: np.array(v, dtype=np.int64)
    return Forest(as_int(feature), np.array(threshold), as_int(left), as_int(right), np.array(value), as_int(roots), base, depth)
