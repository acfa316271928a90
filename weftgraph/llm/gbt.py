"""Histogram gradient-boosted trees in numpy, for binary labels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees of a model in flat arrays.

    Node ``i`` sends a row left where ``x[feature[i]] <= cut[i]``; its children are ``left[i]``
    and ``left[i] + 1``.  A leaf has itself as ``left``, an infinite cut, and a ``value``.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            node = self.left[node] + (x[rows, self.feature[node]] > self.cut[node])
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, bins: int = 64, rate: float = 0.15, least: int = 5, ridge: float = 1.0) -> Trees:
    """Logistic boosting on quantile bins.  With one class or no rows the model is a constant."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    feature, cut, left, value, roots = [], [], [], [], []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)
        flat = binned + np.arange(width) * bins
        margin = np.full(n, base)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            roots.append(len(feature))
            feature.append(0), cut.append(np.inf), left.append(len(left)), value.append(0.0)
            level = [(roots[-1], np.arange(n))]
            for d in range(depth + 1):
                after = []
                for node, rows in level:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    value[node] = -rate * gs / (hs + ridge)
                    if d == depth or len(rows) < 2 * least:
                        continue
                    at = flat[rows].ravel()
                    many = lambda w: np.bincount(at, np.repeat(w, width) if w is not None else None, width * bins).reshape(width, bins).cumsum(axis=1)  # noqa: B023, E731
                    gl, hl, nl = many(g[rows]), many(h[rows]), many(None)
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    j, b = divmod(int(gain.argmax()), bins)
                    if gain[j, b] <= 1e-6 or b >= len(edges[j]):
                        continue
                    down = binned[rows, j] <= b
                    feature[node], cut[node], left[node] = j, float(edges[j][b]), len(feature)
                    for part in (rows[down], rows[~down]):
                        after.append((len(feature), part))
                        left.append(len(left)), feature.append(0), cut.append(np.inf), value.append(0.0)
                level = after
            tree = Trees(np.array(feature), np.array(cut), np.array(left), np.array(value), np.array(roots[-1:]), depth, 0.0)
            margin = margin + tree.margin(x)
    return Trees(np.array(feature or [0]), np.array(cut or [np.inf]), np.array(left or [0]), np.array(value or [0.0]), np.array(roots or [0]), depth, base)
