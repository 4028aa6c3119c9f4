"""Boosted trees fit as a grid of tasks: Spark deals each fit all of its rows, and all fits run at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64
CHUNK = 1 << 16  # rows that are counted into the bins at a time


@dataclass(frozen=True)
class Settings:
    """Trees, learning rate, depth, share of rows and of features a tree sees, seed, and the quantile of a quantile fit."""

    trees: int
    rate: float
    depth: int
    rows: float = 1.0
    features: float = 1.0
    seed: int = 0
    quantile: float | None = None


@dataclass
class Trees:
    """Complete binary trees in level order; a row goes right where its value is above the threshold."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    gain: np.ndarray  # by feature

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.start), np.arange(len(x)), self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, s: Settings) -> Trees:
    """Least squares, or the pinball loss of ``s.quantile``; splits fall on at most BINS quantiles of a feature.

    A row takes one byte for each feature beside ``x``, and a few numbers; the bins are counted in chunks of rows.
    """
    n, width = x.shape
    rng = np.random.default_rng(s.seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1], method="lower")) for f in range(width)]
    codes = np.empty((n, width), np.uint8)  # code k: above k cuts
    for f, c in enumerate(cuts):
        codes[:, f] = np.searchsorted(c, x[:, f])
    limits = np.array([[*c, *[np.inf] * (BINS - len(c))] for c in cuts])
    inner = 2**s.depth - 1
    start = float(np.quantile(y, s.quantile)) if s.quantile is not None else float(y.mean())
    now, gain_of, every = np.full(n, start), np.zeros(width), np.arange(n)
    features, thresholds, values = [], [], []
    for _ in range(s.trees):
        residual = y - now
        pull = residual if s.quantile is None else np.where(residual > 0, s.quantile, s.quantile - 1.0)
        used = rng.permutation(n)[: max(1, int(s.rows * n))] if s.rows < 1 else every
        seen = rng.permutation(width)[: max(1, int(s.features * width))] if s.features < 1 else np.arange(width)
        node, feature, threshold, bound = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS)
        for level in range(s.depth):
            first, count = 2**level - 1, 2**level
            shape, cells = (count, len(seen), BINS), count * len(seen) * BINS
            k, g = np.zeros(cells, np.int64), np.zeros(cells)
            for at in range(0, len(used), CHUNK):
                rows = used[at : at + CHUNK]
                cell = ((node[rows, None] - first) * (len(seen) * BINS) + np.arange(len(seen)) * BINS + codes[rows][:, seen]).ravel()
                k += np.bincount(cell, minlength=cells)
                g += np.bincount(cell, np.repeat(pull[rows], len(seen)), cells)
            k, g = k.reshape(shape).cumsum(2), g.reshape(shape).cumsum(2)
            kr, gr = k[:, :, -1:] - k, g[:, :, -1:] - g
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((k > 0) & (kr > 0), g**2 / k + gr**2 / kr - g[:, :, -1:] ** 2 / (k + kr), 0.0)
            best = gain.reshape(count, -1).argmax(1)
            most = gain.reshape(count, -1)[np.arange(count), best]
            f, cut = seen[best // BINS], best % BINS
            split = most > 1e-12
            feature[first : first + count] = np.where(split, f, 0)
            threshold[first : first + count] = np.where(split, limits[f, cut], np.inf)
            bound[first : first + count] = np.where(split, cut, BINS)
            np.add.at(gain_of, f[split], most[split])
            node = 2 * node + 1 + (codes[every, feature[node]] > bound[node])
        leaf = node - inner
        if s.quantile is None:
            k = np.bincount(leaf[used], minlength=inner + 1)
            value = np.bincount(leaf[used], residual[used], inner + 1) / np.maximum(k, 1)
        else:
            value = np.array([np.quantile(residual[used][leaf[used] == j], s.quantile) if (leaf[used] == j).any() else 0.0 for j in range(inner + 1)])
        value = value * s.rate
        now += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(start, np.array(features).reshape(-1, inner), np.array(thresholds).reshape(-1, inner), np.array(values).reshape(-1, inner + 1), gain_of)
