"""Small gradient-boosted trees for yes/no decisions, fitted and applied with NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays: split feature (-1: leaf), threshold, children and value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.value[at]
            rows = np.flatnonzero(inner)
            node = at[rows]
            goes_left = x[rows, self.feature[node]] <= self.threshold[node]
            at[rows] = np.where(goes_left, self.left[node], self.right[node])


@dataclass(frozen=True)
class Model:
    start: float
    rate: float
    trees: tuple[Tree, ...]
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.trees:
            total += self.rate * tree(x)
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated on held-out rows."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: float, ridge: float) -> Tree:
    feature, threshold, left, right, value = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        me = len(feature)
        g, h = gradient[rows].sum(), hessian[rows].sum()
        for store, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, g / (h + ridge))):
            store.append(v)
        best = (1e-6, -1, 0.0)
        if depth:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v = x[order, f]
                cg, ch = np.cumsum(gradient[order])[:-1], np.cumsum(hessian[order])[:-1]
                gain = cg**2 / (ch + ridge) + (g - cg) ** 2 / (h - ch + ridge) - g**2 / (h + ridge)
                gain[(v[1:] == v[:-1]) | (ch < least) | (h - ch < least)] = 0
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
        if best[1] >= 0:
            feature[me], threshold[me] = best[1], best[2]
            goes_left = x[rows, best[1]] <= best[2]
            left[me] = node(rows[goes_left], depth - 1)
            right[me] = node(rows[~goes_left], depth - 1)
        return me

    node(np.arange(len(x)), depth)
    return Tree(*map(np.array, (feature, threshold, left, right, value)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, least: float = 1.0, ridge: float = 1.0) -> Model:
    """Logistic loss, second-order splits."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, y - p, p * (1 - p), depth, least, ridge)
        grown.append(tree)
        margin += rate * tree(x)
    return Model(start, rate, tuple(grown))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Platt scaling of the margin on rows that the trees haven't seen."""
    return Model(model.start, model.rate, model.trees, *_platt(model.margin(x), y))


def fit_calibrated(x: np.ndarray, y: np.ndarray, few: int = 1000, **settings) -> Model:
    """Trees and their scaling from one set of rows.

    A quarter is held out for the scaling; where rows are few, each quarter in turn gets
    its margins from trees fitted on the others, and the final trees see all rows.
    """
    part = np.random.default_rng(0).permutation(len(y)) % 4
    if len(y) >= few:
        return calibrate(fit(x[part > 0], y[part > 0], **settings), x[part == 0], y[part == 0])
    margin = np.zeros(len(y))
    for k in range(4):
        margin[part == k] = fit(x[part != k], y[part != k], **settings).margin(x[part == k])
    model = fit(x, y, **settings)
    return Model(model.start, model.rate, model.trees, *_platt(margin, y))


def _platt(m: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    # the usual targets, which keep the scale finite for separable rows
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    a = np.stack([m, np.ones_like(m)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (target - p))
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), float(w[1])


def threshold_for(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least threshold at which the held-out precision is reached; above 1 if none is."""
    order = np.argsort(-probability, kind="stable")
    p, hits = probability[order], np.cumsum(y[order])
    reached = (hits / np.arange(1, len(p) + 1) >= precision) & np.append(p[1:] != p[:-1], True)
    return float(p[np.flatnonzero(reached)[-1]]) if reached.any() else 1.1
