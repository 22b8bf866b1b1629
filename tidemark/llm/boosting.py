"""Gradient-boosted trees on small tables of numbers, and the same trees as SQL expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float = 1.0):
    """A tree: a leaf's value, or (feature, limit, tree for values <= limit, tree for the others)."""
    value = -float(grad.sum() / (hess.sum() + ridge))
    if depth == 0 or len(x) < 10:
        return value
    best, cut = 1e-6, None
    whole = grad.sum() ** 2 / (hess.sum() + ridge)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        g, h = np.cumsum(grad[order])[:-1], np.cumsum(hess[order])[:-1]
        gain = g**2 / (h + ridge) + (grad.sum() - g) ** 2 / (hess.sum() - h + ridge) - whole
        gain[v[:-1] == v[1:]] = -1
        if len(gain) and gain.max() > best:
            k = int(gain.argmax())
            best, cut = float(gain[k]), (f, float(v[k] + v[k + 1]) / 2)
    if cut is None:
        return value
    low = x[:, cut[0]] <= cut[1]
    return (*cut, grow(x[low], grad[low], hess[low], depth - 1, ridge), grow(x[~low], grad[~low], hess[~low], depth - 1, ridge))


def predict(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, limit, low, high = tree
    return np.where(x[:, f] <= limit, predict(low, x), predict(high, x))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.4) -> list:
    """Trees whose sum is the log odds of y = 1; leaves are rounded, so that engines agree."""
    margin, out = np.zeros(len(y)), []

    def scaled(tree):
        return round(tree * rate, 6) if not isinstance(tree, tuple) else (tree[0], tree[1], scaled(tree[2]), scaled(tree[3]))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out.append(scaled(grow(x, p - y, p * (1 - p), depth)))
        margin += predict(out[-1], x)
    return out


def margins(trees: list, x: np.ndarray) -> np.ndarray:
    return sum((predict(t, x) for t in trees), np.zeros(len(x)))


def calibrated(margin: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least margin at which so large a share of what lies at or above it is positive; infinite if there is none."""
    order = np.argsort(-margin, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(margin[order][:-1] != margin[order][1:], True)
    ok = np.flatnonzero((share >= precision) & last)
    if not len(ok):
        return float("inf")
    k = ok[-1]
    below = margin[order][k + 1] if k + 1 < len(order) else margin[order][k] - 1
    return round(float(margin[order][k] + below) / 2, 6)


def probability(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """(slope, shift) of the logistic curve that gives the share of positives at a margin (Platt's way, with its targets
    drawn in from 0 and 1)."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
    return round(max(float(w[0]), 1e-3), 6), round(float(w[1]), 6)


def expression(trees: list, features: list[Column]) -> Column:
    """The sum of the trees over columns."""

    def of(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(features[tree[0]] <= F.lit(tree[1]), of(tree[2])).otherwise(of(tree[3]))

    total = F.lit(0.0)
    for t in trees:
        total = total + of(t)
    return total
