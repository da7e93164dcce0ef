"""Gradient-boosted trees of small depth, fitted with numpy on the driver and compiled into column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int = 10, ridge: float = 1.0, cuts: int = 32) -> Node:
    """The tree of at most depth levels that best reduces the second-order loss; a row goes low if feature <= cut."""
    node = Node(value=float(gradient.sum() / (hessian.sum() + ridge)))
    if depth == 0 or len(x) < 2 * least:
        return node
    score = lambda g, h: g * g / (h + ridge)
    whole, best = score(gradient.sum(), hessian.sum()), 1e-6
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > cuts:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, cuts + 1)))
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            n = int(low.sum())
            if n < least or len(x) - n < least:
                continue
            gain = score(gradient[low].sum(), hessian[low].sum()) + score(gradient[~low].sum(), hessian[~low].sum()) - whole
            if gain > best:
                best, node.feature, node.cut = gain, f, float(cut)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.low = grow(x[low], gradient[low], hessian[low], depth - 1, least, ridge, cuts)
        node.high = grow(x[~low], gradient[~low], hessian[~low], depth - 1, least, ridge, cuts)
    return node


def values(node: Node, x: np.ndarray) -> np.ndarray:
    if node.low is None or node.high is None:
        return np.full(len(x), node.value)
    low = x[:, node.feature] <= node.cut
    return np.where(low, values(node.low, x), values(node.high, x))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 10) -> tuple[float, list[Node]]:
    """(start, trees) of a logistic model: log odds are start plus rate times the trees' values (already scaled)."""
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    odds, out = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        tree = grow(x, y - p, p * (1 - p), depth, least)
        _scale(tree, rate)
        odds += values(tree, x)
        out.append(tree)
    return start, out


def _scale(node: Node, by: float) -> None:
    node.value *= by
    if node.low is not None and node.high is not None:
        _scale(node.low, by)
        _scale(node.high, by)


def log_odds(model: tuple[float, list[Node]], x: np.ndarray) -> np.ndarray:
    return model[0] + sum((values(t, x) for t in model[1]), np.zeros(len(x)))


def compiled(model: tuple[float, list[Node]], feature: Callable[[int], Column]) -> Column:
    """The model's log odds as a column expression over its features."""

    def of(node: Node) -> Column:
        if node.low is None or node.high is None:
            return F.lit(round(node.value, 6))
        return F.when(feature(node.feature) <= F.lit(node.cut), of(node.low)).otherwise(of(node.high))

    out = F.lit(round(model[0], 6))
    for t in model[1]:
        out = out + of(t)
    return out
