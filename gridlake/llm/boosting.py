"""Small gradient-boosted trees for a binary label, fitted on the driver and applied as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """A leaf has a value; other nodes send feature <= cut to low."""

    value: float = 0.0
    feature: str = ""
    cut: float = 0.0
    low: "Tree | None" = None
    high: "Tree | None" = None


@dataclass(frozen=True)
class Boosted:
    """precision: that of held-out rows from the threshold on; selected: how many of them."""

    start: float
    trees: tuple[Tree, ...]
    threshold: float
    precision: float = 0.0
    selected: int = 0

    def margin(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values()))) if x else 0
        return self.start + sum((_apply(t, x, np.arange(n)) for t in self.trees), np.zeros(n))

    def margin_column(self, of) -> Column:
        """The same as an expression; of(name) gives a feature's column."""
        total = F.lit(float(self.start))
        for t in self.trees:
            total = total + _column(t, of)
        return total


def _apply(tree: Tree, x: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    if tree.low is None:
        return np.full(len(at), tree.value)
    goes = x[tree.feature][at] <= tree.cut
    out = np.empty(len(at))
    out[goes], out[~goes] = _apply(tree.low, x, at[goes]), _apply(tree.high, x, at[~goes])
    return out


def _column(tree: Tree, of) -> Column:
    if tree.low is None:
        return F.lit(float(tree.value))
    return F.when(of(tree.feature) <= tree.cut, _column(tree.low, of)).otherwise(_column(tree.high, of))


def _binned(x: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each feature, in order of names, its distinct values and each row's place among them."""
    return {name: np.unique(x[name], return_inverse=True) for name in sorted(x)}


def _grow(bins: dict[str, tuple[np.ndarray, np.ndarray]], g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int, rate: float) -> Tree:
    """The cut with the largest gain, from sums by distinct value."""
    total_g, total_h = g[at].sum(), h[at].sum()
    best = (1e-9, None, 0)
    if depth and len(at) >= 10:
        for name, (values, codes) in bins.items():
            code = codes[at]
            many = np.cumsum(np.bincount(code, minlength=len(values)))[:-1]
            cuts = np.flatnonzero((many > 0) & (many < len(at)))
            if not len(cuts):
                continue
            lg, lh = (np.cumsum(np.bincount(code, s[at], len(values)))[cuts] for s in (g, h))
            gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], name, int(cuts[k]))
    if best[1] is None:
        return Tree(value=float(rate * total_g / (total_h + 1)))
    values, codes = bins[best[1]]
    goes = codes[at] <= best[2]
    return Tree(feature=best[1], cut=float(values[best[2]]), low=_grow(bins, g, h, at[goes], depth - 1, rate), high=_grow(bins, g, h, at[~goes], depth - 1, rate))


FOLDS = 3


def _boost(x: dict[str, np.ndarray], y: np.ndarray, rounds: int, depth: int, rate: float) -> Boosted:
    if not len(y) or y.min() == y.max():
        return Boosted(-20.0 if not len(y) or y.min() == 0 else 20.0, (), float("inf"))
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin, trees, bins = np.full(len(y), start), [], _binned(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_grow(bins, y - p, p * (1 - p), np.arange(len(y)), depth, rate))
        margin += _apply(trees[-1], x, np.arange(len(y)))
    return Boosted(start, tuple(trees), float("inf"))


def fit(x: dict[str, np.ndarray], y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.3, precision: float = 0.98, least: int = 8, judged: np.ndarray | None = None) -> Boosted:
    """Fit on all rows; calibrate the threshold on margins of rows that a model didn't see, in three folds.

    The threshold is the lowest margin from which on the share of right ones stays at or above precision,
    with least rows selected at least; without one nothing is ever selected. judged: the rows that count for
    it, where others are there to learn from only.
    """
    y = y.astype(float)
    if len(y) < 2 * least or y.min() == y.max():
        return Boosted(0.0, (), float("inf"))
    fold, score = np.arange(len(y)) % FOLDS, np.empty(len(y))
    for k in range(FOLDS):
        out = fold == k
        seen = _boost({f: v[~out] for f, v in x.items()}, y[~out], rounds, depth, rate)
        score[out] = seen.margin({f: v[out] for f, v in x.items()})
    model = _boost(x, y, rounds, depth, rate)
    if judged is not None:
        score, y = score[judged], y[judged]
    if not len(y):
        return Boosted(model.start, model.trees, float("inf"))
    order = np.argsort(-score, kind="stable")
    right, count = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    good = (right / count >= precision) & np.append(np.diff(score[order]) < 0, True) & (count >= least)
    last = np.flatnonzero(good)
    if not len(last):
        return Boosted(model.start, model.trees, float("inf"))
    n = int(last[-1])
    return Boosted(model.start, model.trees, float(score[order][n]), float(right[n] / (n + 1)), n + 1)
