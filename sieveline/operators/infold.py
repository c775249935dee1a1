"""Chains of scaling, column selection and a linear model, fitted inside every fold.

What a step learns from held-out rows leaks into their score, so means, deviations and the
choice of columns must come from the other folds alone.  All three follow from sums that one
pass collects by fold: the Gram matrix of a fold's complement is the total less the fold's
own, standardised columns are an affine map of it, a choice of columns is a sub-matrix, and
relevance and redundancy are its correlations.  So a whole search over (penalty, number of
columns, fold) reads the rows once for all ridge cells, or once a Newton step for all
logistic cells, and once to score them.

One-hot columns of categories that a fold's training rows lack are constant there and get
coefficient zero, as if the encoder had been fitted on these rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.scalars import dot
from sieveline.operators import linear, stats


@dataclass
class Scaled:
    """Sums of standardised columns: the Gram matrix of ``[1, features, label]`` and what was subtracted and divided."""

    gram: np.ndarray
    center: np.ndarray
    scale: np.ndarray


def _affine(gram: np.ndarray, center: np.ndarray, divide: np.ndarray) -> np.ndarray:
    """The Gram matrix of ``[1, (x - center) / divide, label]``."""
    d = len(center)
    turn = np.eye(d + 2)
    turn[1 : d + 1, 0] = -center / divide
    turn[np.arange(1, d + 1), np.arange(1, d + 1)] = 1 / divide
    return turn @ gram @ turn.T


def scaled_sums(gram: np.ndarray, scale: np.ndarray) -> Scaled:
    """Standardise the columns marked in ``scale``; the others and the label stay.  A zero deviation divides by 1."""
    d = len(scale)
    n, mean = gram[0, 0], gram[0, 1 : d + 1] / gram[0, 0]
    deviation = np.sqrt(np.clip(np.diag(gram)[1 : d + 1] / n - mean * mean, 0, None))
    flat = deviation <= 1e-12 * np.maximum(1.0, np.abs(mean))
    center, divide = np.where(scale, mean, 0.0), np.where(scale & ~flat, deviation, 1.0)
    return Scaled(_affine(gram, center, divide), center, divide)


# --- orders of columns, best first, from the sums of a training part ------------------------


def _by_relevance(gram: np.ndarray, _penalty: float) -> list[int]:
    """By absolute correlation with the label: the order of the F statistic, of two classes too."""
    corr = np.abs(stats.correlation_from_gram(gram)[:-1, -1])
    return np.argsort(-corr, kind="stable").tolist()


def _by_mrmr(gram: np.ndarray, _penalty: float) -> list[int]:
    """Greedy F statistic over mean absolute correlation with the columns chosen before."""
    corr = np.abs(stats.correlation_from_gram(gram))
    r2 = np.clip(corr[:-1, -1] ** 2, 0, 1 - 1e-15)
    relevance = r2 / (1 - r2) * (gram[0, 0] - 2)
    left, chosen = list(range(len(r2))), []
    while left:
        redundancy = np.clip(corr[np.ix_(left, chosen)], 0.001, None).mean(1) if chosen else np.ones(len(left))
        chosen.append(left.pop(int(np.argmax(relevance[left] / redundancy))))
    return chosen


def _by_elimination(gram: np.ndarray, penalty: float) -> list[int]:
    """Ridge refits that drop the smallest squared coefficient."""
    left, dropped = list(range(gram.shape[0] - 2)), []
    while len(left) > 1:
        _, w = linear.ridge_solve(gram, penalty, left)
        dropped.append(left.pop(int(np.argmin(w**2))))
    return [*left, *dropped[::-1]]


SELECTORS: dict[str, Callable[[np.ndarray, float], list[int]]] = {
    "f": _by_relevance, "mrmr": _by_mrmr, "rfe": _by_elimination,
}


# --- search -----------------------------------------------------------------------------------


@dataclass
class Chain:
    """A fitted chain: the columns it keeps, their scaling, and the model of the columns as they are."""

    features: list[str]
    center: list[float]
    scale: list[float]
    intercept: float
    coef: list[float]

    def margin(self) -> Column:
        """The linear predictor as a column."""
        return dot(self.features, self.coef, self.intercept)


@dataclass
class Search:
    """Cells (penalty, size, mean, std) of a search, the best one and the chain refitted on all rows."""

    cells: list[tuple[float, int, float, float]]
    penalty: float
    size: int
    chain: Chain

    def table(self, spark) -> DataFrame:
        rows = [(*c, c[0] == self.penalty and c[1] == self.size) for c in self.cells]
        return spark.createDataFrame(rows, "penalty double, size int, mean double, std double, best boolean")


def chain_specs(grams: dict[int, np.ndarray], cells, holds, scale: np.ndarray, selector) -> list[linear.LogisticSpec]:
    """A spec for every (penalty, size) cell and held-out fold (None: none), scaled and selected on the rest."""
    order = SELECTORS[selector] if isinstance(selector, str) else selector
    total = sum(grams.values())
    parts = {h: scaled_sums(total - grams[h] if h is not None else total, scale) for h in holds}
    orders: dict = {}
    out = []
    for (penalty, size), hold in itertools.product(cells, holds):
        part = parts[hold]
        if order is None:
            subset = list(range(len(scale)))
        else:
            if (penalty, hold) not in orders:
                orders[penalty, hold] = list(order(part.gram, penalty))
            subset = sorted(orders[penalty, hold][:size])
        out.append(linear.LogisticSpec(subset, penalty, hold, part.center[subset], part.scale[subset]))
    return out


def fit_specs(df, cols, label, specs, fold, task, grams, start=None, counts=None) -> list[tuple[float, np.ndarray]]:
    """The models of ``specs`` for the columns as they are; with ``counts`` logistic ones by ``logistic_fit_near``."""
    if task == "classification" and counts is not None:
        models = [(float(b[0]), b[1:]) for b, _ in linear.logistic_fit_near(df, cols, label, specs, fold, start=start, counts=counts)]
    elif task == "classification":
        models = linear.logistic_fit_many(df, cols, label, specs, fold=fold)
    else:
        total, models = sum(grams.values()), []
        for s in specs:
            center, divide = np.zeros(len(cols)), np.ones(len(cols))
            center[s.subset], divide[s.subset] = s.center, s.scale
            part = total - grams[s.hold_out] if s.hold_out is not None else total
            models.append(linear.ridge_solve(_affine(part, center, divide), s.c, s.subset))
    return [s.raw(b, w) for s, (b, w) in zip(specs, models, strict=True)]


def chain_search(
    df: DataFrame, cols: list[str], label: str, fold: str, task: str, penalties: list[float] | None = None,
    sizes: list[int] | None = None, selector: str | Callable | None = None, scale: list[str] | None = None,
) -> Search:
    """Cross-validate scaling, selection and a linear model together, then refit the best cell on all rows.

    ``scale`` lists the columns to standardise (default: all).  ``selector`` is a name of
    ``SELECTORS`` or ``f(gram, penalty) -> order of columns`` over the sums of standardised
    columns; ``sizes`` are the numbers of columns to keep.  Penalties are C of a balanced
    logistic model or alpha of a ridge model.  The first of equal cells wins.
    """
    grid = list(penalties or (linear.LOGISTIC_C if task == "classification" else linear.RIDGE_ALPHA))
    sizes = list(sizes) if selector is not None and sizes else [len(cols)]
    marked = np.array([scale is None or c in set(scale) for c in cols])
    grams = stats.gram(df, [*cols, label], fold=fold)
    if not grams:
        raise ValueError("no complete rows")
    holds = sorted(grams)
    cells = list(itertools.product(grid, sizes))
    specs = chain_specs(grams, cells, holds, marked, selector)
    models = fit_specs(df, cols, label, specs, fold, task, grams)
    scores = linear.cv_scores(df, cols, label, models, specs, fold, task).reshape(len(cells), len(holds))
    mean, spread = linear.fold_means(scores)
    best = int(np.nanargmax(mean))
    (last,) = chain_specs(grams, [cells[best]], [None], marked, selector)
    ((b, w),) = fit_specs(df, cols, label, [last], fold, task, grams)
    chain = Chain([cols[i] for i in last.subset], last.center.tolist(), last.scale.tolist(), float(b), [float(v) for v in w])
    rows = [(float(p), int(n), float(m), float(s)) for (p, n), m, s in zip(cells, mean, spread, strict=True)]
    return Search(rows, *cells[best], chain)


def tune_subsets(
    df: DataFrame, cols: list[str], label: str, fold: str, task: str, subsets: list[list[int]],
    penalties: list[float] | None = None,
) -> list[tuple[float, float, np.ndarray]]:
    """(penalty, intercept, coefficients of the columns as they are) of each subset's tuned model.

    Every subset is scaled and cross-validated over the penalties by itself, but all
    (subset, penalty, fold) cells share the passes; then each is refitted on all rows at its best.
    """
    grid = list(penalties or (linear.LOGISTIC_C if task == "classification" else linear.RIDGE_ALPHA))
    grams = stats.gram(df, [*cols, label], fold=fold)
    if not grams:
        raise ValueError("no complete rows")
    holds, total = sorted(grams), sum(grams.values())
    parts = {h: scaled_sums(total - grams[h] if h is not None else total, np.ones(len(cols), bool)) for h in [*holds, None]}

    def spec(subset, penalty, hold):
        at = np.array(subset, int)
        return linear.LogisticSpec(subset, penalty, hold, parts[hold].center[at], parts[hold].scale[at])

    specs = [spec(s, p, h) for s in subsets for p in grid for h in holds]
    counts: dict = {}
    models = fit_specs(df, cols, label, specs, fold, task, grams, counts=counts)
    longest = int(max(g[0, 0] for g in grams.values()))  # complete rows of a fold
    scores = linear.cv_scores(df, cols, label, models, specs, fold, task, longest).reshape(-1, len(holds))
    mean = linear.fold_means(scores)[0].reshape(len(subsets), len(grid))
    best = [int(np.nanargmax(row)) if np.isfinite(row).any() else 0 for row in mean]
    last = [spec(s, grid[at], None) for s, at in zip(subsets, best, strict=True)]
    start = None
    if task == "classification":  # the folds' models are near
        start = []
        for i, (s, at) in enumerate(zip(last, best, strict=True)):
            first = (i * len(grid) + at) * len(holds)
            near = [s.own(b, w) for b, w in models[first : first + len(holds)]]
            start.append(np.mean([np.concatenate([[b], w]) for b, w in near], axis=0))
    found = fit_specs(df, cols, label, last, fold, task, grams, start, counts)
    return [(grid[at], b, w) for at, (b, w) in zip(best, found, strict=True)]


def predict(df: DataFrame, chain: Chain, task: str, out: str = "prediction") -> DataFrame:
    """``df`` with the chain's prediction, or the probability of class 1."""
    margin = chain.margin()
    return df.withColumn(out, 1 / (1 + F.exp(-margin)) if task == "classification" else margin)
