"""Linear models whose data passes are sums of small matrices.

``sum_blocks`` is the one data pass everything here shares: each task turns its
Arrow batches into one matrix per model with BLAS, Spark adds the matrices up,
and the driver solves systems of the size of the feature count.  Whole grids
(folds x penalties x feature subsets) therefore cost one pass per Newton step,
not one fit per cell.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Tasks whose sums are added in one group before the groups are.
_FAN_IN = 64
#: Numbers in one row of a task's sums.
_TILE = 1 << 16
#: Models whose margins are held at once for a batch of rows.
_TOGETHER = 64
#: Refits of an elimination that share their passes.
_AHEAD = 32


def features_array(cols: list[str]):
    return F.expr(f"array({', '.join(f'CAST(`{c}` AS DOUBLE)' for c in cols)})")  # one call, however many columns


def _batch_arrays(batch, d: int):
    """(x, y, w, fold) of an Arrow batch without copying row by row."""
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    col = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=float).reshape(batch.num_rows, d), col("y"), col("w"), col("f")


def sum_blocks(
    df: DataFrame,
    cols: list[str],
    label: str | None,
    kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]],
    fold: str | None = None,
    weight: str | None = None,
    missing: bool = False,
) -> dict[int, np.ndarray]:
    """Sum over all rows of the arrays a kernel yields per batch, keyed by an int.

    ``kernel(x, y, w, fold)`` sees one Arrow batch as numpy arrays.  Rows with a
    missing or non-finite number are left out (complete cases); with ``missing``
    the kernel gets all rows and finds NaN there.  A task emits each key's array in
    tiles of half a megabyte, so a wide matrix is no wide row; tiles are added
    element-wise by a JVM vector summary, spread by key and tile, first within groups
    of tasks, so that no reducer gets a row from every task.
    """
    packed = df.select(
        features_array(cols).alias("x"),
        (F.col(label).cast("double") if label else F.lit(0.0)).alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        (F.col(fold).cast("int") if fold else F.lit(0)).alias("f"),
    )

    d = len(cols)

    def partial(batches):
        part = TaskContext.get().partitionId()
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, y, w, f = _batch_arrays(b, d)
            if not missing:
                whole = np.isfinite(x).all(1) & np.isfinite(y) & np.isfinite(w)
                x, y, w, f = x[whole], y[whole], w[whole], f[whole]
                if not len(x):
                    continue
            for key, m in kernel(x, y, w, f):
                acc[key] = acc[key] + m if key in acc else np.array(m, dtype=float)
        for key, m in acc.items():
            flat = m.ravel()
            for tile in range(0, max(1, len(flat)), _TILE):
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array([key], pa.int32()), "tile": pa.array([tile // _TILE], pa.int32()),
                    "grp": pa.array([part // _FAN_IN], pa.int32()),
                    "v": pa.array([flat[tile : tile + _TILE]], pa.list_(pa.float64())),
                })

    sums = (
        packed.mapInArrow(partial, "key int, tile int, grp int, v array<double>")
        .groupBy("key", "tile", "grp")
        .agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
        .groupBy("key", "tile")
        .agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
        .collect()  # feature-sized, in tiles
    )
    out: dict[int, list] = {}
    for r in sorted(sums, key=lambda r: (r["key"], r["tile"])):
        out.setdefault(r["key"], []).append(np.array(r["v"]))
    return {key: np.concatenate(tiles) for key, tiles in out.items()}


# --- ridge ------------------------------------------------------------------


def ridge_solve(g: np.ndarray, alpha: float, subset: list[int] | None = None) -> tuple[float, np.ndarray]:
    """Ridge coefficients from a Gram matrix of ``[1, features, label]``.

    Minimises ``||y - Xw - b||^2 + alpha ||w||^2`` with a free intercept.
    """
    last = g.shape[0] - 1
    idx = np.arange(1, last) if subset is None else np.asarray(subset) + 1
    n = g[0, 0]
    mean, mean_y = g[0, idx] / n, g[0, last] / n
    a = g[np.ix_(idx, idx)] - n * np.outer(mean, mean)
    b = g[idx, last] - n * mean * mean_y
    w = np.linalg.lstsq(a + alpha * np.eye(len(idx)), b, rcond=None)[0] if len(idx) else np.zeros(0)
    return float(mean_y - mean @ w), w


def ridge_fit(df: DataFrame, cols: list[str], label: str, alpha: float = 1.0) -> tuple[float, np.ndarray]:
    from sieveline.operators.stats import gram

    return ridge_solve(gram(df, [*cols, label])[0], alpha)


# --- logistic, many models at once -------------------------------------------


def balanced_class_weights(counts: dict) -> dict:
    """n / (K * n_c) per class."""
    total, k = sum(counts.values()), len(counts)
    return {c: total / (k * n) for c, n in counts.items()}


class LogisticSpec:
    """One member of a batch: which features, which held-out fold, which penalty.

    With ``center`` and ``scale`` (one number for each feature of ``subset``) the model is
    fitted, and its penalty applies, to ``(x - center) / scale``.
    """

    def __init__(self, subset, c=1.0, hold_out=None, center=None, scale=None):
        self.subset, self.c, self.hold_out = list(subset), float(c), hold_out
        self.center, self.scale = center, scale

    def scaled(self, x: np.ndarray) -> np.ndarray:
        xs = x[:, self.subset]
        return xs if self.center is None else (xs - self.center) / self.scale

    def raw(self, intercept: float, coef: np.ndarray) -> tuple[float, np.ndarray]:
        """The same model for the features as they are."""
        if self.center is None:
            return intercept, coef
        return float(intercept - np.sum(coef * self.center / self.scale)), coef / self.scale

    def own(self, intercept: float, coef: np.ndarray) -> tuple[float, np.ndarray]:
        """The model as fitted of a model for the features as they are."""
        if self.center is None:
            return intercept, coef
        return float(intercept + np.sum(coef * self.center)), coef * self.scale


def complete(cols: list[str]):
    """True for rows in which no column is missing or infinite, the rows that fits use."""
    whole = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.forall(features_array(cols), whole)


def _label_counts(df: DataFrame, cols: list[str], label: str, fold: str | None) -> dict:
    keys = [F.col(fold).cast("int").alias("f")] if fold else [F.lit(0).alias("f")]
    rows = df.filter(complete([*cols, label]))
    rows = rows.groupBy(*keys, F.col(label).cast("double").alias("y")).count().collect()  # folds x classes
    return {(r["f"], r["y"]): r["count"] for r in rows}


def _shared_coordinates(specs: list[LogisticSpec], d: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Origin and unit of every feature, near those of the specs, and each spec's map from ``[1, (x - origin) / unit]``."""
    n, origin, unit = np.zeros(d), np.zeros(d), np.zeros(d)
    for s in specs:
        n[s.subset] += 1
        origin[s.subset] += 0.0 if s.center is None else s.center
        unit[s.subset] += 1.0 if s.center is None else s.scale
    origin, unit = origin / np.maximum(n, 1), np.where(n > 0, unit / np.maximum(n, 1), 1.0)
    maps = []
    for s in specs:
        at, k = np.array(s.subset, int), len(s.subset)
        center, scale = (np.zeros(k), np.ones(k)) if s.center is None else (s.center, s.scale)
        turn = np.zeros((k + 1, k + 1))
        turn[0, 0] = 1.0
        turn[1:, 0] = (origin[at] - center) / scale
        turn[np.arange(1, k + 1), np.arange(1, k + 1)] = unit[at] / scale
        maps.append(turn)
    return origin, unit, maps


#: Stands for a missing fold, which no spec holds out.
_NO_FOLD = -(1 << 28)


def _class_grams(df, cols, label, fold, origin, unit) -> dict[tuple, np.ndarray] | None:
    """(fold, class) → Gram matrix of ``[1, (x - origin) / unit]``; None if the label has values besides 0 and 1.

    Without coefficients all logistic fits have their counts, gradients and curvatures in these.
    """

    def kernel(x, y, w, f):
        z = np.hstack([np.ones((len(x), 1)), (x - origin) / unit])
        folds = np.where(np.isnan(f), _NO_FOLD, f).astype(int)
        kind = np.where(y == 0, 0, np.where(y == 1, 1, 2))
        for g in np.unique(folds):
            for c in range(3):
                at = (folds == g) & (kind == c)
                if at.any():
                    yield 3 * int(g) + c, z[at].T @ z[at]

    side = len(cols) + 1
    found = {divmod(key, 3): m.reshape(side, side) for key, m in sum_blocks(df, cols, label, kernel, fold=fold).items()}
    return None if any(c == 2 for _, c in found) else found


def _class_weights(counts: dict, spec: LogisticSpec, balanced: bool = True) -> dict:
    """The weight of each class among the rows that a spec is fitted on."""
    kept: dict = {}
    for (f, y), n in counts.items():
        if spec.hold_out is None or f != spec.hold_out:
            kept[y] = kept.get(y, 0) + n
    if not kept:
        raise ValueError("no complete rows")
    return balanced_class_weights(kept) if balanced else dict.fromkeys(kept, 1.0)


def _sums_at_zero(grams: dict, spec: LogisticSpec, class_w: dict) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, curvature) without coefficients."""
    side = [0, *(c + 1 for c in spec.subset)]
    loss, grad, hess = 0.0, np.zeros(len(side)), np.zeros((len(side), len(side)))
    for (f, y), m in grams.items():
        if spec.hold_out is None or f != spec.hold_out:
            cw = class_w.get(float(y), 1.0)
            loss += cw * m[0, 0] * np.log(2.0)
            grad += cw * (0.5 - y) * m[0, side]
            hess += 0.25 * cw * m[np.ix_(side, side)]
    return loss, grad, hess


def _newton_sums(df, cols, label, fold, specs, betas, class_w, origin, unit) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(loss, gradient, curvature) of every spec at its coefficients, all for ``[1, (x - origin) / unit]``, in one pass.

    Specs of one held-out fold share their rows, and those of one subset its columns.
    """
    d = len(cols)
    bounds, size = [0], 0  # specs whose sums travel as one array
    for i, s in enumerate(specs):
        n = 1 + (len(s.subset) + 1) * (len(s.subset) + 2)
        if size and size + n > _TILE:
            bounds.append(i)
            size = 0
        size += n
    bounds.append(len(specs))
    together = _TOGETHER  # a plain value for the tasks
    groups: dict = {}
    for b, (lo, hi) in enumerate(itertools.pairwise(bounds)):
        for i in range(lo, hi):
            groups.setdefault((b, specs[i].hold_out), []).append(i)
    plans = []
    for (b, hold), members in groups.items():
        coef = np.zeros((d + 1, len(members)))
        for j, i in enumerate(members):
            coef[[0, *(c + 1 for c in specs[i].subset)], j] = betas[i]
        weights = np.array([[class_w[i].get(0.0, 1.0), class_w[i].get(1.0, 1.0)] for i in members]).T
        plans.append((b, hold, [(i - bounds[b], tuple([0, *(c + 1 for c in specs[i].subset)])) for i in members], coef, weights))

    def kernel(x, y, w, f):
        z = np.hstack([np.ones((len(x), 1)), (x - origin) / unit])
        out: dict[int, dict] = {}
        for b, hold, members, coef, weights in plans:
            keep = slice(None) if hold is None else f != hold
            zs, ys, ws = z[keep], y[keep], w[keep]
            last, part = None, zs
            for lo in range(0, len(members), together):
                some = slice(lo, lo + together)
                m = zs @ coef[:, some]
                wi = ws[:, None] * weights[(ys > 0.5).astype(int)][:, some]
                e = np.exp(-np.abs(m))
                p = np.where(m >= 0, 1.0, e) / (1.0 + e)
                loss = np.sum(wi * (np.log1p(e) + np.maximum(m, 0.0) - ys[:, None] * m), axis=0)
                grad = zs.T @ (wi * (p - ys[:, None]))
                bend = wi * (p * (1.0 - p))
                for j, (at, columns) in enumerate(members[some]):
                    if columns != last:
                        last, part = columns, zs[:, columns]
                    hess = (part * bend[:, j : j + 1]).T @ part
                    out.setdefault(b, {})[at] = np.concatenate([[loss[j]], grad[list(columns), j], hess.ravel()])
        for b, parts in out.items():
            yield b, np.concatenate([parts[at] for at in sorted(parts)])

    sums = sum_blocks(df, cols, label, kernel, fold=fold)
    out = []
    for b, (lo, hi) in enumerate(itertools.pairwise(bounds)):
        flat, start = sums[b], 0
        for s in specs[lo:hi]:
            k = len(s.subset) + 1
            out.append((flat[start], flat[start + 1 : start + 1 + k], flat[start + 1 + k : start + 1 + k + k * k].reshape(k, k)))
            start += 1 + k + k * k
    return out


def _own_sums(df, cols, label, fold, specs, betas, class_w) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(loss, gradient, curvature) of every spec at its coefficients, each in its own scaling, in one pass."""
    jobs = list(enumerate(zip(specs, betas, class_w, strict=True)))

    def kernel(x, y, w, f):
        for i, (spec, beta, cw) in jobs:
            keep = slice(None) if spec.hold_out is None else f != spec.hold_out
            xs, ys = spec.scaled(x[keep]), y[keep]
            if not len(ys):
                continue
            z = np.hstack([np.ones((len(xs), 1)), xs])
            m = z @ beta
            p = 1.0 / (1.0 + np.exp(-np.clip(m, -500, 500)))
            wi = w[keep] * np.where(ys > 0.5, cw.get(1.0, 1.0), cw.get(0.0, 1.0))
            loss = np.sum(wi * (np.logaddexp(0, m) - ys * m))
            grad = z.T @ (wi * (p - ys))
            hess = (z * (wi * p * (1 - p))[:, None]).T @ z
            yield i, np.concatenate([[loss], grad, hess.ravel()])

    sums = sum_blocks(df, cols, label, kernel, fold=fold)
    sides = [len(b) for b in betas]
    return [(sums[i][0], sums[i][1 : d + 1], sums[i][d + 1 :].reshape(d, d)) for i, d in enumerate(sides)]


def logistic_fit_many(
    df: DataFrame,
    cols: list[str],
    label: str,
    specs: list[LogisticSpec],
    fold: str | None = None,
    balanced: bool = True,
    iterations: int = 25,
    tol: float = 1e-6,
    start: list[np.ndarray] | None = None,
) -> list[tuple[float, np.ndarray]]:
    """L2 logistic regressions, all fitted together by Newton steps.

    Minimises ``sum w_i logloss_i + |beta|^2 / (2C)`` with a free intercept, for
    every spec at once: a step is one pass over the rows whatever the number of
    specs.  ``start`` holds earlier coefficients (intercept first).  Steps are halved for a
    spec whose objective went up.  A fit that has not settled after ``iterations`` passes is
    warned about and returned at the best point whose objective was computed.
    """
    counts = _label_counts(df, cols, label, fold)
    class_w = [_class_weights(counts, s, balanced) for s in specs]

    def sums(active, betas):
        return _own_sums(df, cols, label, fold, [specs[i] for i in active], [betas[i] for i in active], [class_w[i] for i in active])

    return [(float(b[0]), b[1:]) for b, _ in _newton(specs, sums, iterations, tol, start)]


def logistic_fit_near(
    df, cols, label, specs, fold=None, tol: float = 1e-6, start: list[np.ndarray] | None = None, counts: dict | None = None,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """As ``logistic_fit_many``, for hundreds of specs of nearly the same scaling or with a near ``start``.

    All specs share one scaling of the rows and, without ``start``, the first step comes from
    Gram matrices by fold and class.  ``counts`` holds the complete rows by (fold, class), if
    known; an empty dict is filled for later calls.  Returns the coefficients, intercept
    first, and the curvature of the objective where it was last computed.
    """
    if not specs:
        return []
    origin, unit, maps = _shared_coordinates(specs, len(cols))
    grams = None if start is not None else _class_grams(df, cols, label, fold, origin, unit)
    if not counts:
        found = _label_counts(df, cols, label, fold) if grams is None else {(f, float(y)): round(m[0, 0]) for (f, y), m in grams.items()}
        counts = {} if counts is None else counts
        counts.update(found)
    class_w = [_class_weights(counts, s) for s in specs]
    fresh = grams is not None

    def sums(active, betas):
        nonlocal fresh
        if fresh:
            fresh = False
            found = [_sums_at_zero(grams, specs[i], class_w[i]) for i in active]
        else:
            shared = [maps[i].T @ betas[i] for i in active]
            found = _newton_sums(df, cols, label, fold, [specs[i] for i in active], shared, [class_w[i] for i in active], origin, unit)
        return [(loss, maps[i] @ grad, maps[i] @ hess @ maps[i].T) for i, (loss, grad, hess) in zip(active, found, strict=True)]

    return _newton(specs, sums, 25, tol, start)


def _newton(specs, sums: Callable, iterations: int, tol: float, start) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coefficients, last curvature) of every spec; ``sums(active, betas)`` has their losses, gradients and curvatures."""
    betas = [np.zeros(len(s.subset) + 1) for s in specs] if start is None else [b.copy() for b in start]
    steps: list[np.ndarray | None] = [None] * len(specs)
    bends: list = [None] * len(specs)
    best = [np.inf] * len(specs)
    done = [False] * len(specs)
    known = [b.copy() for b in betas]

    for _ in range(iterations):
        active = [i for i in range(len(specs)) if not done[i]]
        if not active:
            break
        for i, (loss, grad, hess) in zip(active, sums(active, betas), strict=True):
            beta, c = betas[i], specs[i].c
            d = len(beta)
            ridge = np.concatenate([[0.0], np.full(d - 1, 1.0 / c)])
            objective = loss + 0.5 * np.sum(ridge * beta**2)
            if steps[i] is not None and objective > best[i] + 1e-9 * abs(best[i]):
                steps[i] = steps[i] / 2
                betas[i] = beta - steps[i]
                continue
            best[i], known[i] = objective, beta
            grad = grad + ridge * beta
            bends[i] = hess + np.diag(ridge) + 1e-10 * np.eye(d)
            step = -np.linalg.lstsq(bends[i], grad, rcond=None)[0]
            if np.max(np.abs(step)) < tol * max(1.0, np.max(np.abs(beta))):
                done[i] = True
            steps[i] = step
            betas[i] = beta + step
    _warn_open(done, iterations)
    betas = [b if ok else k for b, k, ok in zip(betas, known, done, strict=True)]
    return list(zip(betas, bends, strict=True))


def _warn_open(done: list[bool], passes: int) -> None:
    if not all(done):
        warnings.warn(f"{done.count(False)} of {len(done)} fits did not settle in {passes} passes", stacklevel=4)


# --- scoring many models in one pass -----------------------------------------


class _Margins:
    """Linear predictors of many models for the Arrow batches of :func:`_packed`.

    Like fits, scores are over complete rows.  Coefficients are those of the features as they are.
    """

    def __init__(self, cols: list[str], models: list, specs: list):
        self.d = len(cols)
        self.coef = np.zeros((len(models), self.d))
        for i, ((_, w), s) in enumerate(zip(models, specs, strict=True)):
            self.coef[i, list(s.subset)] = w
        self.bias = np.array([float(b) for b, _ in models])
        self.holds = np.array([-1 if s.hold_out is None else s.hold_out for s in specs])

    def each(self, batch):
        """(model, fold, y, margin) for every model on the rows of its held-out fold, all rows when it has none."""
        rows, y, _, f = _batch_arrays(batch, self.d)
        whole = np.isfinite(rows).all(1) & np.isfinite(y)
        rows, y, f = rows[whole], y[whole], f[whole]
        for fold in np.unique(f):
            at = f == fold
            used = np.flatnonzero((self.holds == -1) | (self.holds == fold))
            ys, m = y[at], rows[at] @ self.coef[used].T + self.bias[used]
            for c, i in enumerate(used):
                yield int(i), int(fold), ys, m[:, c]


def _packed(df: DataFrame, cols: list[str], label: str, fold: str | None) -> DataFrame:
    return df.select(
        features_array(cols).alias("x"), F.col(label).cast("double").alias("y"), F.lit(1.0).alias("w"),
        (F.col(fold).cast("int") if fold else F.lit(0)).alias("f"),
    )


def margins_long(df: DataFrame, cols: list[str], label: str, models: list, specs: list, fold: str | None) -> DataFrame:
    """(model, f, y, margin) for every model on the rows of its held-out fold, all rows when it has none."""
    margins = _Margins(cols, models, specs)

    def score(batches):
        for b in batches:
            for i, f, y, m in margins.each(b) if b.num_rows else ():
                yield pa.RecordBatch.from_pydict({
                    "model": pa.array(np.full(len(y), i, "int32")), "f": pa.array(np.full(len(y), f, "int32")),
                    "y": pa.array(y), "margin": pa.array(m),
                })

    return _packed(df, cols, label, fold).mapInArrow(score, "model int, f int, y double, margin double")


def aurocs(df, cols, label, models, specs, fold, by_fold: int = 1, longest: int | None = None) -> dict[int, float | None]:
    """AUROC of every model, or with ``by_fold`` folds of every (model * by_fold + fold), in two passes.

    ``longest`` is the most rows that a model is scored on, if known: few need one pass.
    """
    from sieveline.operators.evaluate import auroc_of_series

    margins = _Margins(cols, models, specs)

    def scores(batch):
        for i, f, y, m in margins.each(batch):
            yield (i if by_fold == 1 else i * by_fold + f), y > 0.5, m

    return auroc_of_series(_packed(df, cols, label, fold), scores, longest=longest)


def cv_scores(df, cols, label, models, specs, fold, task, longest: int | None = None) -> np.ndarray:
    """One score per model on its held-out rows: AUROC, or minus the mean absolute error."""
    if task == "classification":
        out = aurocs(df, cols, label, models, specs, fold, longest=longest)
    else:
        scored = margins_long(df, cols, label, models, specs, fold)
        rows = scored.groupBy("model").agg(F.avg(F.abs(F.col("y") - F.col("margin"))).alias("mae")).collect()
        out = {r["model"]: -r["mae"] for r in rows}
    return np.array([out.get(i) if out.get(i) is not None else np.nan for i in range(len(specs))], dtype=float)


#: The penalty grids of the comparison.
LOGISTIC_C = [0.1, 0.5, 1, 5, 10, 50, 100]
RIDGE_ALPHA = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1, 5, 10]


def _fold_ids(df: DataFrame, fold: str) -> list[int]:
    return sorted(r[0] for r in df.select(F.col(fold).cast("int")).distinct().collect())  # k values


def fit_models(df, cols, label, specs, fold, task):
    """Fit every spec: one Gram pass for ridge, one pass per Newton step for logistic."""
    if task == "classification":
        return logistic_fit_many(df, cols, label, specs, fold=fold)
    from sieveline.operators.stats import gram

    grams = gram(df, [*cols, label], fold=fold)
    total = sum(grams.values())
    return [
        ridge_solve(total - grams[s.hold_out] if s.hold_out is not None else total, s.c, s.subset) for s in specs
    ]


def fold_means(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of (cells x folds) scores over the folds that have one."""
    have = np.isfinite(scores)
    if not have.any():
        raise ValueError("no fold has a score: no complete rows, or one class only")
    n = np.where(have.any(1), have.sum(1), np.nan)
    mean = np.where(have, scores, 0.0).sum(1) / n
    return mean, np.sqrt(np.where(have, (scores - mean[:, None]) ** 2, 0.0).sum(1) / n)


def grid_search(df, cols, label, fold, task, grid=None):
    """Cross-validated penalty grid, refitted on all rows: (table rows, best penalty, intercept, coefs)."""
    grid = list(grid or (LOGISTIC_C if task == "classification" else RIDGE_ALPHA))
    ids = _fold_ids(df, fold)
    everything = list(range(len(cols)))
    specs = [LogisticSpec(everything, c, f) for c, f in itertools.product(grid, ids)]
    models = fit_models(df, cols, label, specs, fold, task)
    scores = cv_scores(df, cols, label, models, specs, fold, task).reshape(len(grid), len(ids))
    mean, spread = fold_means(scores)
    best = int(np.nanargmax(mean))
    (b, w), = fit_models(df, cols, label, [LogisticSpec(everything, grid[best])], fold, task)
    rows = [(float(p), float(m), float(s)) for p, m, s in zip(grid, mean, spread, strict=True)]
    return rows, grid[best], b, w


def sequential_select(
    df, cols, label, fold, task, direction="forward", penalty=1.0, n_select=None, tol=None
) -> list[tuple[str, float]]:
    """Greedy selection by cross-validated score: [(feature, score)] in pick order.

    ``n_select`` is a count, a fraction or None for the full order; with ``tol``
    the search stops when a step gains less.  For 'backward' the order is from
    most to least important, the survivor first.  A step fits and scores all
    candidates together.
    """
    d = len(cols)
    ids = _fold_ids(df, fold)
    size = d if n_select is None else int(n_select * d) if isinstance(n_select, float) else int(n_select)
    chosen: list[int] = []
    trail: list[tuple[int, float]] = []
    old = -np.inf
    rounds = size if direction == "forward" else d - 1 if n_select is None else d - size
    for _ in range(min(rounds, d - 1 if direction == "backward" else d)):
        candidates = [j for j in range(d) if j not in chosen]
        subsets = []
        for j in candidates:
            picked = [*chosen, j]
            subsets.append(picked if direction == "forward" else [i for i in range(d) if i not in picked])
        specs = [LogisticSpec(s, penalty, f) for s in subsets for f in ids]
        models = fit_models(df, cols, label, specs, fold, task)
        scores, _ = fold_means(cv_scores(df, cols, label, models, specs, fold, task).reshape(len(subsets), len(ids)))
        best = int(np.nanargmax(scores))
        if tol is not None and scores[best] - old < tol:
            break
        old = float(scores[best])
        chosen.append(candidates[best])
        trail.append((candidates[best], old))
    if direction == "forward":
        return [(cols[j], s) for j, s in trail]
    rest = [j for j in range(d) if j not in chosen]
    ordered = [(j, float("nan")) for j in rest] + trail[::-1]
    return [(cols[j], s) for j, s in ordered]


def _weakest(w: np.ndarray) -> int:
    """The smallest coefficient by size, the first of those equal but for rounding."""
    size = np.abs(w)
    return int(np.argmax(size <= size.min() * (1 + 1e-9)))


def _without(left: list[int], beta: np.ndarray, bend: np.ndarray, worst: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The subset without a column and, by the quadratic model at a fit, the coefficients and curvature of its own."""
    rest = [j for j in range(len(beta)) if j != worst + 1]
    inner = bend[np.ix_(rest, rest)]
    near = beta[rest] + np.linalg.lstsq(inner, bend[rest, worst + 1] * beta[worst + 1], rcond=None)[0]
    return [*left[:worst], *left[worst + 1 :]], near, inner


def _ahead(left: list[int], near: np.ndarray, bend: np.ndarray) -> list[tuple[list[int], np.ndarray]]:
    """The subsets that elimination should pass from here, ``left`` first, and coefficients near theirs."""
    out = [(left, near)]
    while len(left) > 2 and len(out) < _AHEAD:
        left, near, bend = _without(left, near, bend, _weakest(near[1:]))
        out.append((left, near))
    return out


def rfe_order(df, cols, label, task, penalty=1.0) -> list[str]:
    """Recursive elimination: drop the smallest squared coefficient, refit; best first.

    Ridge refits are sub-matrices of one Gram matrix (a single data pass).  Logistic refits of the
    subsets that should come next, by the quadratic model, share their passes.  Only refits decide
    which column goes: where one drops another than foreseen, the next are foreseen anew.
    """
    left = list(range(len(cols)))
    dropped: list[int] = []
    if task == "regression":
        from sieveline.operators.stats import gram

        total = gram(df, [*cols, label])[0]
        while len(left) > 1:
            _, w = ridge_solve(total, penalty, left)
            dropped.append(left.pop(int(np.argmin(w**2))))
        return [cols[j] for j in [*left, *dropped[::-1]]]
    counts: dict = {}
    near, bend = np.zeros(len(cols) + 1), None
    if len(left) > 1:
        near, bend = _first_step(df, cols, label, LogisticSpec(left, penalty), counts)
    fits: dict = {}
    while len(left) > 1:
        if tuple(left) not in fits:
            ahead = _ahead(left, near, bend)
            specs = [LogisticSpec(subset, penalty) for subset, _ in ahead]
            found = logistic_fit_near(df, cols, label, specs, tol=1e-4, start=[b for _, b in ahead], counts=counts)
            fits = {tuple(s.subset): fit for s, fit in zip(specs, found, strict=True)}
        beta, bend = fits[tuple(left)]
        worst = _weakest(beta[1:])
        dropped.append(left[worst])
        left, near, bend = _without(left, beta, bend, worst)
    return [cols[j] for j in [*left, *dropped[::-1]]]


def _first_step(df, cols, label, spec: LogisticSpec, counts: dict) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients after one step, curvature without any) of a fit; fills ``counts``."""
    d = len(cols)
    grams = _class_grams(df, cols, label, None, np.zeros(d), np.ones(d))
    if grams is None:
        counts.update(_label_counts(df, cols, label, None))
        ((beta, bend),) = logistic_fit_near(df, cols, label, [spec], tol=1e-4, counts=counts)
        return beta, bend
    counts.update({(f, float(y)): round(m[0, 0]) for (f, y), m in grams.items()})
    _, grad, hess = _sums_at_zero(grams, spec, _class_weights(counts, spec))
    bend = hess + np.diag([0.0, *[1.0 / spec.c] * len(spec.subset)]) + 1e-10 * np.eye(len(grad))
    return -np.linalg.lstsq(bend, grad, rcond=None)[0], bend


# --- group lasso ---------------------------------------------------------------

#: The penalty sequence of the regularisation path.
GROUP_LAMBDAS = [
    0.001, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08,
    0.09, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5,
]


def group_lasso_path(train, cols, label, groups: list[int], lambdas=None, evaluate_on=None):
    """Group-lasso logistic path from strong to weak penalties, then no penalty.

    Mean log loss + lambda * sum_k ||w_k|| / sqrt(|k|) (the groups' inverse size
    scaling), by :func:`sparse.sparse_path`.  Returns rows (step, lambda, n_selected, auroc,
    features); AUROC is on ``evaluate_on``.
    """
    from sieveline.operators.sparse import sparse_path

    seq = sorted(lambdas if lambdas is not None else GROUP_LAMBDAS, reverse=True) + [0.0]
    models = sparse_path(train, cols, label, "classification", seq, groups, sizes=True)
    specs = [LogisticSpec(range(len(cols))) for _ in models]
    target = evaluate_on if evaluate_on is not None else train
    found = aurocs(target, cols, label, models, specs, None)
    rows = []
    for step, (lam, (_, w)) in enumerate(zip(seq, models, strict=True)):
        kept = [c for c, v in zip(cols, w, strict=True) if abs(v) > 0]
        rows.append((step, float(lam), len(kept), found.get(step), kept))
    return rows


# --- lasso ----------------------------------------------------------------------


def lasso_path(df: DataFrame, cols: list[str], label: str, task: str, strengths: list[float]) -> list[list[tuple[str, float]]]:
    """L1 coefficients per feature at each strength: C of a balanced logistic model, or alpha of a linear one.

    All strengths share the passes over the rows.
    """
    from sieveline.operators.sparse import sparse_path

    penalties = list(strengths)
    if task == "classification":
        n = sum(_label_counts(df, cols, label, None).values())
        penalties = [1.0 / (s * max(1, n)) for s in strengths]
    found = sparse_path(df, cols, label, task, penalties, balanced=task == "classification")
    return [list(zip(cols, w.tolist(), strict=True)) for _, w in found]


def lasso_coefficients(df: DataFrame, cols: list[str], label: str, task: str, strength: float) -> list[tuple[str, float]]:
    """L1 coefficients per feature: C of a balanced logistic model, or alpha of a linear one."""
    return lasso_path(df, cols, label, task, [strength])[0]


def logistic_ml(df: DataFrame, cols: list[str], label: str, c: float = 1.0):
    """Balanced L2 logistic regression with Spark ML; returns (model, counts)."""
    from pyspark.ml.classification import LogisticRegression

    vec = df.withColumn("features", array_to_vector(features_array(cols))).withColumn("label", F.col(label).cast("double"))
    counts = {r["label"]: r["count"] for r in vec.groupBy("label").count().collect()}  # classes
    weights = balanced_class_weights(counts)
    n = sum(counts.values())
    w = F.when(F.col("label") > 0.5, F.lit(weights.get(1.0, 1.0))).otherwise(F.lit(weights.get(0.0, 1.0)))
    return LogisticRegression(
        weightCol="w", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9
    ).fit(vec.withColumn("w", w))
