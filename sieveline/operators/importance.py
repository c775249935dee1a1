"""Importance measures: permutation, Shapley values, k-means background, agreement table."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.scalars import dot, stable_hash
from sieveline.operators.evaluate import auroc, auroc_of_series
from sieveline.operators.linear import features_array, sum_blocks
from sieveline.operators.ordering import row_positions
from sieveline.operators.ranks import expand_to_features, kendall_tau
from sieveline.runtime import broadcast_if_small, cut_lineage, small_rows, spread


def mean_over_seeds(per_seed: DataFrame, by: list[str] = ("feature",)) -> DataFrame:
    return per_seed.groupBy(*by).agg(F.avg("score").alias("score"))


def mean_abs(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, score): mean absolute value of each column, in one aggregate."""
    wide = df.agg(*[F.avg(F.abs(F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("score")) for i, c in enumerate(cols)])
    return wide.select(F.explode(rows).alias("e")).select("e.*")


# --- permutation --------------------------------------------------------------------


def permutation(
    df: DataFrame, row_id: str, cols: list[str], label: str, intercept: float, weights, task: str,
    n_repeats: int = 30, seed: int = 1,
) -> DataFrame:
    """(feature, score): mean drop of AUROC (or rise of MAE) over the shuffles of a linear model.

    Row i takes feature values from row pi(i), with pi given by two exact hash
    orders of the rows.  The margin only changes by ``w_j (x'_j - x_j)``, so the
    shuffled margins of all features follow from one equi-join per repeat; all
    repeats are one shuffle and one scoring job.
    """
    x = features_array(cols)
    base = df.select(F.col(row_id).alias("_id"), F.col(label).cast("double").alias("_y"), x.alias("_x"),
                     dot(cols, weights, intercept).alias("_m"))
    base = cut_lineage(row_positions(base, stable_hash(f"own{seed}", "_id"), "_id", "_p"))
    repeats = base.select("_id", "_x", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("_r"))
    donors = row_positions(repeats, stable_hash(f"perm{seed}", "_r", "_id"), "_id", "_p", by=["_r"])
    donors = donors.select("_r", "_p", F.col("_x").alias("_d"))
    mixed = donors.join(base.select("_p", "_y", "_x", "_m"), "_p")
    w = F.array(*[F.lit(float(v)) for v in weights])
    if task == "classification":
        return _auroc_drops(base, mixed, cols, [float(v) for v in weights], n_repeats)
    deltas = F.transform(F.arrays_zip(F.col("_d"), F.col("_x"), w.alias("w")), lambda z: z["w"] * (z["_d"] - z["_x"]))
    scored = mixed.select("_r", "_y", "_m", F.posexplode(deltas).alias("_j", "_delta")).select(
        "_r", "_j", "_y", (F.col("_m") + F.col("_delta")).alias("_s")
    )
    per = scored.groupBy("_j", "_r").agg(F.avg(F.abs(F.col("_y") - F.col("_s"))).alias("_v"))
    full = base.agg(F.avg(F.abs(F.col("_y") - F.col("_m")))).first()[0]
    drop = F.col("_v") - F.lit(full)
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_j") + 1)
    return per.groupBy("_j").agg(F.avg(drop).alias("score")).select(name.alias("feature"), "score")


def _auroc_drops(base: DataFrame, mixed: DataFrame, cols: list[str], weights: list[float], n_repeats: int) -> DataFrame:
    """(feature, score): AUROC of ``base`` less the mean AUROC over the repeats of ``mixed``."""
    d, coef = len(cols), np.array(weights)

    def scores(batch):
        number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
        wide = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
        y, r = number("_y"), batch.column("_r").to_numpy(zero_copy_only=False)
        shuffled = number("_m")[:, None] + coef * (wide("_d") - wide("_x"))
        for k in np.unique(r):
            at = (r == k) & ~np.isnan(y)
            for j in range(d):
                yield j * n_repeats + int(k), y[at] > 0.5, shuffled[at, j]

    # every repeat shuffles the same rows: the first shows where the scores of all lie
    narrow = mixed.select("_r", "_y", "_m", "_d", "_x")
    found = auroc_of_series(narrow, scores, narrow.filter("_r = 0"), lambda g: g - g % n_repeats)
    full = auroc(base, "_y", "_m").first()["auroc"]
    rows = []
    for j, c in enumerate(cols):
        have = [found[g] for g in range(j * n_repeats, (j + 1) * n_repeats) if g in found]
        drops = [full - v for v in have if v is not None and full is not None]
        if have:
            rows.append((c, float(np.mean(drops)) if drops else None))
    return base.sparkSession.createDataFrame(rows, "feature string, score double")


# --- Shapley values -----------------------------------------------------------------


def linear_shap(df: DataFrame, cols: list[str], weights, background_mean, keep: list[str] = ()) -> DataFrame:
    """Exact Shapley values of a linear margin: ``w_j (x_j - mean_j)`` per row and feature."""
    values = [
        ((F.col(f"`{c}`") - F.lit(float(m))) * F.lit(float(w))).alias(c)
        for c, w, m in zip(cols, weights, background_mean, strict=True)
    ]
    return df.select(*[F.col(k) for k in keep], *values)


def sampled_shap(
    df: DataFrame, row_id: str, cols: list[str], predict: Callable[[DataFrame], DataFrame], background: list,
    n_orders: int = 8, seed: int = 1,
) -> DataFrame:
    """(row_id, feature, value): Shapley values of any model by sampled feature orders.

    For every row and sampled order the features switch from a background row to
    the row's own values one by one; the value of a feature is the mean change of
    the prediction at its switch.  ``predict`` maps a DataFrame with an array
    column ``x`` to one with a double column ``prediction``; ``background`` is a
    short list of vectors.  The work is ``rows x orders x (features + 1)``
    predictions in one distributed job.
    """
    d = len(cols)
    back = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in background])
    own = df.select(F.col(row_id).alias("_id"), features_array(cols).alias("_x"))
    orders = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n_orders - 1))))
    pick = (F.pmod(stable_hash(f"bg{seed}", "_id", "_o"), F.lit(len(background))) + 1).cast("int")
    keyed = F.array_sort(F.array(*[
        F.struct(stable_hash(f"ord{seed}-{j}", "_id", "_o").alias("h"), F.lit(j).alias("j")) for j in range(d)
    ]))
    orders = orders.select("_id", "_o", "_x", F.element_at(back, pick).alias("_b"), F.transform(keyed, lambda s: s["j"]).alias("_ord"))
    place = F.array(*[(F.array_position("_ord", j) - 1).cast("int") for j in range(d)])
    steps = orders.withColumn("_place", place).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(d))))
    hybrid = F.transform(
        F.arrays_zip(F.col("_x"), F.col("_b"), F.col("_place")),
        lambda z: F.when(z["_place"] < F.col("_s"), z["_x"]).otherwise(z["_b"]),
    )
    scored = predict(steps.select("_id", "_o", "_s", "_ord", hybrid.alias("x")))
    # d + 1 rows per (row, order); the key is unique per row, so no group is large
    w = Window.partitionBy("_id", "_o").orderBy("_s")
    change = scored.withColumn("_v", F.col("prediction") - F.lag("prediction").over(w)).filter(F.col("_s") > 0)
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.element_at("_ord", F.col("_s")) + 1)
    return change.groupBy(F.col("_id").alias(row_id), name.alias("feature")).agg(F.avg("_v").alias("value"))


# --- k-means background ---------------------------------------------------------------


def _lloyd(df: DataFrame, cols: list[str], starts: list[np.ndarray], max_iter: int, tol: float = 1e-4) -> list[tuple[float, np.ndarray]]:
    """(cost, centres) of Lloyd's iterations from every start; a pass over the rows serves all that still move.

    The cost is that of the last assignment, to the centres before their last move, which is at
    most ``tol`` unless ``max_iter`` ends the search.  A centre without rows stays.
    """
    centres, cost = [c.copy() for c in starts], [0.0] * len(starts)
    moving = list(range(len(starts)))
    for _ in range(max_iter):
        if not moving:
            break
        ends = np.cumsum([0, *[len(centres[i]) for i in moving]])
        spans = list(zip(moving, ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        every = np.concatenate([centres[i] for i in moving])

        def kernel(x, _y, _w, _f, spans=spans, every=every):
            gaps = (every * every).sum(1) - 2 * (x @ every.T)
            own, at = (x * x).sum(1), np.arange(len(x))
            near = np.zeros(gaps.shape)
            costs = []
            for _, lo, hi in spans:
                best = gaps[:, lo:hi].argmin(1)
                near[at, lo + best] = 1.0
                costs.append(np.maximum(own + gaps[at, lo + best], 0.0).sum())
            sums, counts = near.T @ x, near.sum(0)
            for (i, lo, hi), c in zip(spans, costs, strict=True):
                yield i, np.concatenate([[c], counts[lo:hi], sums[lo:hi].ravel()])

        found = sum_blocks(df, cols, None, kernel)
        for i in list(moving):
            if i not in found:  # no rows
                moving.remove(i)
                continue
            k, v = len(centres[i]), found[i]
            counts, sums = v[1 : k + 1], v[k + 1 :].reshape(k, -1)
            some = counts > 0
            new = centres[i].copy()
            new[some] = sums[some] / counts[some, None]
            if np.all(((new - centres[i]) ** 2).sum(1) <= tol * tol):
                moving.remove(i)
            centres[i], cost[i] = new, float(v[0])
    return list(zip(cost, centres, strict=True))


def kmeans_sweep(df: DataFrame, cols: list[str], ks=range(5, 26), seed: int = 42, max_iter: int = 300):
    """(k, inertia) for every k and the centroids at the knee of the curve.

    Spark ML places the first centres of each k; the iterations of all k share their passes.
    """
    from sieveline.operators.report import knee

    vec = df.select(array_to_vector(features_array(cols)).alias("features")).persist()
    wide = spread(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])).persist()

    def start(k: int) -> np.ndarray:
        return np.array(KMeans(k=k, seed=seed, maxIter=0, initMode="k-means||").fit(vec).clusterCenters())

    sizes = [int(k) for k in ks]
    try:
        with ThreadPool(4) as pool:  # a few Spark jobs in flight over the shared table
            starts = pool.map(start, sizes)
        vec.unpersist()
        fits = _lloyd(wide, cols, starts, max_iter)
    finally:
        vec.unpersist()
        wide.unpersist()
    curve, centres = [(k, c) for k, (c, _) in zip(sizes, fits, strict=True)], {k: m for k, (_, m) in zip(sizes, fits, strict=True)}
    table = df.sparkSession.createDataFrame(curve, "k int, inertia double")
    best = knee(table, "k", "inertia").first()["knee"]
    return table, int(best), centres[int(best)]


# --- agreement ---------------------------------------------------------------------------

#: Which importance measures need which task.
TASK_ONLY = {"spearman": "regression", "fisher": "classification"}


def allowed(importance: DataFrame, tasks: DataFrame) -> DataFrame:
    """Drop measures that do not apply to the task of their datapred."""
    joined = importance.join(broadcast_if_small(tasks), "datapred")
    cond = F.lit(True)
    for method, task in TASK_ONLY.items():
        cond = cond & ((F.col("fi_method") != method) | (F.col("task") == task))
    return joined.filter(cond).drop("task")


def agreement(scores: DataFrame, importance: DataFrame) -> DataFrame:
    """(llm_model, fi_method, kendall_tau) from concept scores and an importance table.

    ``importance`` has (fi_method, seed, feature, score).  It is computed once and
    joined with every model; taus are averaged over seeds, undefined ones skipped.
    """
    methods = [tuple(r) for r in small_rows(importance.select("fi_method", "seed").distinct(), 10_000)]
    out = None
    for method, seed in methods:
        feats = importance.filter((F.col("fi_method") == method) & (F.col("seed") == seed)).select("feature", "score")
        part = expand_to_features(scores, feats, ["llm_model"]).withColumn("fi_method", F.lit(method)).withColumn("seed", F.lit(seed))
        out = part if out is None else out.unionByName(part)
    tau = kendall_tau(out, "concept_score", "feature_score", ["llm_model", "fi_method", "seed"])
    return tau.groupBy("llm_model", "fi_method").agg(F.avg("tau").alias("kendall_tau"))
