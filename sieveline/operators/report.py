"""Experiment grid and report queries over result tables (bounded by the grid, not the data)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.scalars import nan_to_null
from sieveline.operators.ordering import quantiles
from sieveline.runtime import broadcast_if_small


def experiment_grid(spark, models, methods, ratios, seeds) -> DataFrame:
    """(model, fs_method, ratio, seed); the method ``all`` only at ratio 1."""
    rows = [
        (m, f, float(r), int(s))
        for m, f in itertools.product(models, methods)
        for r in ([1.0] if f == "all" else ratios)
        for s in seeds
    ]
    return spark.createDataFrame(rows, "model string, fs_method string, ratio double, seed int")


def missing_keys(grid: DataFrame, done: DataFrame, keys: list[str], recompute: Column | None = None) -> DataFrame:
    """Grid cells without a result, plus those named in ``recompute``."""
    kept = done if recompute is None else done.filter(~recompute)
    return grid.join(kept.select(*keys).distinct(), keys, "left_anti")


def path_table(results: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Mean and population deviation of a metric over seeds; NaN is skipped."""
    v = nan_to_null(metric)
    return results.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def path_area(paths: DataFrame, by: list[str], frac: str = "frac", metric: str = "metric", task: str | Column = "classification") -> DataFrame:
    """Area under each selection path by the trapezoid rule.

    A point at fraction 0 is added: 0.5 for classification, the first metric for
    regression.
    """
    w = Window.partitionBy(*by).orderBy(frac)  # one row per ratio of a path
    is_class = (F.lit(task) if isinstance(task, str) else task) == "classification"
    first = F.when(is_class, F.lit(0.5)).otherwise(F.col(metric))
    steps = paths.withColumn("_f0", F.coalesce(F.lag(frac).over(w), F.lit(0.0))).withColumn(
        "_m0", F.coalesce(F.lag(metric).over(w), first)
    )
    piece = (F.col(frac) - F.col("_f0")) * (F.col(metric) + F.col("_m0")) / F.lit(2.0)
    return steps.groupBy(*by).agg(F.sum(piece).alias("area"))


def pct_change(areas: DataFrame, by: list[str], method: str, baseline: str, higher_is_better: bool = True) -> DataFrame:
    """Percent improvement of every method's area over the baseline method's."""
    base = areas.filter(F.col(method) == baseline).select(*by, F.col("area").alias("_base"))
    diff = F.col("area") - F.col("_base") if higher_is_better else F.col("_base") - F.col("area")
    joined = areas.join(base, by) if by else areas.withColumn("_k", F.lit(0)).join(
        base.withColumn("_k", F.lit(0)), "_k").drop("_k")
    return joined.select(*by, method, (diff / F.col("_base") * 100).alias("pct_change"))


def pivot_areas(areas: DataFrame, row: str, column: str, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per ``row`` value and one column per listed ``column`` value, rows in a fixed order."""
    wide = areas.groupBy(row).pivot(column, columns).agg(F.first("area"))
    if order:
        place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(row))
        wide = wide.filter(place > 0).orderBy(place)
    return wide


def box_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, sd, q1, median, q3, low, high): whiskers end at the last value inside 1.5 IQR."""
    q = quantiles(df.select(*by, value), by, value, [0.25, 0.5, 0.75])
    base = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    fences = q.withColumn("_iqr", F.col("q2") - F.col("q0"))
    inside = df.join(broadcast_if_small(fences), by).filter(
        (F.col(value) >= F.col("q0") - 1.5 * F.col("_iqr")) & (F.col(value) <= F.col("q2") + 1.5 * F.col("_iqr"))
    )
    ends = inside.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return base.join(q, by).join(ends, by).select(
        *by, "n", "mean", "sd", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"), "low", "high"
    )


def value_at_ratio(paths: DataFrame, ratios: list[float], by: list[str], frac: str = "frac", cols=("metric",)) -> DataFrame:
    """Last path point with ``frac <= ratio`` for every requested ratio (as-of)."""
    asked = F.explode(F.array(*[F.lit(float(r)) for r in ratios]))
    hits = paths.withColumn("ratio", asked).filter(F.col(frac) <= F.col("ratio"))
    best = F.max_by(F.struct(frac, *cols), F.col(frac))
    return hits.groupBy(*by, "ratio").agg(best.alias("_b")).select(*by, "ratio", "_b.*")


def bands(paths: DataFrame) -> DataFrame:
    """Path curves with their mean ± std band."""
    return paths.withColumn("lower", F.col("mean") - F.col("std")).withColumn("upper", F.col("mean") + F.col("std"))


def flag_chosen(path: DataFrame, target: int, by: list[str], size: str = "n_selected", step: str = "step") -> DataFrame:
    """Regularisation path with the point nearest to the target size flagged (first on ties)."""
    order = F.struct(F.abs(F.col(size) - F.lit(target)), F.col(step))
    best = path.filter(F.col(size) > 0).groupBy(*by).agg(F.min_by(step, order).alias("_chosen"))
    joined = path.join(best, by, "left") if by else path.withColumn("_k", F.lit(0)).join(
        best.withColumn("_k", F.lit(0)), "_k", "left").drop("_k")
    return joined.withColumn("chosen", F.coalesce(F.col(step) == F.col("_chosen"), F.lit(False))).drop("_chosen")


def cohort_summary(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(variable, category, n, missing, mean, sd, share): numeric moments and category counts."""
    out = None
    total = df.agg(F.count(F.lit(1)).alias("t")).first()["t"]
    aggs = []
    for i, c in enumerate(numeric):
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}")]
    if aggs:
        rows = F.array(*[
            F.struct(F.lit(c).alias("variable"), F.lit(None).cast("string").alias("category"), F.col(f"n{i}").alias("n"),
                     (F.lit(total) - F.col(f"n{i}")).alias("missing"), F.col(f"m{i}").alias("mean"),
                     F.col(f"s{i}").alias("sd"), F.lit(None).cast("double").alias("share"))
            for i, c in enumerate(numeric)
        ])
        out = df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
    if categorical:
        sets = [[F.col(c)] for c in categorical]
        counts = df.select(*categorical).groupingSets(sets, *categorical).agg(
            F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g")
        )
        width = len(categorical)
        name, cat = F.lit(None).cast("string"), F.lit(None).cast("string")
        for i, c in enumerate(categorical):
            g = (1 << width) - 1 - (1 << (width - 1 - i))
            name = F.when(F.col("_g") == g, F.lit(c)).otherwise(name)
            cat = F.when(F.col("_g") == g, F.col(c).cast("string")).otherwise(cat)
        missing = F.when(cat.isNull(), F.col("n")).otherwise(F.lit(0)).cast("bigint")
        part = counts.select(
            name.alias("variable"), cat.alias("category"), "n", missing.alias("missing"),
            F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("sd"),
            (F.col("n") / F.lit(float(total))).alias("share"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def knee(points: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Elbow of a decreasing convex curve: largest distance to the chord after min-max scaling."""
    keys = list(by)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # one row per k
    sx = (F.col(x) - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w))
    sy = (F.col(y) - F.min(y).over(w)) / (F.max(y).over(w) - F.min(y).over(w))
    gap = points.withColumn("_gap", F.lit(1.0) - sy - sx)
    return gap.groupBy(*keys).agg(F.max_by(x, F.struct("_gap", (-F.col(x)).alias("o"))).alias("knee"))


# --- trials -----------------------------------------------------------------------


def best_row(trials: DataFrame, by: list[str], metric: str, mode: str, tie: list[str]) -> DataFrame:
    """The row with the best metric per group, first by ``tie``; follows the mode (max or min)."""
    sign = F.col(metric) if mode == "min" else -F.col(metric)
    cols = [c for c in trials.columns if c not in by]
    best = trials.filter(F.col(metric).isNotNull()).groupBy(*by).agg(
        F.min_by(F.struct(*cols), F.struct(sign.alias("m"), *tie)).alias("_b")
    )
    return best.select(*by, "_b.*")


def early_stop(log: DataFrame, by: list[str], step: str, metric: str, mode: str = "max", patience: int = 10) -> DataFrame:
    """Per run, the best step before ``patience`` steps without improvement: (by, best_step, best_value)."""
    w = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    value = F.col(metric) if mode == "max" else -F.col(metric)
    run = log.withColumn("_v", value).withColumn("_best", F.max("_v").over(w))
    before = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    improved = F.coalesce(F.col("_v") > F.max("_v").over(before), F.lit(True))
    run = run.withColumn("_last", F.max(F.when(improved, F.col(step))).over(w))
    stopped = F.max((F.col(step) - F.col("_last") >= patience).cast("int")).over(before)
    alive = run.withColumn("_stop", F.coalesce(stopped, F.lit(0))).filter(F.col("_stop") == 0)
    return alive.groupBy(*by).agg(
        F.max("_last").alias("best_step"), F.max_by(metric, F.struct("_v", -F.col(step))).alias("best_value")
    )


def halving(trials: DataFrame, trial: str, epoch: str, metric: str, mode: str = "max", grace: int = 1, factor: int = 2, max_t: int = 15) -> DataFrame:
    """Survivors of successive halving: (rung, trial, metric) of trials still running after each rung.

    At rung epochs ``grace * factor^i`` the better ``1/factor`` of the trials that
    reached the rung go on.
    """
    rung, alive, out, i = grace, trials.select(trial).distinct(), None, 0
    while rung <= max_t:
        at = trials.filter(F.col(epoch) == rung).join(alive, trial, "left_semi")
        w = Window.partitionBy(F.lit(0))  # one row per trial
        order = F.desc(metric) if mode == "max" else F.asc(metric)
        kept = at.withColumn("_r", F.row_number().over(w.orderBy(order, trial))).withColumn(
            "_n", F.count(F.lit(1)).over(w)
        ).filter(F.col("_r") <= F.greatest(F.floor(F.col("_n") / factor), F.lit(1)))
        part = kept.select(F.lit(rung).alias("rung"), trial, metric)
        out = part if out is None else out.unionByName(part)
        alive = kept.select(trial)
        i, rung = i + 1, rung * factor
    return out
