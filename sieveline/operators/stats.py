"""Feature statistics over wide labelled tables, each in one or few passes.

Every function returns a long ``(feature, ...)`` table.  Per-column loops never
become per-column jobs: moments, correlations and class moments are one ``agg``;
rank- and count-based scores use the long form with map-side reduction.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.scalars import digamma_int, nan_to_null
from sieveline.operators.ordering import cumulative, equal_depth_edges, mid_ranks
from sieveline.runtime import broadcast_if_small, cut_lineage, small_rows, spread

_AGG_COLUMNS = 150  # columns per aggregate, below the generated-method size limit


def _chunks(cols: list[str], size: int = _AGG_COLUMNS):
    return [cols[i : i + size] for i in range(0, len(cols), size)]


def _stack(df: DataFrame, keys: list[str], cols: list[str], measures: list[str]) -> DataFrame:
    """Turn ``<i>_<measure>`` columns of an aggregate into one row per feature."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{i}_{m}").alias(m) for m in measures])
        for i, c in enumerate(cols)
    ])
    return df.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")


def to_long(df: DataFrame, cols: list[str], keep: list[str], cast: str = "double") -> DataFrame:
    """One row per (row, feature): ``keep`` columns, ``feature``, ``value``."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast(cast).alias("value")) for c in cols
    ])
    narrow = df.select(*keep, *[F.col(f"`{c}`") for c in cols if c not in keep])
    return spread(narrow).select(*keep, F.explode(entries).alias("_e")).select(*keep, "_e.*")


def moments(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """(by, feature, n, mean, sd) with the population deviation; missing values skipped."""
    by = list(by)
    parts = []
    for chunk in _chunks(cols):
        aggs = []
        for i, c in enumerate(chunk):
            v = nan_to_null(F.col(f"`{c}`"))
            aggs += [F.count(v).alias(f"{i}_n"), F.avg(v).alias(f"{i}_mean"), F.stddev_pop(v).alias(f"{i}_sd")]
        parts.append(_stack(df.groupBy(*by).agg(*aggs), by, chunk, ["n", "mean", "sd"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pearson(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Absolute Pearson correlation of each feature with the label."""
    parts = []
    for chunk in _chunks(cols):
        y = nan_to_null(F.col(f"`{label}`"))
        aggs = [F.abs(F.corr(nan_to_null(F.col(f"`{c}`")), y)).alias(f"{i}_score") for i, c in enumerate(chunk)]
        parts.append(_stack(df.agg(*aggs), [], chunk, ["score"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spearman(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Absolute Spearman correlation (average ranks) of each feature with the label.

    The label ranks are attached once; every feature then needs only sums per
    distinct value, so no second rank join back to the rows is made.
    """
    base = df.withColumn("_y", nan_to_null(F.col(f"`{label}`"))).filter(F.col("_y").isNotNull())
    y_ranks = mid_ranks(base.select("_y"), [], "_y", settle=True).select(
        "_y", (F.col("mid_rank") - (F.col("total_n") + 1) / F.lit(2.0)).alias("_ry")
    )
    rows = base.join(broadcast_if_small(y_ranks, 10_000), "_y")  # beyond that a skew-safe shuffle join
    long = to_long(rows, cols, ["_ry"])
    cum = cumulative(
        long, ["feature"], "value",
        {"n": F.lit(1), "sy": F.col("_ry"), "syy": F.col("_ry") * F.col("_ry")}, series=len(cols), settle=True,
    )
    rx = F.col("before_n") + (F.col("n") + 1) / F.lit(2.0) - (F.col("total_n") + 1) / F.lit(2.0)
    sums = cum.groupBy("feature").agg(
        F.sum(rx * F.col("sy")).alias("sxy"),
        F.sum(rx * rx * F.col("n")).alias("sxx"),
        F.sum("syy").alias("syy"),
    )
    spread = F.sqrt(F.col("sxx") * F.col("syy"))
    return sums.select("feature", F.when(spread > 0, F.abs(F.col("sxy") / spread)).alias("score"))


def class_moments(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """(label, feature, n, mean, var): one aggregate, as many rows as classes; missing values skipped."""
    parts = []
    for chunk in _chunks(cols):
        aggs = []
        for i, c in enumerate(chunk):
            v = nan_to_null(F.col(f"`{c}`"))
            aggs += [F.count(v).alias(f"{i}_n"), F.avg(v).alias(f"{i}_mean"), F.var_pop(v).alias(f"{i}_var")]
        parts.append(_stack(df.groupBy(label).agg(*aggs), [label], chunk, ["n", "mean", "var"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _between_within(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    per_class = class_moments(df, cols, label).withColumnRenamed(label, "_class")
    n, mu, var = F.col("n"), F.col("mean"), F.col("var")
    # sum n*(mu - m)^2 is sum n*mu^2 - n*m^2, taken around a per-feature origin for accuracy
    w = Window.partitionBy("feature")  # one row per class
    centred = per_class.filter(n > 0).withColumn("_m", F.sum(n * mu).over(w) / F.sum(n).over(w))
    return centred.groupBy("feature").agg(
        F.sum(n * (mu - F.col("_m")) * (mu - F.col("_m"))).alias("between"),
        F.sum(n * var).alias("within"),
        F.sum(n).alias("n"),
        F.count(F.lit(1)).alias("k"),
    )


def fisher(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Between-class over within-class scatter per feature."""
    s = _between_within(df, cols, label)
    return s.select("feature", F.when(F.col("within") > 0, F.col("between") / F.col("within")).alias("score"))


def f_classif(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """One-way ANOVA F per feature."""
    s = _between_within(df, cols, label)
    dfb, dfw = F.col("k") - 1, F.col("n") - F.col("k")
    ratio = (F.col("between") / dfb) / (F.col("within") / dfw)
    return s.select("feature", F.when((F.col("within") > 0) & (dfb > 0), ratio).alias("score"))


def f_regression(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Regression F per feature: r^2 / (1 - r^2) * (n - 2)."""
    parts = []
    for chunk in _chunks(cols):
        aggs = []
        for i, c in enumerate(chunk):
            v, y = nan_to_null(F.col(f"`{c}`")), nan_to_null(F.col(f"`{label}`"))
            aggs += [F.corr(v, y).alias(f"{i}_r"), F.count(F.when(v.isNotNull(), y)).alias(f"{i}_n")]
        parts.append(_stack(df.agg(*aggs), [], chunk, ["r", "n"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    r2 = F.col("r") * F.col("r")
    return out.select("feature", F.when(r2 < 1, r2 / (F.lit(1.0) - r2) * (F.col("n") - 2)).alias("score"))


# --- mutual information -----------------------------------------------------


def mutual_info_counts(counts: DataFrame, by: str = "feature") -> DataFrame:
    """MI in nats from a contingency table (by, x, y, n), as H(x) + H(y) - H(x, y).

    The table is read once: cells and both margins are grouping sets of one aggregate.
    """
    b, x, y = F.col(by), F.col("x"), F.col("y")
    sets = counts.groupingSets([[b, x, y], [b, x], [b, y]], b, x, y)
    cells = sets.agg(F.sum("n").alias("n"), F.grouping_id().alias("_g"))
    of = lambda g, v: F.sum(F.when(F.col("_g") == g, v))  # noqa: E731  (0: cells, 1: margins of x, 2: of y)
    n_log_n = F.col("n") * F.log(F.col("n").cast("double"))
    sums = cells.groupBy(by).agg(
        of(0, n_log_n).alias("cxy"), of(1, n_log_n).alias("cx"), of(2, n_log_n).alias("cy"), of(0, F.col("n")).alias("total")
    )
    mi = F.log(F.col("total").cast("double")) + (F.col("cxy") - F.col("cx") - F.col("cy")) / F.col("total")
    return sums.select(by, F.greatest(mi, F.lit(0.0)).alias("score"))


def mutual_info_discrete(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """MI between each discrete feature and a discrete label."""
    long = to_long(df.withColumn("y", F.col(label).cast("string")), cols, ["y"], cast="string")
    counts = long.groupBy("feature", F.col("value").alias("x"), "y").agg(F.count(F.lit(1)).alias("n"))
    return mutual_info_counts(counts)


def feature_edges(df: DataFrame, cols: list[str], bins: int) -> dict[str, list[float]]:
    """Equal-depth bin edges per column (a fitted, column-sized statistic)."""
    rows = small_rows(equal_depth_edges(to_long(df, cols, []), ["feature"], "value", bins, series=len(cols)))
    return {r["feature"]: [e for e in r["edges"] if e is not None] for r in rows}


def _edge_bin(c: str, edges: list[float]) -> Column:
    """The bin of a value; NULL where it is missing."""
    v = nan_to_null(F.col(f"`{c}`"))
    at = F.lit(0)
    for e in edges:
        at = at + (v >= F.lit(float(e))).cast("int")
    return F.when(v.isNotNull(), at)


def mutual_info_binned(
    df: DataFrame, cols: list[str], label: str, bins: int = 10, label_bins: int | None = None
) -> DataFrame:
    """MI of continuous features with the label after equal-depth binning.

    ``label_bins`` bins a continuous label as well.  This plug-in estimator is
    not the nearest-neighbour estimator of ``mutual_info_knn``; it needs one pass
    for the edges and one for the counts, and shuffles only counts.
    """
    wanted = list(cols) + ([label] if label_bins and label not in cols else [])
    if label_bins and label_bins != bins:
        edges = feature_edges(df, list(cols), bins) | feature_edges(df, [label], label_bins)
    else:
        edges = feature_edges(df, wanted, bins)
    y = _edge_bin(label, edges[label]) if label_bins else F.col(label)
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), _edge_bin(c, edges.get(c, [])).alias("x")) for c in cols
    ])
    narrow = spread(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*cols, label])]))
    long = narrow.select(y.cast("string").alias("y"), F.explode(entries).alias("_e")).select("y", "_e.*")
    long = long.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    counts = long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    return mutual_info_counts(counts)


def mutual_info_knn(df: DataFrame, cols: list[str], label: str, k: int = 3, block: int = 4096) -> DataFrame:
    """MI of continuous features with a discrete label: nearest-neighbour estimator.

    psi(n) + mean(psi(k)) - mean(psi(n_class)) - mean(psi(m)), where the radius of
    a point is the distance to its k-th neighbour inside its class and m counts
    the points of all classes strictly inside that radius (the point included).

    Works on distinct (feature, class, value) points with their multiplicities.
    They are numbered in order, cut into blocks of ``block`` points that carry a
    halo of ``k`` points of the next blocks, and windows run per block, so no
    feature or class is ever sorted in one task.
    """
    long = to_long(df.withColumn("_y", F.col(label).cast("string")), cols, ["_y"])
    keys = ["feature", "_y"]
    points = long.filter(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    points = cut_lineage(points)  # read three times below
    series = points.select(*keys).distinct().count()  # features x classes
    order = cumulative(points, keys, "value", {"d": F.lit(1), "n": F.col("n")}, series=series, settle=True)
    order = order.select(*keys, "value", "n", F.col("before_d").alias("d"), F.col("total_n").alias("n_class"))

    at = F.col("d") % block
    homes = F.array_compact(F.array(
        F.floor(F.col("d") / block),
        F.when((at < k) & (F.col("d") >= block), F.floor(F.col("d") / block) - 1),
        F.when(at >= block - k, F.floor(F.col("d") / block) + 1),
    ))
    halo = order.withColumn("_block", F.explode(homes))
    w = Window.partitionBy(*keys, "_block").orderBy("d")
    gaps = [F.array_repeat(F.lit(0.0), F.least(F.col("n") - 1, F.lit(k)).cast("int"))]
    for i in range(1, k + 1):
        for step in (F.lag, F.lead):
            gap = F.abs(F.col("value") - step("value", i).over(w))
            copies = F.least(F.coalesce(step("n", i).over(w), F.lit(0)), F.lit(k)).cast("int")
            gaps.append(F.array_repeat(gap, copies))
    k_eff = F.least(F.lit(k), F.col("n_class") - 1).cast("int")
    radius = F.try_element_at(F.array_sort(F.concat(*gaps)), k_eff)
    with_radius = (
        halo.withColumn("r", radius)
        .filter(F.col("_block") == F.floor(F.col("d") / block))
        .filter(F.col("n_class") > 1)
        .withColumn("k_eff", k_eff)
    )

    ends = F.array(
        F.struct((F.col("value") - F.col("r")).alias("v"), F.lit(-1).alias("side")),
        F.struct((F.col("value") + F.col("r")).alias("v"), F.lit(1).alias("side")),
    )
    queries = with_radius.select(
        "feature", "_y", F.col("value").alias("x"), F.col("n").alias("copies"), "n_class", "k_eff", "r",
        F.explode(ends).alias("_e"),
    ).select("*", F.col("_e.v").alias("value"), F.col("_e.side").alias("side")).drop("_e")
    kept = points.join(broadcast_if_small(with_radius.select(*keys).distinct()), keys)
    marks = kept.select("feature", "value", "n").unionByName(
        queries.select("feature", "value", F.lit(0).alias("n"))
    )
    counts = cumulative(marks, ["feature"], "value", {"n": F.col("n")}, series=len(cols), settle=True).select(
        "feature", "value", F.col("n").alias("_at"), F.col("before_n").alias("_below")
    )
    # strictly inside (x - r, x + r): below the upper end minus up to the lower end;
    # a zero radius counts the copies of the point itself
    signed = F.when(F.col("side") > 0, F.col("_below")).otherwise(-(F.col("_below") + F.col("_at")))
    inside = (
        queries.join(counts, ["feature", "value"])
        .groupBy("feature", "_y", "x", "copies", "n_class", "k_eff", "r")
        .agg(F.sum(signed).alias("_m"), F.max("_at").alias("_same"))
        .withColumn("m", F.when(F.col("r") == 0, F.col("_same")).otherwise(F.col("_m")))
    )
    c = F.col("copies")
    sums = inside.groupBy("feature").agg(
        F.sum(c).alias("n"),
        (F.sum(c * digamma_int("k_eff")) / F.sum(c)).alias("psi_k"),
        (F.sum(c * digamma_int("n_class")) / F.sum(c)).alias("psi_c"),
        (F.sum(c * digamma_int("m")) / F.sum(c)).alias("psi_m"),
    )
    mi = digamma_int("n") + F.col("psi_k") - F.col("psi_c") - F.col("psi_m")
    return sums.select("feature", F.greatest(F.lit(0.0), mi).alias("score"))


# --- second moments ---------------------------------------------------------


def gram(df: DataFrame, cols: list[str], fold: str | None = None, weight: str | None = None) -> dict[int, np.ndarray]:
    """Gram matrices of ``[1, cols]``, one per fold, from a single pass over the complete rows.

    Each task reduces its rows to one matrix per fold with matrix products, and
    Spark sums the matrices; the driver receives folds x (D+1)^2 numbers.  Sums
    are taken around a per-column origin, which the caller never sees.
    """
    from sieveline.operators.linear import sum_blocks

    d = len(cols)
    origin = np.array([float(r or 0.0) for r in df.agg(*[
        F.percentile_approx(F.col(f"`{c}`").cast("double"), 0.5, 100) for c in cols]).first()])

    def kernel(x, _y, w, f):
        z = np.hstack([np.ones((len(x), 1)), x - origin])
        for g in np.unique(f):
            zz, ww = z[f == g], w[f == g]
            yield int(g), (zz * ww[:, None]).T @ zz

    sums = sum_blocks(df, cols, None, kernel, fold=fold, weight=weight)
    shift = np.eye(d + 1)
    shift[1:, 0] = origin
    return {g: shift @ m.reshape(d + 1, d + 1) @ shift.T for g, m in sums.items()}


def correlation_from_gram(g: np.ndarray) -> np.ndarray:
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = cov / np.outer(sd, sd)
    return np.where(np.isfinite(corr), corr, 0.0)


def pair_correlations(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Correlation matrix; each pair over the rows in which both values are present.

    One pass: counts, sums, squares and products of every pair around the column
    means.  A pair without variation (or without rows) has correlation 0.
    """
    from sieveline.operators.linear import sum_blocks

    value = lambda c: F.col(f"`{c}`").cast("double")
    present = lambda c: F.when(~F.isnan(value(c)), value(c))
    means = np.array([float(r or 0.0) for r in df.agg(*[F.avg(present(c)) for c in cols]).first()])

    def kernel(x, _y, w, f):
        there = np.isfinite(x)
        z, m = np.where(there, x - means, 0.0), there.astype(float)
        yield 0, np.stack([m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z])

    d = len(cols)
    sums = sum_blocks(df, cols, None, kernel, missing=True)
    if not sums:
        return np.zeros((d, d))
    n, sx, sxx, sxy = sums[0].reshape(4, d, d)
    cov = n * sxy - sx * sx.T
    var = np.clip(n * sxx - sx * sx, 0, None)
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = cov / np.sqrt(var * var.T)
    return np.where(np.isfinite(corr), corr, 0.0)


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlation of every feature pair as (feature_a, feature_b, corr), a < b by position.

    Missing values leave a row out of the pairs that they touch, not out of others.
    """
    d = len(cols)
    corr = pair_correlations(df, cols)
    rows = [(cols[i], cols[j], float(corr[i, j])) for i in range(d) for j in range(i + 1, d)]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, corr double")


__all__ = [
    "class_moments", "correlation_from_gram", "correlations", "f_classif", "f_regression", "feature_edges",
    "fisher", "gram", "moments", "mutual_info_binned", "mutual_info_counts", "mutual_info_discrete",
    "mutual_info_knn", "pair_correlations", "pearson", "spearman", "to_long",
]
