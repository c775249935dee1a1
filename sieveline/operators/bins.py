"""Raw events → per-entity time bins with value, mask and time since last value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.scalars import zero_if_missing


def last_per_bin(
    df: DataFrame, entity: str, concept: str, value: str, ts: str, order: str, t0: str, bin_hours: float
) -> DataFrame:
    """(entity, concept, bin, value): the last value of each bin, map-side reduced."""
    seconds = F.unix_timestamp(F.col(ts)) - F.unix_timestamp(F.lit(t0).cast("timestamp"))
    b = F.floor(seconds / F.lit(bin_hours * 3600.0)).cast("int")
    return df.groupBy(
        F.col(entity).alias("entity"), F.col(concept).alias("concept"), b.alias("bin")
    ).agg(F.max_by(value, order).alias("value"))


def dense_bins(binned: DataFrame, concepts: list[str], n_bins: int, bin_hours: float) -> DataFrame:
    """Every (entity, concept, bin) with value, mask and delta.

    ``mask`` is 1 where a value was observed.  ``delta`` is the time since the
    previous observed bin, counted from the first bin when there is none (the
    GRU-D definition).  One shuffle by entity: an entity's observed bins travel as
    one map of at most ``concepts x n_bins`` entries, and the grid is unfolded
    from it.
    """
    seen = binned.filter((F.col("bin") >= 0) & (F.col("bin") < n_bins) & F.col("concept").isin(concepts))
    per_entity = seen.groupBy("entity").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat_ws("#", F.col("bin").cast("string"), "concept"), F.col("value")))
        ).alias("_obs")
    )
    grid = F.explode(F.array(*[F.lit(c) for c in concepts])).alias("concept")
    cells = per_entity.select("entity", "_obs", grid).select(
        "entity", "concept", "_obs", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin")
    )
    key = F.concat_ws("#", F.col("bin").cast("string"), "concept")
    cells = cells.select("entity", "concept", "bin", F.try_element_at("_obs", key).alias("value"))
    # n_bins rows per window; the rows are already clustered by entity
    w = Window.partitionBy("entity", "concept").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.coalesce(F.max(F.when(F.col("value").isNotNull(), F.col("bin"))).over(w), F.lit(0))
    return cells.select(
        "entity", "concept", "bin", "value",
        F.col("value").isNotNull().cast("double").alias("mask"),
        ((F.col("bin") - previous) * F.lit(float(bin_hours))).alias("delta"),
    )


def flatten_bins(dense: DataFrame, concepts: list[str], n_bins: int, bin_hours: int, measures=("value", "mask", "delta")):
    """One row per entity, one column per (measure, concept, bin).

    Columns are ``concept_0hr``, ``concept_mask_0hr``, ``concept_delta_0hr``, ...;
    the names come from the pivot key, so they always line up with the values.
    """
    keys = [f"{c}@{b}" for c in concepts for b in range(n_bins)]
    wide = (
        dense.withColumn("_k", F.concat_ws("@", "concept", F.col("bin").cast("string")))
        .groupBy("entity")
        .pivot("_k", keys)
        .agg(*[F.max(zero_if_missing(m)).alias(m) for m in measures])
    )
    named = []
    for m in measures:
        for c in concepts:
            for b in range(n_bins):
                old = f"{c}@{b}" if len(measures) == 1 else f"{c}@{b}_{m}"
                suffix = "" if m == "value" else f"_{m}"
                named.append(F.col(f"`{old}`").alias(f"{c}{suffix}_{b * bin_hours}hr"))
    return wide.select("entity", *named)


def sequences(dense: DataFrame) -> DataFrame:
    """(entity, concept, steps): the bins in order as an array of structs."""
    step = F.struct("bin", "value", "mask", "delta")
    return dense.groupBy("entity", "concept").agg(F.sort_array(F.collect_list(step)).alias("steps"))


def join_static(series: DataFrame, static: DataFrame, how: str = "full") -> DataFrame:
    """Static features repeated on every bin of their entity.

    ``full`` keeps entities that have only static features or only a series.
    """
    return series.join(static, "entity", how)


def select_concepts_long(long: DataFrame, concepts: DataFrame | list[str]) -> DataFrame:
    """Rows of the selected concepts; a concept list table is semi-joined."""
    if isinstance(concepts, list):
        return long.filter(F.col("concept").isin(concepts))
    return long.join(concepts.select("concept").distinct(), "concept", "left_semi")


def hour_suffix(feature: Column, bin_index: Column, bin_hours: int) -> Column:
    return F.concat(feature, F.lit("_"), (bin_index * bin_hours).cast("string"), F.lit("hr"))
