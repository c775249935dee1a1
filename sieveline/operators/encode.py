"""Feature encoders as Estimator → Model pairs; transforms are pure projections.

Fitting reduces the training rows to column-sized statistics (means, scales,
category lists); transforming adds literal expressions, so Catalyst still prunes
the scan to the columns in use.
"""

from __future__ import annotations

import math

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.scalars import zero_if_missing, zscore
from sieveline.operators.stats import moments, to_long
from sieveline.runtime import broadcast_if_small, small_rows

_MAX_CATEGORIES = 20_000


def _q(c: str):
    return F.col(f"`{c}`")


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a zero deviation becomes 1."""
    if not cols:
        return {}
    out = {}
    for r in small_rows(moments(df, cols)):
        sd = r["sd"]
        out[r["feature"]] = (r["mean"] or 0.0, sd if sd and not math.isnan(sd) else 1.0)
    return out


def fit_categories(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Sorted distinct categories per column, from one pass with map-side reduction."""
    if not cols:
        return {}
    distinct = to_long(df, cols, [], cast="string").filter(F.col("value").isNotNull()).distinct()
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in small_rows(distinct, _MAX_CATEGORIES):
        out[r["feature"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot_columns(col: str, categories: list[str]) -> list:
    """One 0/1 double per category; an unknown or missing value is all zeros."""
    value = _q(col).cast("string")
    return [
        F.coalesce((value == F.lit(c)).cast("double"), F.lit(0.0)).alias(f"{col}_{c}") for c in categories
    ]


class MixedEncoder(Estimator):
    """z-score the numeric columns, one-hot the categorical ones.

    Numeric columns come first unless ``one_hot_first``.  ``scale`` lists the
    numeric columns to standardize (default: all of them); the others pass through.
    """

    def __init__(self, numeric, categorical, one_hot_first=False, scale=None, vector=None):
        super().__init__()
        self.numeric, self.categorical = list(numeric), list(categorical)
        self.one_hot_first, self.vector = one_hot_first, vector
        self.scale = list(numeric if scale is None else scale)

    def _fit(self, dataset: DataFrame) -> MixedEncoderModel:
        return MixedEncoderModel(
            self.numeric, fit_scaler(dataset, self.scale), fit_categories(dataset, self.categorical),
            self.one_hot_first, self.vector,
        )


class MixedEncoderModel(Model):
    def __init__(self, numeric, scaler, categories, one_hot_first=False, vector=None):
        super().__init__()
        self.numeric, self.scaler, self.categories = numeric, scaler, categories
        self.one_hot_first, self.vector = one_hot_first, vector

    @property
    def feature_names(self) -> list[str]:
        hot = [f"{c}_{v}" for c, vs in self.categories.items() for v in vs]
        return hot + self.numeric if self.one_hot_first else self.numeric + hot

    def columns(self) -> list:
        num = [
            (zscore(_q(c), *self.scaler[c]) if c in self.scaler else _q(c).cast("double")).alias(c)
            for c in self.numeric
        ]
        hot = [e for c, vs in self.categories.items() for e in one_hot_columns(c, vs)]
        return hot + num if self.one_hot_first else num + hot

    def _transform(self, dataset: DataFrame) -> DataFrame:
        used = set(self.numeric) | set(self.categories)
        keep = [_q(c) for c in dataset.columns if c not in used]
        out = dataset.select(*keep, *self.columns())
        if self.vector:
            names = self.feature_names
            out = out.withColumn(self.vector, array_to_vector(F.array(*[_q(c) for c in names])))
        return out


class ColumnFilter(Model):
    """Identity on a chosen set of columns, usable as a pipeline stage."""

    def __init__(self, features, keep=()):
        super().__init__()
        self.features, self.keep = list(features), list(keep)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.select(*[_q(c) for c in self.keep], *[_q(c) for c in self.features])


def apply_mask(df: DataFrame, features: list[str], mask: list, keep: list[str] = ()) -> DataFrame:
    """Keep the features a mask names: booleans, positions or names."""
    if mask and all(isinstance(m, bool) for m in mask):
        names = [f for f, m in zip(features, mask, strict=True) if m]
    elif mask and all(isinstance(m, int) for m in mask):
        names = [features[i] for i in mask]
    else:
        names = list(mask)
    return df.select(*[_q(c) for c in keep], *[_q(c) for c in names])


def vocabulary_one_hot(df: DataFrame, col: str, vocabulary: list[str]) -> DataFrame:
    """One-hot against a fixed vocabulary (sorted), without fitting."""
    return df.select("*", *one_hot_columns(col, sorted(vocabulary)))


def vocabulary_ordinal(col: str, vocabulary: list[str]):
    """Index of a value in the sorted vocabulary; unknown → NULL."""
    pos = F.array_position(F.array(*[F.lit(v) for v in sorted(vocabulary)]), _q(col).cast("string"))
    return F.when(pos > 0, (pos - 1).cast("double"))


# --- long (entity, concept, bin) form --------------------------------------------


def pooled_scale(
    df: DataFrame, channel: str, value: str, out: str, fit_on: DataFrame | None = None, only: list[str] | None = None
) -> DataFrame:
    """Standardize ``value`` per channel, pooled over entities and bins; missing → 0.

    ``only`` lists the channels to standardize; the others keep their value.
    """
    fitted = moments(fit_on if fit_on is not None else df, [value], by=[channel])
    if only is not None:
        fitted = fitted.filter(F.col(channel).isin(list(only)))
    stats = broadcast_if_small(fitted.select(channel, F.col("mean").alias("_m"), F.col("sd").alias("_s")))
    scale = F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))
    z = F.when(F.col("_m").isNull(), F.col(value)).otherwise((F.col(value) - F.col("_m")) / scale)
    return df.join(stats, channel, "left").withColumn(out, zero_if_missing(z)).drop("_m", "_s")
