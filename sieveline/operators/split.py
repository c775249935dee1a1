"""Splits, folds and samples: deterministic, engine-independent, exact in size.

Rows are ordered by a seeded md5 of their id; a split is a cut of that order.
See ``ordering.exact_cuts``: with few strata no data row is shuffled to assign it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.scalars import stable_hash
from sieveline.operators.ordering import exact_cuts, with_cut_index
from sieveline.runtime import spread

TEST_SEED = 42  # fixed value: the test set is the same for every run seed


def _first_share(share: float):
    # rounded first, so that a product like 3.0000000000000004 counts as 3
    return lambda n: F.array(F.ceil(F.round(n * F.lit(float(share)), 9)).cast("long"))


def split(
    df: DataFrame,
    row_id: str,
    label: str | None = None,
    test_share: float = 0.2,
    val_share: float | None = 0.2,
    seed: int = 1,
) -> DataFrame:
    """Add ``split`` in {train, val, test}; stratified when ``label`` is given.

    The first ``ceil(share*n)`` rows of each stratum in hash order form a part.
    The test part uses the fixed seed, the train/val part the run seed.
    """
    by = [label] if label else []
    keys = {"_ht": stable_hash(TEST_SEED, row_id), "_hv": stable_hash(f"val{seed}", row_id)}
    # only ids, labels and hashes are kept, for the few passes that find the cuts
    ids = spread(df.select(*by, row_id)).withColumns(keys).persist()
    test_cuts = exact_cuts(ids, by, F.col("_ht"), row_id, _first_share(test_share))
    val_cuts = None
    if val_share is not None:
        rest = with_cut_index(ids, by, test_cuts, "_ht", row_id, "_rest").filter(F.col("_rest") > 0)
        val_cuts = exact_cuts(rest, by, F.col("_hv"), row_id, _first_share(val_share))
    ids.unpersist()

    marked = with_cut_index(df.withColumns(keys), by, test_cuts, "_ht", row_id, "_rest")
    if val_cuts is None:
        name = F.when(F.col("_rest") == 0, "test").otherwise("train")
        return marked.withColumn("split", name).drop("_ht", "_hv", "_rest")
    marked = with_cut_index(marked, by, val_cuts, "_hv", row_id, "_train")
    name = F.when(F.col("_rest") == 0, "test").when(F.col("_train") == 0, "val").otherwise("train")
    return marked.withColumn("split", name).drop("_ht", "_hv", "_rest", "_train")


def take_split(df: DataFrame, part: str) -> DataFrame:
    """Rows of one part; ``all`` keeps every row."""
    return df if part == "all" else df.filter(F.col("split") == part)


def _fold_starts(k: int):
    # k blocks whose sizes differ by at most one, larger blocks first
    def starts(n):
        least = F.floor(n / F.lit(k)).cast("long")
        return F.array(*[F.lit(i) * least + F.least(F.lit(i), n % k) for i in range(1, k)]).cast("array<long>")

    return starts


def folds(df: DataFrame, row_id: str, k: int = 5, label: str | None = None, seed: int = 1) -> DataFrame:
    """Add ``fold`` 0..k-1: shuffled, stratified when ``label`` is given."""
    by = [label] if label else []
    h = stable_hash(f"fold{seed}", row_id)
    ids = spread(df.select(*by, row_id)).withColumn("_h", h).persist()
    cuts = exact_cuts(ids, by, F.col("_h"), row_id, _fold_starts(k))
    ids.unpersist()
    return with_cut_index(df.withColumn("_h", h), by, cuts, "_h", row_id, "fold").drop("_h")


def block_folds(df: DataFrame, row_id: str, k: int = 5) -> DataFrame:
    """Add ``fold`` 0..k-1: contiguous, unshuffled blocks in the order of an integer id."""
    lo, hi = df.agg(F.min(row_id), F.max(row_id)).first()
    if lo is None:
        return df.withColumn("fold", F.lit(0))
    keyed = df.withColumn("_h", F.col(row_id).cast("bigint") - F.lit(int(lo)))
    bits = max(int(hi - lo).bit_length(), 1)
    cuts = exact_cuts(keyed, [], F.col("_h"), row_id, _fold_starts(k), bits)
    return with_cut_index(keyed, [], cuts, "_h", row_id, "fold").drop("_h")


def _keep_quota(df: DataFrame, row_id: str, label: str, seed, quota) -> DataFrame:
    """The first ``quota(n)`` rows of each class of ``n`` rows, in hash order."""
    keyed = df.withColumn("_h", stable_hash(seed, row_id))
    cuts = exact_cuts(keyed, [label], F.col("_h"), row_id, lambda n: F.array(quota(n).cast("long")))
    marked = with_cut_index(keyed, [label], cuts, "_h", row_id, "_cut")
    return marked.filter(F.col("_cut") == 0).drop("_h", "_cut")


def balance(df: DataFrame, row_id: str, label: str, seed: int = TEST_SEED) -> DataFrame:
    """Keep all positives (label 1) and equally many negatives, chosen by hash."""
    n_pos = df.filter(F.col(label) == 1).count()
    return _keep_quota(df, row_id, label, f"bal{seed}", lambda n: F.least(n, F.lit(n_pos)))


def stratified_cap(df: DataFrame, row_id: str, label: str, cap: int = 50_000, seed: int = 1) -> DataFrame:
    """At most ``cap`` rows with the class shares kept; all rows when there are fewer."""
    total = df.count()
    if total <= cap:
        return df
    def share(n):
        return (n * F.lit(cap) - (n * F.lit(cap)) % F.lit(total)) / F.lit(total)

    return _keep_quota(df, row_id, label, f"cap{seed}", share)


def sample_names(names: DataFrame, name: str, ratio: float, seed: int = 1) -> DataFrame:
    """A random ``floor(ratio*n)`` of the names, without replacement."""
    n = names.count()
    return names.orderBy(stable_hash(seed, name), name).limit(math.floor(ratio * n))


def random_scores(names: DataFrame, name: str, seed: int = 1) -> DataFrame:
    """A null importance: one uniform draw per name."""
    from sieveline.functions.scalars import stable_uniform

    return names.select(name, stable_uniform(seed, name).alias("score"))
