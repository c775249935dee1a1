"""Selection from score tables, ranked lists and statistics.

Score tables hold one row per (model, concept), so they are bounded by the number
of columns of a dataset, not by its rows; ordering them is a window per model.
Row-level statistics come from ``stats`` and arrive here already reduced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.scalars import nan_to_null, stable_hash
from sieveline.operators import stats
from sieveline.operators.ranks import fuzzy_match
from sieveline.runtime import local_table, small_rows


def check_size(threshold=None, ratio=None, topk=None) -> None:
    """Exactly one way to set the size; zero is a valid threshold."""
    given = [x for x in (threshold, ratio, topk) if x is not None]
    if len(given) != 1:
        raise ValueError("give exactly one of threshold, ratio, topk")
    if topk is not None and not isinstance(topk, int):
        raise ValueError("topk must be an int")


def ordered(scores: DataFrame, name: str, by: list[str] = (), seed: int = 1, score: str = "score") -> DataFrame:
    """Add 1-based ``pos`` by score descending; exact ties by a seeded hash, missing scores last."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return scores.withColumn(
        "pos", F.row_number().over(w.orderBy(_best_first(score), stable_hash(seed, name), name))
    )


def _best_first(score: str):
    """Descending; NULL and NaN are both missing and come last."""
    return nan_to_null(score).desc_nulls_last()


def by_threshold(scores: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return scores.filter(nan_to_null(score) >= threshold)


def by_topk(scores: DataFrame, name: str, k: int, by: list[str] = (), seed: int = 1) -> DataFrame:
    """The k best per group; Spark prunes each partition to k rows before the shuffle."""
    if not by:
        best = scores.orderBy(_best_first("score"), stable_hash(seed, name), name).limit(k)
        return ordered(best, name, (), seed)
    return ordered(scores, name, by, seed).filter(F.col("pos") <= k)


def by_ratio(scores: DataFrame, name: str, ratio: float, by: list[str] = (), seed: int = 1) -> DataFrame:
    """The best ``floor(ratio*n)`` per group."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sized = ordered(scores, name, by, seed).withColumn("_n", F.count(F.lit(1)).over(w))
    return sized.filter(F.col("pos") <= F.floor(F.lit(float(ratio)) * F.col("_n"))).drop("_n")


def select_by_score(scores, name="concept", threshold=None, ratio=None, topk=None, by=(), seed=1) -> DataFrame:
    check_size(threshold, ratio, topk)
    if threshold is not None:
        return by_threshold(scores, threshold)
    if ratio is not None:
        return by_ratio(scores, name, ratio, by, seed)
    return by_topk(scores, name, topk, by, seed)


def top_percentile(scores: DataFrame, name: str, percentile: int, order: str | None = None) -> DataFrame:
    """Scores above the (100-p) percentile; ties at it fill up in order to ``int(n*p/100)``."""
    w = Window.partitionBy(F.lit(0))
    sized = scores.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn(
        "_cut", F.percentile(F.col("score"), F.lit((100 - percentile) / 100.0)).over(w)
    )
    if percentile >= 100:
        return scores
    above = F.col("score") > F.col("_cut")
    tied = F.when(F.col("score") == F.col("_cut"), 1).otherwise(0)
    fill = F.sum(tied).over(w.orderBy(order or name).rowsBetween(Window.unboundedPreceding, 0))
    room = F.floor(F.col("_n") * F.lit(percentile) / 100) - F.sum(above.cast("int")).over(w)
    kept = sized.withColumn("_fill", fill).withColumn("_room", room)
    return kept.filter(above | ((F.col("score") == F.col("_cut")) & (F.col("_fill") <= F.col("_room")))).select(
        *scores.columns
    )


def dedupe_in_order(ranked: DataFrame, by: list[str], name: str = "concept", pos: str = "pos") -> DataFrame:
    """First occurrence of every name per list, renumbered from 0."""
    first = ranked.groupBy(*by, name).agg(F.min(pos).alias("_p"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return first.withColumn(pos, (F.row_number().over(w.orderBy("_p")) - 1).cast("int")).drop("_p")


def append_missing(ranked: DataFrame, by: list[str], concepts: DataFrame, seed: int = 1) -> DataFrame:
    """Concepts absent from a list follow it in a seeded random order."""
    groups = ranked.groupBy(*by).agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("_n"))
    names = [r["concept"] for r in small_rows(concepts.select("concept"))]
    wanted = groups.withColumn("concept", F.explode(F.array(*[F.lit(n) for n in names])))
    missing = wanted.join(ranked.select(*by, "concept"), [*by, "concept"], "left_anti")
    w = Window.partitionBy(*by).orderBy(stable_hash(seed, "concept"), "concept")
    tail = missing.select(*by, "concept", (F.col("_n") + F.row_number().over(w) - 1).cast("int").alias("pos"))
    return ranked.select(*by, "concept", "pos").unionByName(tail)


def prefix_by_ratio(ranked: DataFrame, ratio: float, by: list[str] = (), pos: str = "pos") -> DataFrame:
    """The first ``floor(ratio*n)`` of each order (0-based positions)."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    n = F.count(F.lit(1)).over(w)
    return ranked.withColumn("_n", n).filter(F.col(pos) < F.floor(F.lit(float(ratio)) * F.col("_n"))).drop("_n")


def prefixes(ranked: DataFrame, ratios: list[float], by: list[str] = (), pos: str = "pos") -> DataFrame:
    """All prefixes of one maximal order: adds ``ratio``, one copy of the head per ratio."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sized = ranked.withColumn("_n", F.count(F.lit(1)).over(w))
    cut = sized.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    return cut.filter(F.col(pos) < F.floor(F.col("ratio") * F.col("_n"))).drop("_n")


def select_ranked(
    lists: DataFrame, by: list[str], concepts: DataFrame, ratio: float | None = None, topk: int | None = None, seed=1
) -> DataFrame:
    """Ranked text lists → selected concepts: match, drop repeats, append missing, cut.

    ``lists`` has (by, pos, text).
    """
    matched = fuzzy_match(lists, "text", concepts)
    full = append_missing(dedupe_in_order(matched, by), by, concepts, seed)
    if topk is not None:
        return full.filter(F.col("pos") < topk)
    return prefix_by_ratio(full, ratio, by)


def nearest_size(path: DataFrame, target, by: list[str] = (), size: str = "n_selected", step: str = "step") -> DataFrame:
    """The non-empty path point whose size is nearest to the target, first on ties."""
    t = F.col(target) if isinstance(target, str) else F.lit(target)
    columns = [c for c in path.columns if c not in by]
    best = F.min_by(F.struct(*columns), F.struct(F.abs(F.col(size) - t), F.col(step)))
    out = path.filter(F.col(size) > 0).groupBy(*by).agg(best.alias("_b"))
    return out.select(*by, "_b.*")


def groups_contiguous(columns: DataFrame, pos: str = "pos", feature: str = "feature") -> DataFrame:
    """Group ids by runs of the same concept prefix in column order (a new run, a new id)."""
    w = Window.partitionBy(F.lit(0)).orderBy(pos)  # one row per feature
    prefix = F.split_part(F.col(feature), F.lit("_"), F.lit(1))
    tagged = columns.withColumn("_p", prefix)
    starts = F.when(F.col("_p") != F.lag("_p").over(w), 1).otherwise(0)
    return tagged.withColumn("_s", starts).withColumn("group_id", F.sum("_s").over(w).cast("int")).drop("_p", "_s")


def groups_by_prefix(columns: DataFrame, pos: str = "pos", feature: str = "feature") -> DataFrame:
    """(concept, positions): all columns of a concept, wherever they stand."""
    prefix = F.split_part(F.col(feature), F.lit("_"), F.lit(1))
    return columns.groupBy(prefix.alias("concept")).agg(F.sort_array(F.collect_list(pos)).alias("positions"))


def mrmr(df: DataFrame, cols: list[str], label: str, task: str, k: int | None = None) -> list[tuple[str, float]]:
    """Greedy relevance over redundancy: F statistic / mean absolute correlation with the selected.

    Two data passes in total (F statistics and pairwise correlations, both over the
    rows that have the values); the greedy loop works on column-sized arrays.
    Redundancy has a floor of 0.001.
    """
    score_fn = stats.f_classif if task == "classification" else stats.f_regression
    relevance = {r["feature"]: r["score"] for r in small_rows(score_fn(df, cols, label))}
    rel = np.nan_to_num([relevance.get(c) or 0.0 for c in cols])
    corr = np.abs(stats.pair_correlations(df, cols))
    left, chosen, out = list(range(len(cols))), [], []
    for _ in range(k or len(cols)):
        if chosen:
            redundancy = np.clip(corr[np.ix_(left, chosen)], 0.001, None).mean(axis=1)
        else:
            redundancy = np.ones(len(left))
        score = rel[left] / redundancy
        best = int(np.argmax(score))
        out.append((cols[left[best]], float(score[best])))
        chosen.append(left.pop(best))
    return out


#: The parts of ``llm-ratio[:model:decoding:context:examples]`` after the kind: columns of saved tables.
SAVED_KEYS = ["llm_model", "decoding", "context", "examples"]


def saved_concepts(
    saved: DataFrame, method: str, concepts: DataFrame, ratio=None, topk=None, threshold=None, seed=1
) -> DataFrame:
    """Concepts that saved scores (concept, score) or rankings (concept, pos) select.

    ``method`` is ``llm-ratio``, ``llm-topk``, ``llm-threshold`` or ``llm-rank``; fields after
    a colon pick the rows of ``saved`` whose key columns have those values.  Only the given
    ``concepts`` count; those that a ranking does not name follow it in seeded order.
    """
    kind, *fields = method.split(":")
    for name, value in zip(SAVED_KEYS, fields, strict=False):
        if value and name in saved.columns:
            saved = saved.filter(F.col(name).cast("string") == value)
    mine = saved.join(concepts.select("concept").distinct(), "concept", "left_semi")
    if kind == "llm-rank":
        full = append_missing(dedupe_in_order(mine, []), [], concepts, seed)
        return full.filter(F.col("pos") < topk) if topk is not None else prefix_by_ratio(full, ratio)
    size = {"llm-ratio": {"ratio": ratio}, "llm-topk": {"topk": topk}, "llm-threshold": {"threshold": threshold}}[kind]
    return select_by_score(mine.select("concept", "score"), "concept", **size, seed=seed)


SCORE_FUNCTIONS = {
    "mi": lambda df, cols, label, task: stats.mutual_info_binned(
        df, cols, label, label_bins=10 if task == "regression" else None
    ),
    "pearson": lambda df, cols, label, task: stats.pearson(df, cols, label),
    "spearman": lambda df, cols, label, task: stats.spearman(df, cols, label),
    "fisher": lambda df, cols, label, task: stats.fisher(df, cols, label),
    "f": lambda df, cols, label, task: (stats.f_classif if task == "classification" else stats.f_regression)(df, cols, label),
}


def filter_features(df, cols, label, task, ratio: float, score_fn="mi") -> DataFrame:
    """Keep the top ``int(100*ratio)`` percent of features by a score function.

    ``score_fn`` is a name or ``f(df, cols, label, task) -> DataFrame(feature, score)``.
    """
    fn = SCORE_FUNCTIONS[score_fn] if isinstance(score_fn, str) else score_fn
    positions = {c: i for i, c in enumerate(cols)}
    rows = [
        (r["feature"], float(r["score"]), positions[r["feature"]])
        for r in small_rows(fn(df, cols, label, task)) if r["score"] is not None and not math.isnan(r["score"])
    ]
    table = local_table(df.sparkSession, rows, {"feature": pa.string(), "score": pa.float64(), "col": pa.int32()})
    return top_percentile(table, "feature", int(100 * ratio), order="col").drop("col")


#: Columns of a selection.
_SELECTED = {"feature": pa.string(), "pos": pa.int32(), "score": pa.float64()}


def kept_by_lasso(coefficients: list[tuple[str, float]]) -> list[str]:
    """The features whose L1 coefficient is not negligible."""
    return [c for c, w in coefficients if abs(w) >= 1e-5]


def select_features(
    df, cols, label, method, task="classification", ratio=None, topk=None, threshold=None, seed=1, fold=None,
    feature_list=None, strength=1.0, saved=None,
) -> DataFrame:
    """(feature, pos, score) of one selection method over encoded features.

    The ``llm-*`` methods select concepts by the ``saved`` scores or rankings and keep all
    columns of a selected concept.
    """
    from sieveline.operators import linear
    from sieveline.operators.split import sample_names

    spark = df.sparkSession

    def cut(order: list[tuple[str, float]]):
        check_size(None, ratio, topk)
        n = topk if topk is not None else math.floor(ratio * len(cols))
        rows = [(f, i, None if s is None or math.isnan(s) else float(s)) for i, (f, s) in enumerate(order[:n])]
        return local_table(spark, rows, _SELECTED)

    def listed(names):
        return local_table(spark, [(c, i, None) for i, c in enumerate(names)], _SELECTED)

    if feature_list is not None:  # an explicit list overrides the method
        return listed([c for c in feature_list if c in cols])
    if method == "all":
        return listed(cols)
    if method == "random-feature":
        picked = sample_names(listed(cols).select("feature"), "feature", ratio, seed)
        return listed([r["feature"] for r in small_rows(picked)])
    if method == "random-concept":  # a share of the concepts, each with all of its columns
        concepts = listed(cols).select(F.split_part("feature", F.lit("_"), F.lit(1)).alias("concept")).distinct()
        picked = {r["concept"] for r in small_rows(sample_names(concepts, "concept", ratio, seed))}
        return listed([c for c in cols if c.split("_")[0] in picked])
    if method.startswith("llm-"):
        concepts = listed(cols).select(F.split_part("feature", F.lit("_"), F.lit(1)).alias("concept")).distinct()
        picked = {r["concept"] for r in small_rows(saved_concepts(saved, method, concepts, ratio, topk, threshold, seed))}
        return listed([c for c in cols if c.split("_")[0] in picked])
    if method == "filter-mi":
        kept = [r["feature"] for r in small_rows(filter_features(df, cols, label, task, ratio))]
        return listed([c for c in cols if c in set(kept)])
    if method == "mrmr":
        return cut(mrmr(df, cols, label, task))
    if method == "lasso":
        found = linear.lasso_coefficients(df, cols, label, task, strength)
        size = {c: abs(w) for c, w in found}
        return local_table(spark, [(c, i, size[c]) for i, c in enumerate(kept_by_lasso(found))], _SELECTED)
    if method == "rfe":
        return cut([(c, None) for c in linear.rfe_order(df, cols, label, task)])
    if method in ("forward-seq", "backward-seq"):
        return cut(linear.sequential_select(df, cols, label, fold, task, method.split("-")[0]))
    scores = SCORE_FUNCTIONS[method](df, cols, label, task)
    return select_by_score(scores, "feature", threshold, ratio, topk, seed=seed)
