"""The two comparisons: selection methods on small data, tuned models on large data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators import infold, linear
from sieveline.operators.encode import MixedEncoder
from sieveline.operators.report import path_table
from sieveline.operators.select import SCORE_FUNCTIONS, filter_features, kept_by_lasso, select_features
from sieveline.operators.split import folds, split, take_split
from sieveline.operators.trials import best_of, random_search
from sieveline.runtime import cut_lineage, gathered, side_by_side


def encoded_parts(df: DataFrame, row_id: str, label: str, numeric, categorical, task: str, seed: int):
    """Split, fit the encoder on train only, encode all parts: (table, feature names)."""
    parts = split(df, row_id, label if task == "classification" else None, seed=seed)
    model = MixedEncoder(numeric, categorical).fit(take_split(parts, "train"))
    return model.transform(parts), model.feature_names


def compare_selection(
    df: DataFrame, row_id: str, label: str, numeric: list[str], categorical: list[str], task: str,
    methods: list[str], ratios: list[float], seeds: list[int], strengths: list[float] = (),
    saved: DataFrame | None = None,
) -> DataFrame:
    """(fs_method, ratio, frac, mean, std): test metric of a tuned linear model per method and ratio over seeds.

    Every selected set of columns has its penalty tuned by cross-validation on the training
    rows, with scaling inside the folds; the sets of all methods and ratios are tuned together.
    ``lasso`` is run at each of ``strengths``, which then stands in the ratio column;
    a strength that selects nothing is a row with frac 0 (the intercept alone).  ``llm-ratio``
    and ``llm-rank`` methods select by the ``saved`` table.  The source is read once; each seed splits
    and encodes it once for all methods and ratios.  A method's full order is computed once and
    cut at every ratio.  Seeds, and the methods of a seed, run side by side: most of their jobs
    are short and would leave the cluster idle one after another.
    """
    spark = df.sparkSession
    columns = dict.fromkeys([row_id, label, *numeric, *categorical])
    held, source = gathered(df.select(*[F.col(f"`{c}`") for c in columns]))

    def of_seed(seed: int) -> list[tuple]:
        table, cols = encoded_parts(source, row_id, label, numeric, categorical, task, seed)
        table = folds(table, row_id, 5, label if task == "classification" else None, seed=seed).persist()
        train, test = table.filter("split != 'test'"), take_split(table, "test")
        cells = lambda method: _prefixes(train, cols, label, method, task, ratios, seed, strengths, saved)
        found = side_by_side(spark, cells, methods)
        picks = [(method, ratio, chosen) for method, each in zip(methods, found, strict=True) for ratio, chosen in each]
        subsets = sorted({tuple(sorted(p[2])) for p in picks})
        specs = [linear.LogisticSpec([cols.index(c) for c in s]) for s in subsets]
        tuned = infold.tune_subsets(train, cols, label, "fold", task, [s.subset for s in specs])
        models = [(b, w) for _, b, w in tuned]
        scores = linear.cv_scores(test, cols, label, models, specs, None, task, test.count())
        by_subset = dict(zip(subsets, scores, strict=True))
        results = []
        for method, ratio, chosen in picks:
            value = float(by_subset[tuple(sorted(chosen))])
            results.append((method, float(ratio), len(chosen) / len(cols), seed, value if task == "classification" else -value))
        table.unpersist()
        return results

    results = [r for each in side_by_side(spark, of_seed, seeds) for r in each]
    held.unpersist()
    rows = spark.createDataFrame(results, "fs_method string, ratio double, frac double, seed int, metric double")
    return path_table(rows, ["fs_method", "ratio", "frac"], "metric")


def _prefixes(train, cols, label, method, task, ratios, seed, strengths=(), saved=None):
    """(ratio or strength, feature names) of every cell of a method."""
    if method == "lasso":
        found = linear.lasso_path(train, cols, label, task, list(strengths)) if strengths else []
        return [(s, kept_by_lasso(w)) for s, w in zip(strengths, found, strict=True)]
    sizes = [(r, math.floor(r * len(cols))) for r in ratios]
    if method in ("mrmr", "rfe", "forward-seq", "backward-seq"):
        full = select_features(train, cols, label, method, task, topk=len(cols), fold="fold", seed=seed)
        order = [r["feature"] for r in full.orderBy("pos").collect()]  # one row per feature
        return [(r, order[:n]) for r, n in sizes if n > 0]
    if method == "filter-mi":
        scores = cut_lineage(SCORE_FUNCTIONS["mi"](train, cols, label, task))
        keep = lambda *_: scores  # noqa: E731  (scored once, cut at every ratio)
        picks = [(r, filter_features(train, cols, label, task, r, keep)) for r, n in sizes if n > 0]
        return [(r, names) for r, kept in picks if (names := [x["feature"] for x in kept.collect()])]  # feature rows
    out = []
    for r, n in sizes:
        if n > 0:
            kept = select_features(train, cols, label, method, task, ratio=r, seed=seed, saved=saved)
            names = [row["feature"] for row in kept.collect()]  # one row per feature
            if names:
                out.append((r, names))
    return out


def compare_models(
    df: DataFrame, row_id: str, label: str, numeric, categorical, task: str, models: list[str], masks: dict,
    seeds: list[int], n_trials: int = 40, rounds: int = 15,
) -> DataFrame:
    """(model, fs_method, ratio, seed, test_metric): tuned model per mask and seed.

    ``masks`` maps (fs_method, ratio) to feature names, or None for all features.
    """
    out = None
    for seed in seeds:
        table, cols = encoded_parts(df, row_id, label, numeric, categorical, task, seed)
        table = table.persist()
        for (method, ratio), names in masks.items():
            used = [c for c in cols if names is None or c in set(names)]
            for model in models:
                trials = random_search(table, used, label, task, model, n_trials, rounds, seed, method, ratio)
                part = best_of(trials, task)
                out = part if out is None else out.unionByName(part)
        table.unpersist()
    return out
