"""Hyper-parameter trials: seeded search spaces, fits on Spark ML, a trials table.

Linear trials are fitted jointly, a data pass per Newton step for all of them.  Tree
and perceptron fits are Spark jobs over one shared, persisted table; a small thread
pool only keeps several of these jobs in flight.
"""

from __future__ import annotations

import hashlib
import math
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.evaluate import auroc, mae
from sieveline.operators.linear import (
    LogisticSpec, aurocs, balanced_class_weights, features_array, fit_models, margins_long,
)

# --- fixed values: search spaces ---------------------------------------------------------
# kind, low, high; 'choice' lists its values, 'int' excludes the high end

SPACES = {
    "linear": {"batch_size": ("choice", 256, 512, 1024), "lr": ("log", 1e-4, 1e-2), "l2": ("log", 1e-3, 1)},
    "lgb": {
        "num_leaves": ("int", 20, 60), "learning_rate": ("uniform", 1e-2, 0.5), "subsample": ("uniform", 0.5, 1),
        "lambda": ("uniform", 0, 2), "min_child_weight": ("log", 1e-3, 1),
    },
    "xgb": {
        "max_depth": ("int", 6, 12), "learning_rate": ("uniform", 1e-2, 0.5), "subsample": ("uniform", 0.5, 1),
        "lambda": ("uniform", 0, 2), "min_child_weight": ("uniform", 1e-3, 2),
    },
    "mlp": {
        "d_hidden": ("int", 200, 500), "num_layers": ("choice", 2, 3, 4), "dropout": ("uniform", 0, 0.5),
        "batch_size": ("choice", 256, 512, 1024), "lr": ("log", 1e-4, 1e-2),
    },
}


def _draw(seed, *key) -> float:
    digest = hashlib.md5("|".join(str(k) for k in (seed, *key)).encode()).hexdigest()
    return int(digest[:15], 16) / float(1 << 60)


def draw_params(model: str, trial: int, seed: int, space: dict | None = None) -> dict[str, float]:
    """One seeded draw from a search space."""
    out = {}
    for name, (kind, *rest) in (space or SPACES[model]).items():
        u = _draw(seed, model, trial, name)
        if kind == "choice":
            out[name] = float(rest[int(u * len(rest))])
        elif kind == "int":
            out[name] = float(rest[0] + int(u * (rest[1] - rest[0])))
        elif kind == "log":
            out[name] = math.exp(math.log(rest[0]) + u * (math.log(rest[1]) - math.log(rest[0])))
        else:
            out[name] = rest[0] + u * (rest[1] - rest[0])
    return out


def prepare(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """(split, label, features, w): one vector table for all trials, balanced weights from train."""
    vec = df.select(
        "split", F.col(label).cast("double").alias("label"), array_to_vector(features_array(cols)).alias("features")
    )
    counts = {r["label"]: r["count"] for r in vec.filter("split = 'train'").groupBy("label").count().limit(3).collect()}
    if set(counts) == {0.0, 1.0}:
        weights = balanced_class_weights(counts)
        w = F.when(F.col("label") > 0.5, F.lit(weights[1.0])).otherwise(F.lit(weights[0.0]))
    else:
        w = F.lit(1.0)
    return vec.withColumn("w", w)


def fit_trial(vec: DataFrame, model: str, task: str, params: dict[str, float], rounds: int, seed: int, d: int):
    """Fit one trial on the train rows (boosting stops early on the val rows)."""
    train = vec.filter("split = 'train'")
    cls = task == "classification"
    if model in ("lgb", "xgb"):
        depth = int(params.get("max_depth") or round(math.log2(params["num_leaves"])))
        common = {
            "maxIter": rounds, "maxDepth": min(depth, 12), "stepSize": params["learning_rate"],
            "subsamplingRate": params["subsample"], "seed": seed, "weightCol": "w", "validationIndicatorCol": "is_val",
        }
        est = GBTClassifier(**common) if cls else GBTRegressor(**common)
        return est.fit(vec.filter("split != 'test'").withColumn("is_val", F.col("split") == "val"))
    if model == "mlp":
        if not cls:
            raise ValueError("Spark ML has no perceptron regressor")
        hidden = [int(params["d_hidden"])] * int(params["num_layers"])
        est = MultilayerPerceptronClassifier(
            layers=[d, *hidden, 2], maxIter=rounds, seed=seed, stepSize=params["lr"], blockSize=int(params["batch_size"])
        )
        return est.fit(train)
    raise ValueError(f"unknown model {model}")


def predictions(fitted, vec: DataFrame, task: str) -> DataFrame:
    """(split, label, prob): probability of the positive class, or the prediction."""
    out = fitted.transform(vec)
    prob = vector_to_array("probability")[1] if task == "classification" else F.col("prediction")
    return out.select("split", "label", prob.alias("prob"))


def trial_metrics(scored: DataFrame, task: str, n_trials: int) -> dict[tuple[int, str], float]:
    """(trial, split) → AUROC or mean absolute error, for all trials in one evaluation."""
    keys = ["trial", "split"]
    if task == "classification":
        rows = auroc(scored, "label", "prob", by=keys, series=3 * n_trials).collect()  # three rows per trial
        return {(r["trial"], r["split"]): r["auroc"] for r in rows}
    rows = scored.groupBy(*keys).agg(mae("label", "prob").alias("mae")).collect()  # three rows per trial
    return {(r["trial"], r["split"]): r["mae"] for r in rows}


_PARTS = ["train", "val", "test"]


def _linear_trials(df: DataFrame, cols: list[str], label: str, task: str, params: list[dict]) -> dict:
    """All linear trials as one joint fit: they differ only in the penalty.

    A logistic search costs one pass per Newton step and a ridge search one pass,
    whatever the number of trials.
    """
    part = F.array_position(F.array(*[F.lit(p) for p in _PARTS]), F.col("split")) - 1
    rows = df.select(*[F.col(f"`{c}`") for c in cols], label, part.cast("int").alias("_part")).persist()
    specs = [LogisticSpec(range(len(cols)), 1.0 / p["l2"] if task == "classification" else p["l2"]) for p in params]
    try:
        models = fit_models(rows.filter("_part = 0"), cols, label, specs, None, task)
        if task == "classification":
            found = aurocs(rows, cols, label, models, specs, "_part", by_fold=len(_PARTS))
            return {(g // len(_PARTS), _PARTS[g % len(_PARTS)]): v for g, v in found.items()}
        scored = margins_long(rows, cols, label, models, specs, "_part")
        split_name = F.element_at(F.array(*[F.lit(p) for p in _PARTS]), F.col("f") + 1)
        scored = scored.select(
            F.col("model").alias("trial"), split_name.alias("split"), F.col("y").alias("label"), F.col("margin").alias("prob")
        )
        return trial_metrics(scored, task, len(params))
    finally:
        rows.unpersist()


TRIAL_SCHEMA = (
    "model string, fs_method string, ratio double, seed int, trial int, params map<string,double>, "
    "val_metric double, test_metric double"
)


def random_search(
    df: DataFrame, cols: list[str], label: str, task: str, model: str, n_trials: int = 40, rounds: int = 15,
    seed: int = 1, fs_method: str = "all", ratio: float = 1.0, parallelism: int = 4, space: dict | None = None,
) -> DataFrame:
    """Trials table of a seeded random search; ``df`` has ``split`` in {train, val, test}."""
    spark = df.sparkSession
    params = [draw_params(model, t, seed, space) for t in range(n_trials)]
    if model == "linear":
        metric = _linear_trials(df, cols, label, task, params)
    else:
        vec = prepare(df, cols, label).persist()
        fit = lambda t: fit_trial(vec, model, task, params[t], rounds, seed, len(cols))
        try:
            with ThreadPool(min(parallelism, n_trials)) as pool:
                fitted = pool.map(fit, range(n_trials))
            scored = None
            for trial, f in enumerate(fitted):
                part = predictions(f, vec, task).withColumn("trial", F.lit(trial))
                scored = part if scored is None else scored.unionByName(part)
            metric = trial_metrics(scored, task, n_trials)
        finally:
            vec.unpersist()
    rows = [
        (model, fs_method, float(ratio), int(seed), t, params[t], metric.get((t, "val")), metric.get((t, "test")))
        for t in range(n_trials)
    ]
    return spark.createDataFrame(rows, TRIAL_SCHEMA)


def best_of(trials: DataFrame, task: str) -> DataFrame:
    """(model, fs_method, ratio, seed, test_metric) of the trial that is best on validation."""
    from sieveline.operators.report import best_row

    best = best_row(trials, ["model", "fs_method", "ratio", "seed"], "val_metric", "max" if task == "classification" else "min", ["trial"])
    return best.select("model", "fs_method", "ratio", "seed", "test_metric")
