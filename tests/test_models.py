"""Fits: optimality, agreement with Spark ML, planted-feature recovery."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import importance as imp
from sieveline.operators import linear, sparse, report, trials
from sieveline.operators import select as sel
from sieveline.operators.encode import MixedEncoder
from sieveline.operators.split import block_folds, folds, split
from sieveline.plans import datasets as ds
from sieveline.plans import specs

COLS = [f"x{i}" for i in range(8)]
TRUE = {"x1": 2.0, "x4": -1.5, "x6": 1.0}


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    n = 1200
    x = rng.normal(size=(n, 8))
    m = sum(w * x[:, int(c[1])] for c, w in TRUE.items())
    y = (rng.random(n) < 1 / (1 + np.exp(-m))).astype(int)
    z = m + rng.normal(scale=0.5, size=n)
    rows = [(i, *map(float, x[i]), int(y[i]), float(z[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in COLS) + ", y int, z double")
    return df.persist(), x, y, z


def test_ridge_equals_normal_equations(planted):
    df, x, _, z = planted
    b, w = linear.ridge_fit(df, COLS, "z", alpha=3.0)
    xc, zc = x - x.mean(0), z - z.mean()
    want = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(8), xc.T @ zc)
    assert np.allclose(w, want)
    assert b == pytest.approx(z.mean() - x.mean(0) @ want)


def test_joint_logistic_equals_single_fits(planted):
    df, x, y, _ = planted
    df = folds(df, "id", 3, "y").persist()
    specs_ = [linear.LogisticSpec(range(8), c, f) for c in (0.1, 10) for f in (None, 0, 2)]
    fold = np.array([r["fold"] for r in df.orderBy("id").collect()])
    for (b, w), s in zip(linear.logistic_fit_many(df, COLS, "y", specs_, fold="fold"), specs_):
        keep = np.ones(len(y), bool) if s.hold_out is None else fold != s.hold_out
        xs, ys = x[keep], y[keep]
        cw = np.where(ys == 1, len(ys) / (2 * ys.sum()), len(ys) / (2 * (1 - ys).sum()))
        p = 1 / (1 + np.exp(-(xs @ w + b)))
        assert np.abs(xs.T @ (cw * (p - ys)) + w / s.c).max() < 1e-5  # stationary
        assert abs((cw * (p - ys)).sum()) < 1e-5


def test_logistic_agrees_with_spark_ml(planted):
    df = planted[0]
    (b, w), = linear.logistic_fit_many(df, COLS, "y", [linear.LogisticSpec(range(8), 0.5)])
    model = linear.logistic_ml(df, COLS, "y", 0.5)
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-4)
    assert model.intercept == pytest.approx(b, abs=1e-4)


@pytest.mark.parametrize("method", ["filter-mi", "mrmr", "rfe", "lasso", "forward-seq", "backward-seq", "fisher", "pearson"])
def test_selection_recovers_planted_features(planted, method):
    df = folds(planted[0], "id", 3, "y")
    kwargs = {"ratio": 3 / 8} if method == "filter-mi" else {"topk": 3}
    got = sel.select_features(df, COLS, "y", method, fold="fold", strength=0.02, **kwargs)
    top = {r["feature"] for r in got.orderBy(F.desc("score")).limit(3).collect()} if method == "lasso" else {r["feature"] for r in got.collect()}
    assert top == set(TRUE)


@pytest.mark.parametrize("method", ["mrmr", "rfe", "forward-seq", "backward-seq", "spearman"])
def test_selection_for_regression(planted, method):
    df = block_folds(planted[0], "id", 3)
    got = sel.select_features(df, COLS, "z", method, "regression", topk=3, fold="fold")
    assert {r["feature"] for r in got.collect()} == set(TRUE)


def test_forward_selection_stops_by_tolerance(planted):
    df = block_folds(planted[0], "id", 3)
    order = linear.sequential_select(df, COLS, "z", "fold", "regression", tol=0.02)
    assert {f for f, _ in order} == set(TRUE)


def test_group_lasso_path(planted):
    df, x, y, _ = planted
    groups = [0, 1, 2, 3, 1, 4, 1, 5]  # x1, x4, x6 share a group
    lambdas = [0.3, 0.05, 0.01]
    rows = linear.group_lasso_path(df, COLS, "y", groups, lambdas)
    assert [r[1] for r in rows] == [0.3, 0.05, 0.01, 0.0]
    assert set(rows[1][4]) == set(TRUE)
    assert rows[-1][2] == 8 and rows[-1][3] > 0.85
    sizes = [r[2] for r in rows]
    assert sizes == sorted(sizes)
    # the walked path equals the joint one
    old, sparse._PASS_NUMBERS = sparse._PASS_NUMBERS, 1
    try:
        again = linear.group_lasso_path(df, COLS, "y", groups, lambdas)
    finally:
        sparse._PASS_NUMBERS = old
    assert [r[4] for r in again] == [r[4] for r in rows]
    assert np.allclose([r[3] for r in again], [r[3] for r in rows], atol=1e-4)


def test_permutation_importance_ranks_planted_features(planted):
    df, x, _, z = planted
    b, w = linear.ridge_fit(df, COLS, "z")
    got = {r["feature"]: r["score"] for r in imp.permutation(df, "id", COLS, "z", b, w, "regression", 5).collect()}
    assert sorted(got, key=got.get)[-3:] == ["x6", "x4", "x1"]
    assert abs(got["x0"]) < 0.02


def test_sampled_shapley_is_exact_for_a_linear_model(planted, spark):
    df = planted[0].limit(30).persist()
    w = [TRUE.get(c, 0.0) for c in COLS]
    mean = [0.1 * i for i in range(8)]

    def predict(d):
        margin = sum((F.col("x")[i] * F.lit(w[i]) for i in range(8)), F.lit(0.0))
        return d.withColumn("prediction", margin)

    got = {(r["id"], r["feature"]): r["value"] for r in imp.sampled_shap(df, "id", COLS, predict, [mean], 3).collect()}
    for r in imp.linear_shap(df, COLS, w, mean, ["id"]).collect():
        for c in COLS:
            assert got[(r["id"], c)] == pytest.approx(r[c], abs=1e-9)


def test_kmeans_sweep_finds_the_planted_number(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 3)) * 50
    x = centres[rng.integers(0, 8, 600)] + rng.normal(size=(600, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    _, best, found = imp.kmeans_sweep(df, ["a", "b", "c"], range(5, 14))
    assert best == 8 and found.shape == (8, 3)


def test_search_draws_are_seeded_and_in_range():
    for model, space in trials.SPACES.items():
        for t in range(20):
            p = trials.draw_params(model, t, 1)
            assert p == trials.draw_params(model, t, 1)
            for name, (kind, *rest) in space.items():
                if kind == "choice":
                    assert p[name] in rest
                else:
                    assert rest[0] <= p[name] <= rest[1]


@pytest.mark.parametrize("model,task,label", [("linear", "regression", "z"), ("xgb", "classification", "y"), ("lgb", "regression", "z"), ("mlp", "classification", "y")])
def test_trials(planted, model, task, label):
    space = dict(trials.SPACES[model])
    if model == "mlp":
        space["d_hidden"] = ("int", 4, 9)
    if model == "xgb":
        space["max_depth"] = ("int", 2, 4)
    if model == "lgb":
        space["num_leaves"] = ("int", 4, 9)
    df = split(planted[0], "id", "y")
    out = trials.random_search(df, COLS, label, task, model, n_trials=2, rounds=20, space=space)
    rows = out.collect()
    assert len(rows) == 2 and all(r["test_metric"] is not None for r in rows)
    best = trials.best_of(out, task).first()
    pick = (max if task == "classification" else min)(rows, key=lambda r: r["val_metric"])
    assert best["test_metric"] == pick["test_metric"]
    assert best["test_metric"] > 0.7 if task == "classification" else best["test_metric"] < 1.6


def test_encoder_uses_training_categories_only(spark):
    train = spark.createDataFrame([(1.0, "b"), (3.0, "a")], "n double, c string")
    test = spark.createDataFrame([(5.0, "z"), (1.0, None)], "n double, c string")
    model = MixedEncoder(["n"], ["c"]).fit(train)
    assert model.feature_names == ["n", "c_a", "c_b"]
    assert [tuple(r) for r in model.transform(test).collect()] == [(3.0, 0.0, 0.0), (-1.0, 0.0, 0.0)]


def test_constant_column_is_divided_by_one(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "n double")
    assert [r["n"] for r in MixedEncoder(["n"], []).fit(df).transform(df).collect()] == [0.0, 0.0]


def test_spec_rejects_unknown_and_empty_selections(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "id int, MedInc int, target double")
    with pytest.raises(ValueError):
        specs.build_dataset(df, ds.CALHOUSING, "id", ["nothing"])
    with pytest.raises(ValueError):
        specs.build_dataset(df, ds.CALHOUSING, "id", [])


def test_registered_maps_are_complete():
    assert len(ds.SERIES_VOCABULARY) == 27 and len(ds.PROMPT_NAMES) == 12
    assert len(ds.BREAST_CANCER.concepts) == 30 and len(ds.BANK.concepts) == 16
    assert {k: len(set(v)) - 4 for k, v in ds.SURVEY_EXCLUDED.items()}["mobility"] == 5


def test_knee_and_nearest_size(spark):
    pts = spark.createDataFrame([(k, 100.0 / k if k < 5 else 20.0 - k * 0.1) for k in range(1, 12)], "k int, i double")
    assert report.knee(pts, "k", "i").first()["knee"] in (4, 5)
    path = spark.createDataFrame([(0, 0), (1, 2), (2, 4), (3, 4)], "step int, n_selected int")
    assert sel.nearest_size(path, 3).first()["step"] == 1


def test_path_area_lies_between_the_extremes(spark):
    rows = [("a", f / 10, 0.5 + f / 30) for f in range(1, 11)]
    df = spark.createDataFrame(rows, "m string, frac double, metric double")
    area = report.path_area(df, ["m"]).first()["area"]
    assert 0.5 <= area <= 0.5 + 10 / 30
