"""Chains fitted inside folds against plain per-fold fits; missing numbers in statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import infold, linear, stats
from sieveline.operators import select as sel

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(600, 4)) * [1, 50, 0.1, 5] + [3, 1000, 0, -20]
    y = x @ [1.0, 0.05, 3.0, 0.0] + draw.normal(size=600)
    fold = np.arange(600) % 5
    x[fold == 4, 1] += 400  # a fold whose scale differs from the others'
    return x, y, fold


@pytest.fixture(scope="module")
def table(spark, rows):
    x, y, fold = rows
    data = [(int(f), float(t), float(t > 50), *map(float, r)) for r, t, f in zip(x, y, fold, strict=True)]
    return spark.createDataFrame(data, "fold int, y double, z double, a double, b double, c double, d double").repartition(4).cache()


def plain_ridge(x, y, alpha):
    mean, sd = x.mean(0), x.std(0)
    s = (x - mean) / sd
    w = np.linalg.solve(s.T @ s + alpha * np.eye(x.shape[1]), s.T @ (y - y.mean()))
    return lambda t: y.mean() + (t - mean) / sd @ w


@pytest.mark.parametrize("selector", [None, "f", "mrmr", "rfe"])
def test_ridge_chain_equals_plain_fits(table, rows, selector):
    x, y, fold = rows
    found = infold.chain_search(table, COLS, "y", "fold", "regression", [0.1, 50.0], [1, 3], selector)

    def order(part, label, alpha):
        corr = np.abs([np.corrcoef(part[:, j], label)[0, 1] for j in range(4)])
        if selector == "f":
            return np.argsort(-corr, kind="stable").tolist()
        if selector == "rfe":
            left, gone = [0, 1, 2, 3], []
            while len(left) > 1:
                s = (part[:, left] - part[:, left].mean(0)) / part[:, left].std(0)
                w = np.linalg.solve(s.T @ s + alpha * np.eye(len(left)), s.T @ (label - label.mean()))
                gone.append(left.pop(int(np.argmin(w**2))))
            return left + gone[::-1]
        f = corr**2 / (1 - corr**2) * (len(part) - 2)
        among = np.abs(np.corrcoef(part.T))
        left, chosen = [0, 1, 2, 3], []
        while left:
            near = [np.clip(among[j, chosen], 0.001, None).mean() if chosen else 1 for j in left]
            chosen.append(left.pop(int(np.argmax(f[left] / near))))
        return chosen

    for alpha, size, mean, std in found.cells:
        scores = []
        for h in range(5):
            part, label = x[fold != h], y[fold != h]
            keep = sorted(order(part, label, alpha)[:size]) if selector else [0, 1, 2, 3]
            guess = plain_ridge(part[:, keep], label, alpha)(x[fold == h][:, keep])
            scores.append(-np.abs(guess - y[fold == h]).mean())
        assert mean == pytest.approx(np.mean(scores), rel=1e-9) and std == pytest.approx(np.std(scores), rel=1e-6)
    keep = sorted(order(x, y, found.penalty)[: found.size]) if selector else [0, 1, 2, 3]
    assert found.chain.features == [COLS[j] for j in keep]
    guess = plain_ridge(x[:, keep], y, found.penalty)(x[:, keep])
    got = infold.predict(table, found.chain, "regression").select("y", "prediction").collect()
    assert np.allclose(sorted((r.y, r.prediction) for r in got), sorted(zip(y, guess, strict=True)))


def plain_logistic(x, y, c):
    mean, sd = x.mean(0), x.std(0)
    s = np.hstack([np.ones((len(x), 1)), (x - mean) / sd])
    weight = np.where(y > 0.5, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta, ridge = np.zeros(s.shape[1]), np.diag([0.0, *[1 / c] * x.shape[1]])
    for _ in range(60):
        p = 1 / (1 + np.exp(-s @ beta))
        h = (s * (weight * p * (1 - p))[:, None]).T @ s + ridge
        beta = beta - np.linalg.solve(h, s.T @ (weight * (p - y)) + ridge @ beta)
    return lambda t: beta[0] + (t - mean) / sd @ beta[1:]


def test_logistic_chain_equals_plain_fits(table, rows):
    x, y, fold = rows
    z = (y > 50).astype(float)
    found = infold.chain_search(table, COLS, "z", "fold", "classification", [0.5, 20.0], [2], "f")
    for c, _, mean, _ in found.cells:
        scores = []
        for h in range(5):
            part, label, test, truth = x[fold != h], z[fold != h], x[fold == h], z[fold == h]
            keep = sorted(np.argsort([-abs(np.corrcoef(part[:, j], label)[0, 1]) for j in range(4)])[:2].tolist())
            m = plain_logistic(part[:, keep], label, c)(test[:, keep])
            scores.append(np.mean([(a > b) + 0.5 * (a == b) for a in m[truth == 1] for b in m[truth == 0]]))
        assert mean == pytest.approx(np.mean(scores), abs=1e-9)
    keep = [COLS.index(f) for f in found.chain.features]
    m = plain_logistic(x[:, keep], z, found.penalty)(x[:, keep])
    got = infold.predict(table, found.chain, "classification").select("y", "prediction").collect()
    assert dict(sorted((r.y, r.prediction) for r in got)) == pytest.approx(dict(zip(y.tolist(), (1 / (1 + np.exp(-m))).tolist(), strict=True)), abs=1e-6)


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_subsets_are_tuned_each_by_itself(table, task):
    label = "y" if task == "regression" else "z"
    got = infold.tune_subsets(table, COLS, label, "fold", task, [[0, 1, 2, 3], [1], [0, 2]])
    for (penalty, b, w), names in zip(got, (COLS, ["b"], ["a", "c"]), strict=True):
        alone = infold.chain_search(table, names, label, "fold", task)
        assert penalty == alone.penalty and b == pytest.approx(alone.chain.intercept, abs=1e-5)
        assert np.allclose(w, alone.chain.coef, atol=1e-6)


def test_unscaled_columns_and_own_selector(table, rows):
    x, y, _ = rows
    found = infold.chain_search(table, COLS, "y", "fold", "regression", [1.0], [2], lambda gram, penalty: [3, 0, 1, 2], scale=[])
    assert found.chain.features == ["a", "d"] and found.chain.scale == [1.0, 1.0]
    b, w = linear.ridge_fit(table, ["a", "d"], "y", 1.0)
    assert found.chain.intercept == pytest.approx(b) and found.chain.coef == pytest.approx(w)


def test_constant_columns_and_gaps(spark, table):
    df = table.withColumn("k", F.lit(7.0)).withColumn("a", F.when(F.col("y") > 45, F.col("a")).when(F.col("y") > 44, float("nan")))
    found = infold.chain_search(df, ["k", *COLS], "y", "fold", "regression", [0.1, 1.0])
    whole = infold.chain_search(df.filter("a is not null and not isnan(a)"), COLS, "y", "fold", "regression", [0.1, 1.0])
    assert [c[2] for c in found.cells] == pytest.approx([c[2] for c in whole.cells])
    assert all(np.isfinite([c[2] for c in found.cells]))


def test_scores_over_folds_that_have_one():
    mean, std = linear.fold_means(np.array([[1.0, np.nan, 3.0], [np.nan, np.nan, np.nan]]))
    assert mean[0] == 2.0 and std[0] == 1.0 and np.isnan(mean[1])
    with pytest.raises(ValueError):
        linear.fold_means(np.full((2, 2), np.nan))


def test_one_gap_does_not_empty_a_score(table):
    gappy = table.withColumn("a", F.when(F.col("y") < 51, F.col("a")))
    rows, _, _, _ = linear.grid_search(gappy, COLS, "y", "fold", "regression", [0.1, 1.0])
    assert np.isfinite([r[1] for r in rows]).all()


@pytest.fixture(scope="module")
def noisy(spark):
    draw = np.random.default_rng(0)
    y = draw.integers(0, 2, 400).astype(float)
    a, c, b = y + 0.4 * draw.normal(size=400), y + 0.8 * draw.normal(size=400), draw.normal(size=400)
    data = [(float(a[i]), float("nan") if i == 11 else float(b[i]), float(c[i]), float(y[i])) for i in range(400)]
    return spark.createDataFrame(data, "a double, b double, c double, y double").cache()


def test_a_nan_is_a_missing_value(noisy):
    null = noisy.withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    for fn in (stats.pearson, stats.spearman, stats.fisher, stats.f_classif, stats.f_regression, stats.mutual_info_binned):
        got, want = ({r.feature: r.score for r in fn(df, ["a", "b", "c"], "y").collect()} for df in (noisy, null))
        assert got == pytest.approx(want) and np.isfinite(list(got.values())).all()
    order = [r.feature for r in sel.select_features(noisy, ["a", "b", "c"], "y", "mrmr", topk=3).orderBy("pos").collect()]
    assert order[0] == "a" and order == [r.feature for r in sel.select_features(null, ["a", "b", "c"], "y", "mrmr", topk=3).orderBy("pos").collect()]
    assert [r.feature for r in sel.select_features(noisy, ["a", "b", "c"], "y", "fisher", topk=1).collect()] == ["a"]


def test_missing_scores_come_last(spark):
    scores = spark.createDataFrame([("x", float("nan")), ("y", 0.5), ("z", None), ("w", 0.9)], "concept string, score double")
    assert [r.concept for r in sel.by_topk(scores, "concept", 2).orderBy("pos").collect()] == ["w", "y"]
    assert {r.concept for r in sel.by_threshold(scores, 0.1).collect()} == {"y", "w"}
    assert [r.concept for r in sel.ordered(scores, "concept").orderBy("pos").collect()][:2] == ["w", "y"]
