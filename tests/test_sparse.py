"""Sparse paths: optimality conditions in numpy, wide tables, awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import linear, sparse, stats

COLS = [f"c{i}" for i in range(12)]


def frame(spark, x, y, cols):
    return spark.createDataFrame([(float(t), [float(v) for v in r]) for r, t in zip(x, y, strict=True)], "y double, x array<double>").select("y", *[F.col("x")[i].alias(c) for i, c in enumerate(cols)]).repartition(3).cache()


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(9)
    x = draw.normal(size=(500, 12)) * np.logspace(-1, 2, 12) + np.linspace(-50, 50, 12)
    x[:, 3] = x[:, 2] + 0.01 * draw.normal(size=500)
    z = (x - x.mean(0)) / x.std(0) @ np.array([2, 0, 1, 0, 0, -1.5, 0, 0, 0.5, 0, 0, 0])
    return x, z + 0.3 * draw.normal(size=500), (z + draw.logistic(size=500) > 0.8).astype(float)


def violation(x, y, b, w, lam, groups, task, sizes, weight=None):
    m = x @ w + b
    c = np.ones(len(y)) if weight is None else weight
    r = c * ((1 / (1 + np.exp(-m)) if task == "classification" else m) - y)
    grad, worst = x.T @ r / len(y), abs(r.mean())
    for g in set(groups):
        idx = np.flatnonzero(np.array(groups) == g)
        pen = lam / (np.sqrt(len(idx)) if sizes else 1)
        size = np.linalg.norm(w[idx])
        worst = max(worst, np.linalg.norm(grad[idx] + pen * w[idx] / size) if size else np.linalg.norm(grad[idx]) - pen)
    return worst


@pytest.mark.parametrize("task", ["classification", "regression"])
@pytest.mark.parametrize("groups", [None, [0, 1, 0, 2, 3, 3, 3, 4, 5, 6, 6, 7]])
def test_every_penalty_is_optimal(spark, data, task, groups):
    x, z, y = data
    label = y if task == "classification" else z
    df = frame(spark, x, label, COLS)
    penalties = [0.01, 5.0, 0.3, 0.05, 1.0, 0.0]
    found = sparse.sparse_path(df, COLS, "y", task, penalties, groups, sizes=groups is not None)
    scale = np.abs(x.T @ (label - label.mean())).max() / len(x)
    for lam, (b, w) in zip(penalties, found, strict=True):
        assert violation(x, label, b, w, lam, groups or list(range(12)), task, groups is not None) < 1e-7 * max(1, scale)
    assert not found[1][1].all() and found[5][1].all()


def test_the_route_does_not_matter(spark, data, monkeypatch):
    x, _, y = data
    df = frame(spark, x, y, COLS)
    penalties = [1.0, 0.2, 0.02]
    a = sparse.sparse_path(df, COLS, "y", "classification", penalties, balanced=True)
    monkeypatch.setattr(sparse, "_PASS_NUMBERS", 1)
    b = sparse.sparse_path(df, COLS, "y", "classification", penalties[::-1], balanced=True)[::-1]
    for (i, v), (j, w) in zip(a, b, strict=True):
        assert np.allclose(x @ v + i, x @ w + j, atol=1e-3) and ((v != 0) == (w != 0)).all()  # two columns are nearly equal


def test_two_thousand_columns(spark):
    draw = np.random.default_rng(1)
    n, d = 250, 2000
    x = draw.normal(size=(n, d))
    y = x[:, [3, 500, 1999]] @ [3.0, -2.0, 1.5] + 0.1 * draw.normal(size=n)
    cols = [f"v{i}" for i in range(d)]
    df = frame(spark, x, y, cols)
    for lam, (b, w) in zip([0.5, 0.2], sparse.sparse_path(df, cols, "y", "regression", [0.5, 0.2]), strict=True):
        assert violation(x, y, b, w, lam, list(range(d)), "regression", False) < 1e-7 * 10
        assert set(np.flatnonzero(np.abs(w) > 0.5)) == {3, 500, 1999} and (w != 0).sum() < 60


def test_screening_brings_back_columns():
    """A column that the strong rule left out enters when its conditions fail."""
    fit = sparse._Fit(np.array([0.1, 0.1]), np.zeros(3), [])
    sparse._advance(fit, 1.0, np.array([0.0, 0.5, 0.05]), np.array([0]), np.ones((1, 1)), [np.array([1]), np.array([2])], 1e-9)
    assert fit.play == {0} and not fit.done


def test_rows_with_gaps_and_no_rows(spark, data):
    x, z, _ = data
    df = frame(spark, x, z, COLS)
    gappy = df.unionByName(df.limit(20).withColumn("c1", F.lit(float("nan"))))
    a, b = (sparse.sparse_path(t, COLS, "y", "regression", [0.3])[0] for t in (df, gappy))
    assert np.allclose(a[1], b[1])
    assert sparse.sparse_path(df.limit(0), COLS, "y", "regression", [0.3, 0.1])[1][1].tolist() == [0.0] * 12


def test_unsettled_penalties_are_an_error(spark, data):
    x, _, y = data
    with pytest.raises(sparse.NotSettled):
        sparse.sparse_path(frame(spark, x, y, COLS), COLS, "y", "classification", [0.01], passes=1)


def test_sums_travel_in_tiles(spark):
    """At 2,042 columns no row of a task's sums exceeds a megabyte, and the sums are the same."""
    cols = [f"c{i}" for i in range(300)]
    draw = np.random.default_rng(0)
    x = draw.normal(size=(64, 300)).round(3)
    df = frame(spark, x, x[:, 0], cols)
    assert linear._TILE * 8 < 1 << 20
    old, linear._TILE = linear._TILE, 1000
    try:
        g = stats.gram(df, cols)[0]
        corr = stats.pair_correlations(df, cols)
    finally:
        linear._TILE = old
    z = np.hstack([np.ones((64, 1)), x])
    assert np.allclose(g, z.T @ z) and np.allclose(corr, np.corrcoef(x.T))
