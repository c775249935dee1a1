"""Statistics against direct numpy formulas."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.operators import neighbors, ranks, stats
from sieveline.operators.evaluate import auroc, average_precision


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 400
    y = rng.integers(0, 3, n)
    a = np.round(rng.normal(y, 1.0), 1)
    b = np.round(rng.normal(0, 1.0, n), 2)
    rows = [(int(c), float(p), float(q)) for c, p, q in zip(y, a, b)]
    return spark.createDataFrame(rows, "y int, a double, b double"), y, a, b


def _digamma(n):
    return sum(1 / i for i in range(1, int(n))) - 0.5772156649015329


def _knn_mi(x, y, k=3):
    n, psi_k, psi_c, psi_m = 0, [], [], []
    keep = [c for c in np.unique(y) if (y == c).sum() > 1]
    pool = x[np.isin(y, keep)]
    for xi, yi in zip(x, y):
        if yi not in keep:
            continue
        same = np.sort(np.abs(x[y == yi] - xi))
        kk = min(k, len(same) - 1)
        r = same[kk]
        m = (pool == xi).sum() if r == 0 else ((pool < xi + r) & (pool > xi - r)).sum()
        n += 1
        psi_k.append(_digamma(kk))
        psi_c.append(_digamma(len(same)))
        psi_m.append(_digamma(m))
    return max(0.0, _digamma(n) + np.mean(psi_k) - np.mean(psi_c) - np.mean(psi_m))


@pytest.mark.parametrize("block", [4096, 7])
def test_knn_mutual_information(table, block):
    df, y, a, b = table
    got = {r["feature"]: r["score"] for r in stats.mutual_info_knn(df, ["a", "b"], "y", block=block).collect()}
    assert got["a"] == pytest.approx(_knn_mi(a, y), abs=1e-9)
    assert got["b"] == pytest.approx(_knn_mi(b, y), abs=1e-9)


def test_mutual_information_of_a_constant_is_zero(spark, table):
    df = table[0].withColumn("c", F.lit("x"))
    assert stats.mutual_info_discrete(df, ["c"], "y").first()["score"] == pytest.approx(0, abs=1e-12)
    own = stats.mutual_info_discrete(df, ["y"], "y").first()["score"]
    p = np.bincount(table[1]) / len(table[1])
    assert own == pytest.approx(-(p * np.log(p)).sum())


def test_gram_per_fold(spark, table):
    df, y, a, b = table
    grams = stats.gram(df.withColumn("f", F.col("y") % 2), ["a", "b"], fold="f")
    for f in (0, 1):
        z = np.stack([np.ones(len(a)), a, b], 1)[y % 2 == f]
        assert np.allclose(grams[f], z.T @ z)


def test_missing_values_are_skipped(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    r = stats.moments(df, ["x"]).first()
    assert (r["n"], r["mean"], r["sd"]) == (2, 2.0, 1.0)


@pytest.mark.parametrize("block", [4096, 40])
def test_cosine_neighbours(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(220, 8)) + np.repeat(rng.normal(size=(4, 8)) * 4, 55, axis=0)
    x[10] = x[11]  # an exact copy
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    got = {}
    for r in neighbors.cosine_knn(df, "id", "v", 5, block=block).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 9)
    np.fill_diagonal(sim, -np.inf)
    for i in range(len(x)):
        want = sorted(range(len(x)), key=lambda j: (-sim[i, j], j))[:5]
        assert [d for _, d in sorted(got[i])] == want


def _tau(x, y):
    s = ux = uy = 0
    for (a, b), (c, d) in itertools.combinations(zip(x, y), 2):
        s += np.sign(a - c) * np.sign(b - d)
        ux += a != c
        uy += b != d
    return s / math.sqrt(ux * uy) if ux and uy else None


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(-3, 3)), min_size=2, max_size=40))
def test_kendall_tau(spark, pairs):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "x double, y double")
    got = ranks.kendall_tau(df, "x", "y").first()["tau"]
    want = _tau(*zip(*pairs))
    assert got is None if want is None else got == pytest.approx(want)
    if want is not None:
        assert -1 <= got <= 1
        assert ranks.kendall_tau(df, "y", "x").first()["tau"] == pytest.approx(got)
        assert ranks.kendall_tau(df, "x", "x").first()["tau"] == pytest.approx(1.0)


def test_ranking_metrics_with_ties(spark):
    y = [1, 0, 1, 0, 1, 0, 0]
    s = [0.9, 0.9, 0.8, 0.7, 0.5, 0.5, 0.1]
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    pos = [b for a, b in zip(y, s) if a]
    neg = [b for a, b in zip(y, s) if not a]
    pairs = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    assert auroc(df, "y", "s").first()["auroc"] == pytest.approx(pairs / 12)
    # thresholds 0.9 (1 of 2), 0.8 (2 of 3), 0.7, 0.5 (3 of 6)
    assert average_precision(df, "y", "s").first()["auprc"] == pytest.approx((1 / 2 + 2 / 3 + 3 / 6) / 3)


def test_cosine_neighbours_stream_past_groups(spark):
    """Copies fill more than one group, ties go to the smaller id, and no pairs of blocks are shuffled."""
    rng = np.random.default_rng(5)
    x = np.vstack([np.ones((60, 6)), rng.normal(size=(140, 6))])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>")
    found = neighbors.cosine_knn(df, "id", "v", 4, block=16)
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 9)
    got = {(r["src"], r["rank"]): r["dst"] for r in found.collect()}
    assert len(got) == 4 * len(x)
    for i, src in enumerate(ids):
        best = sorted((-sim[i, j], int(dst)) for j, dst in enumerate(ids) if dst != src)[:4]
        assert [got[src, n + 1] for n in range(4)] == [dst for _, dst in best]
