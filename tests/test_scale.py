"""Steps whose branches must agree, and searches that must not cost more than their input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sieveline.operators import ordering


def _numbers(spark, n=40_000):
    return spark.range(n).select(
        F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("s"),
        (F.xxhash64("id") % 1_000_003).cast("double").alias("v"),
    )


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_order_statistics_rest_on_one_sketch(spark):
    """A sketch that each branch makes for itself may differ from the others'."""
    df = _numbers(spark)
    reuse = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        found = ordering.quantiles(df, ["s"], "v", [0.1, 0.5, 0.9])
        assert _plan(found).count("percentile_approx") == 1
        got = {r["s"]: [r["q0"], r["q1"], r["q2"]] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
    for s, part in df.toPandas().groupby("s"):
        assert np.allclose(got[s], np.quantile(part["v"], [0.1, 0.5, 0.9]))


def test_running_totals_rest_on_one_sketch(spark):
    cum = ordering.cumulative(_numbers(spark), ["s"], "v", {"n": F.lit(1)}, settle=True)
    assert "percentile_approx" not in _plan(cum)
    for _, part in cum.toPandas().sort_values("v").groupby("s"):
        assert (part["before_n"].to_numpy() == np.cumsum(part["n"]) - part["n"]).all()
        assert (part["total_n"] == 20_000).all()


def _plain_auroc(y, s):
    up, down = s[y][:, None], s[~y][None, :]
    return ((up > down) + 0.5 * (up == down)).mean()


def test_aurocs_of_many_models_make_scores_twice(spark, monkeypatch):
    """Many buckets, ties and rows without a number; every row is scored for the sketch and for the blocks only."""
    from sieveline.operators import evaluate, linear

    monkeypatch.setattr(evaluate, "_GROUP", 100)
    monkeypatch.setattr(evaluate, "_GATHER", 1000)
    rng = np.random.default_rng(5)
    x, fold = np.round(rng.normal(size=(1500, 2)), 2), np.arange(1500) % 3
    y = x[:, 0] + rng.normal(size=1500) > 0
    rows = [(float(a), float(b), int(c), int(f)) for (a, b), c, f in zip(x, y, fold)]
    rows += [(None, 1.0, 1, 0), (float("nan"), 1.0, 0, 1)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    schema = "a double, b double, y int, f int"
    df = spark.createDataFrame(rows, schema).repartition(5).mapInArrow(counted, schema)
    specs = [linear.LogisticSpec([0, 1], 1.0, f) for f in (0, 1, 2, None)] + [linear.LogisticSpec([], 1.0, 0)]
    models = [(0.5, np.array([1.0, k])) for k in (0.0, 0.5, 1.0, -1.0)] + [(0.1, np.zeros(0))]
    got = linear.cv_scores(df, ["a", "b"], "y", models, specs, "f", "classification")
    assert read.value == 2 * len(rows)
    for i, (s, (b, w)) in enumerate(zip(specs, models)):
        at = np.ones(1500, bool) if s.hold_out is None else fold == s.hold_out
        full = np.zeros(2)
        full[s.subset] = w
        assert abs(got[i] - _plain_auroc(y[at], x[at] @ full + b)) < 1e-12


def test_strengths_of_a_lasso_share_their_passes(spark, monkeypatch):
    from sieveline.operators import linear, sparse

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y)], "a double, b double, c double, y int")
    passes, plain = [], sparse.sum_blocks
    monkeypatch.setattr(sparse, "sum_blocks", lambda *a, **k: passes.append(1) or plain(*a, **k))
    strengths = [0.01, 0.05, 0.1]
    alone = [linear.lasso_coefficients(df, ["a", "b", "c"], "y", "classification", s) for s in strengths]
    each = len(passes)
    together = linear.lasso_path(df, ["a", "b", "c"], "y", "classification", strengths)
    assert len(passes) - each < each
    assert np.allclose([[w for _, w in m] for m in alone], [[w for _, w in m] for m in together], atol=1e-6)


def test_kmeans_of_all_sizes_share_their_passes(spark, monkeypatch):
    """As Spark ML from the same start, with no more passes than the slowest size takes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from sieveline.operators import importance

    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)) + 4 * rng.integers(0, 4, size=(600, 1))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(3).persist()
    passes, plain = [], importance.sum_blocks
    monkeypatch.setattr(importance, "sum_blocks", lambda *a, **k: passes.append(1) or plain(*a, **k))
    curve, _, _ = importance.kmeans_sweep(df, ["a", "b", "c"], range(2, 7))
    got = {r["k"]: r["inertia"] for r in curve.collect()}
    vec = df.select(array_to_vector(F.array("a", "b", "c")).alias("features")).persist()
    most = 0
    for k in range(2, 7):
        summary = KMeans(k=k, seed=42, maxIter=300, initMode="k-means||").fit(vec).summary
        assert abs(got[k] - summary.trainingCost) < 1e-6 * got[k]
        most = max(most, summary.numIter)
    assert len(passes) == most


def _planted(spark, n=600, d=6, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x @ np.array([1.0, 0.6, -0.4, 0.2, 0.1, 0.05][:d]) + rng.normal(size=n) > 0).astype(int)
    cols = [f"c{j}" for j in range(d)]
    rows = [(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))]
    schema = "id long, " + ", ".join(f"{c} double" for c in cols) + ", y int"
    return spark.createDataFrame(rows, schema).repartition(3), cols, schema


def _one_by_one(df, cols):
    from sieveline.operators import linear

    left, dropped = list(range(len(cols))), []
    while len(left) > 1:
        ((_, w),) = linear.logistic_fit_many(df, cols, "y", [linear.LogisticSpec(left, 1.0)])
        dropped.append(left.pop(int(np.argmin(w**2))))
    return [cols[j] for j in [*left, *dropped[::-1]]]


def test_eliminations_share_their_passes(spark, monkeypatch):
    from sieveline.operators import linear

    df, cols, _ = _planted(spark)
    df = df.persist()
    want = _one_by_one(df, cols)
    passes, plain = [], linear.sum_blocks
    monkeypatch.setattr(linear, "sum_blocks", lambda *a, **k: passes.append(1) or plain(*a, **k))
    assert linear.rfe_order(df, cols, "y", "classification") == want
    assert len(passes) <= 10


def test_elimination_goes_on_where_another_column_goes(spark, monkeypatch):
    """What is foreseen is never what decides."""
    from sieveline.operators import linear

    df, cols, _ = _planted(spark)
    df = df.persist()
    want = _one_by_one(df, cols)
    weakest, calls = linear._weakest, []
    monkeypatch.setattr(linear, "_ahead", lambda left, near, bend: calls.append(1) or [(left, near), (left[1:], near[[0, *range(2, len(near))]])])
    assert weakest(np.array([0.5, -0.5 * (1 + 1e-12), 0.7])) == 0
    assert linear.rfe_order(df, cols, "y", "classification") == want
    assert len(calls) > 1
    # labels besides 0 and 1 have no Gram matrices by class
    odd = df.withColumn("y", F.col("y") * F.lit(0.9))
    assert set(linear.rfe_order(odd, cols, "y", "classification")) == set(cols)


def test_scaled_fits_and_warm_starts_agree_with_plain_ones(spark, monkeypatch):
    """Specs of several scalings and subsets, in blocks of one spec, against fits of scaled columns one by one."""
    from sieveline.operators import linear

    df, cols, _ = _planted(spark)
    df = df.withColumn("f", (F.col("id") % 3).cast("int")).withColumn("c1", F.col("c1") * 50 + 1000).persist()
    specs = []
    for hold in (None, 0, 1):
        for subset in ([0, 1, 2], [1, 4], []):
            center = np.array([0.1, 1000.0 + 5 * (hold or 0), 0.0, 0.0, -0.2, 0.0])[subset]
            scale = np.array([2.0, 50.0 + (hold or 0), 1.0, 1.0, 0.5, 1.0])[subset]
            specs.append(linear.LogisticSpec(subset, 0.5, hold, center, scale))
    monkeypatch.setattr(linear, "_TILE", 8)
    monkeypatch.setattr(linear, "_TOGETHER", 2)
    counts = {}
    found = [(b[0], b[1:]) for b, _ in linear.logistic_fit_near(df, cols, "y", specs, "f", counts=counts)]
    assert sum(counts.values()) == 600 and len(counts) == 6
    for s, (b, w) in zip(specs, found):
        part = df if s.hold_out is None else df.filter(F.col("f") != s.hold_out)
        named = [cols[j] for j in s.subset]
        own = part.select("y", F.lit(0.0).alias("_0"), *[((F.col(c) - float(m)) / float(d)).alias(c) for c, m, d in zip(named, s.center, s.scale)])
        ((b1, w1),) = linear.logistic_fit_many(own, ["_0", *named], "y", [linear.LogisticSpec(range(1, 1 + len(named)), 0.5)])
        assert abs(b - b1) < 1e-6 and np.allclose(w, w1, atol=1e-6)
    start = [np.concatenate([[b], w]) + 0.01 for b, w in found]
    again = [(b[0], b[1:]) for b, _ in linear.logistic_fit_near(df, cols, "y", specs, "f", start=start, counts=counts)]
    for (b, w), (b1, w1) in zip(found, again):
        assert abs(b - b1) < 1e-6 and np.allclose(w, w1, atol=1e-6)


def test_short_score_series_need_no_sketch(spark):
    from sieveline.operators import linear

    df, cols, schema = _planted(spark)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = df.mapInArrow(counted, schema)
    model, spec = (0.1, np.array([1.0, -0.5])), linear.LogisticSpec([0, 1])
    long = linear.cv_scores(df, cols, "y", [model], [spec], None, "classification")
    assert read.value == 2 * 600
    short = linear.cv_scores(df, cols, "y", [model], [spec], None, "classification", 600)
    assert read.value == 3 * 600
    assert long[0] == short[0]


def test_comparison_of_selections_reads_its_source_once(spark):
    """For all seeds, methods and ratios."""
    from sieveline.plans.experiments import compare_selection

    df, cols, schema = _planted(spark, 300)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    source = df.mapInArrow(counted, schema)
    out = compare_selection(source, "id", "y", cols, [], "classification", ["filter-mi", "mrmr", "random-feature", "rfe"], [0.5, 1.0], [1, 2])
    got = {(r["fs_method"], r["ratio"]): r for r in out.collect()}
    assert read.value == 300
    assert len(got) == 8
    assert {(m, r["frac"]) for (m, ratio), r in got.items() if ratio == 0.5} == {(m, 0.5) for m in ("filter-mi", "mrmr", "random-feature", "rfe")}
    assert len({round(r["mean"], 9) for (_, ratio), r in got.items() if ratio == 1.0}) == 1
    assert all(0.5 < r["mean"] < 1 for (_, ratio), r in got.items() if ratio == 1.0)


def test_mutual_information_reads_its_counts_once(spark):
    from sieveline.operators import stats

    rows = [("f", "a", 1, 5), ("f", None, 1, 3), ("f", "a", 0, 2), ("f", None, 0, 7), ("g", "z", 0, 7), ("g", "z", None, 7)]
    counts = spark.createDataFrame(rows, "feature string, x string, y int, n long")
    out = stats.mutual_info_counts(counts)
    assert _plan(out).count("LogicalRDD") == 1
    n = np.array([[5, 2], [3, 7]]) / 17
    want = float((n * np.log(n / n.sum(0) / n.sum(1)[:, None])).sum())
    got = {r["feature"]: r["score"] for r in out.collect()}
    assert abs(got["f"] - want) < 1e-12 and abs(got["g"]) < 1e-12
