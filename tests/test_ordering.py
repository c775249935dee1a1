"""Exact order operators against numpy, with skew, ties and forced deep paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions.scalars import stable_hash
from sieveline.operators import ordering as o
from sieveline.operators import split as sp


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    n = 3000
    v = np.round(rng.exponential(5, n), 2)
    v[: n // 3] = 1.25  # one value holds a third of all rows
    g = np.where(rng.random(n) < 0.8, "hot", "cold")
    return spark.createDataFrame([(str(a), float(b)) for a, b in zip(g, v)], "g string, v double"), g, v


@pytest.mark.parametrize("buckets", [None, 8, 300])
def test_cumulative_counts(skewed, buckets):
    df, g, v = skewed
    rows = o.cumulative(df, ["g"], "v", {"n": F.lit(1)}, buckets).collect()
    for name in ("hot", "cold"):
        part = v[g == name]
        mine = {r["v"]: r for r in rows if r["g"] == name}
        assert set(mine) == set(part)
        for value, r in mine.items():
            assert r["before_n"] == (part < value).sum()
            assert r["n"] == (part == value).sum()
            assert r["total_n"] == len(part)


def test_quantiles_interpolate(skewed):
    df, g, v = skewed
    probs = [0.0, 0.1, 0.5, 0.95, 0.998, 1.0]
    for r in o.quantiles(df, ["g"], "v", probs).collect():
        want = np.quantile(v[g == r["g"]], probs)
        assert np.allclose([r[f"q{i}"] for i in range(len(probs))], want)


@pytest.mark.parametrize("series", [None, 2])
def test_quantiles_of_a_long_series(spark, series):
    """With brackets joined and, where the number of series is known, broadcast."""
    rng = np.random.default_rng(4)
    v = np.concatenate([np.round(rng.normal(size=20_000), 3), np.full(9_000, 0.125), [np.nan]])
    df = spark.createDataFrame([(int(i % 2 == 0 or i > 25_000), float(x)) for i, x in enumerate(v)], "g int, v double")
    g = np.array([int(i % 2 == 0 or i > 25_000) for i in range(len(v))])
    probs = [0.0, 0.05, 0.3, 0.5, 0.73, 0.999, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(len(probs))] for r in o.quantiles(df, ["g"], "v", probs, series).collect()}
    for k in (0, 1):
        part = v[(g == k) & ~np.isnan(v)]
        assert np.allclose(got[k], np.quantile(part, probs), atol=1e-12)
    edges = o.equal_depth_edges(df, [], "v", 10).first()["edges"]
    clean = np.sort(v[~np.isnan(v)])
    assert edges == [clean[j * len(clean) // 10] for j in range(1, 10)]


def test_row_positions_are_a_permutation(spark):
    df = spark.range(1000).withColumn("r", (F.col("id") % 3))
    out = o.row_positions(df, stable_hash("x", "id"), "id", "p", by=["r"]).collect()
    for r in range(3):
        assert sorted(x["p"] for x in out if x["r"] == r) == list(range(len([x for x in out if x["r"] == r])))


@pytest.mark.parametrize("bits", [20, 2])
@pytest.mark.parametrize("literals", [256, 0])
def test_split_sizes_are_exact(spark, monkeypatch, bits, literals):
    monkeypatch.setattr(o, "_level_bits", lambda *_: bits)  # 2: many rows in a bucket
    monkeypatch.setattr(o, "_INLINE_CUTS", literals)  # 0: cuts are a table
    df = spark.range(5003).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    out = sp.split(df, "id", "y", seed=3).groupBy("y", "split").count().collect()
    got = {(r["y"], r["split"]): r["count"] for r in out}
    for y, n in ((1, 1001), (0, 4002)):
        test = -(-n // 5)
        val = -(-(n - test) // 5)
        assert (got[(y, "test")], got[(y, "val")], got[(y, "train")]) == (test, val, n - test - val)


def test_test_part_is_the_same_for_every_seed(spark):
    df = spark.range(500)
    ids = [{r["id"] for r in sp.split(df, "id", seed=s).filter("split = 'test'").collect()} for s in (1, 2)]
    assert ids[0] == ids[1]


def test_many_strata_use_a_table_of_cuts(spark):
    df = spark.range(2000).withColumn("y", F.col("id") % 100)
    out = sp.folds(df, "id", 4, "y").groupBy("y", "fold").count().collect()
    assert len(out) == 400 and {r["count"] for r in out} == {5}


def test_block_folds_are_contiguous(spark):
    df = spark.range(0, 1003).withColumn("id", F.col("id") * 7 + 5)
    rows = sorted((r["id"], r["fold"]) for r in sp.block_folds(df, "id", 5).collect())
    folds = [f for _, f in rows]
    assert folds == sorted(folds)
    assert [folds.count(i) for i in range(5)] == [201, 201, 201, 200, 200]


def test_repeated_key_is_cut_by_the_tie_break(spark, monkeypatch):
    df = spark.range(100).withColumn("k", F.lit(7).cast("bigint"))
    cuts = o.exact_cuts(df, [], F.col("k"), "id", lambda n: F.array(F.lit(30).cast("long")), bits=4)
    assert cuts == {(): [(7, 30)]}


def test_equal_and_outer_ranks(spark):
    df = spark.range(10).withColumn("k", F.col("id"))
    ranks = lambda n: F.array(*[F.lit(r).cast("long") for r in (0, 4, 4, 10)])
    cuts = o.exact_cuts(df, [], F.col("k"), "id", ranks, bits=8)
    assert cuts == {(): [(0, 0), (4, 4), (4, 4)]}
    rows = o.with_cut_index(df, [], cuts, "k", "id", "at").orderBy("id").collect()
    assert [r["at"] for r in rows] == [1] * 4 + [3] * 6


def test_many_series(spark):
    """More series than any table on the driver would hold, with missing ones among them."""
    df = spark.range(90_000).select((F.col("id") % 30_000).alias("g"), (F.col("id") * 7 % 90_001).cast("double").alias("v"))
    df = df.unionByName(spark.range(30_000, 30_010).select(F.col("id").alias("g"), F.lit(float("nan")).alias("v")))
    out = o.quantiles(df, ["g"], "v", [0.0, 0.5, 1.0]).join(df.groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("a")), "g")
    wrong = out.filter((F.col("q0") != F.col("a")[0]) | (F.col("q1") != F.col("a")[1]) | (F.col("q2") != F.col("a")[2]))
    assert out.count() == 30_000 and wrong.count() == 0
    assert o.cumulative(df, ["g"], "v", {"n": F.lit(1)}, buckets=8).filter("total_n = 3").count() == 90_000


def test_stratified_folds_over_many_strata(spark):
    df = spark.range(200_000).select("id", (F.col("id") % 50_000).alias("y"))
    sizes = sp.folds(df, "id", 2, "y").groupBy("y", "fold").count()
    assert sizes.filter("count <> 2").count() == 0 and sizes.count() == 100_000


def test_strata_with_nulls(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 6).alias("y"))
    for literals in (256, 0):
        o._INLINE_CUTS, old = literals, o._INLINE_CUTS
        try:
            got = {(r["y"], r["split"]): r["count"] for r in sp.split(df, "id", "y").groupBy("y", "split").count().collect()}
        finally:
            o._INLINE_CUTS = old
        assert got[None, "test"] == 100 and got[None, "val"] == 80 and sum(got.values()) == 1000


def test_nothing_runs_while_a_plan_is_built(spark):
    """Sketches and brackets are part of the plan."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    o.cumulative(df, ["g"], "v", {"n": F.lit(1)})
    o.quantiles(df, ["g"], "v", [0.5])
    o.equal_depth_edges(df, ["g"], "v", 4)
    assert set(tracker.getJobIdsForGroup(None)) == before


def test_balance_and_cap(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    assert {r["y"]: r["count"] for r in sp.balance(df, "id", "y").groupBy("y").count().collect()} == {0: 100, 1: 100}
    assert {r["y"]: r["count"] for r in sp.stratified_cap(df, "id", "y", 105).groupBy("y").count().collect()} == {0: 94, 1: 10}


def test_order_statistics_read_their_rows_few_times(spark):
    """For the sketch and for the rows inside brackets, and not again for the size of a series."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    n = 40_000
    source = spark.range(n).selectExpr("id % 2 AS s", "double((id * 7919) % 40009) AS v").mapInArrow(counted, "s long, v double")
    got = {r["s"]: r for r in o.quantiles(source, ["s"], "v", [0.25, 0.5, 0.9], series=2).collect()}
    assert read.value <= 3 * n
    for s in (0, 1):
        v = np.array([(i * 7919) % 40009 for i in range(s, n, 2)], dtype=float)
        assert [got[s][f"q{i}"] for i in range(3)] == pytest.approx(np.quantile(v, [0.25, 0.5, 0.9]).tolist(), abs=1e-9)


def test_rows_of_few_columns_are_not_joined_by_column(spark):
    """All rows of a column would be one key of the join."""
    import __spark_entry__

    ranks = __spark_entry__.queries()["win2_mid_ranks"](spark, "/root/testdata/sf0.001")
    plan = ranks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == plan.count("Join Inner")
