"""Missing values, empty selections, many strata and shared folders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import select as sel
from sieveline.operators import stats
from sieveline.operators.linear import ridge_fit, sum_blocks
from sieveline.operators.split import split
from sieveline.plans.experiments import compare_selection
from sieveline.runtime import NoSharedFolder, shared_dir


@pytest.fixture(scope="module")
def gappy(spark):
    draw = np.random.default_rng(0)
    a = draw.normal(size=500)
    b, c = a + 0.01 * draw.normal(size=500), draw.normal(size=500)
    y = (a + c + 0.2 * draw.normal(size=500) > 0).astype(float)
    rows = [(i, float(a[i]), None if i % 50 == 7 else float(b[i]), float("nan") if i == 3 else float(c[i]), float(y[i])) for i in range(500)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double"), (a, b, c, y)


def test_a_gap_touches_only_its_own_pairs(gappy):
    df, (a, b, c, _) = gappy
    got = {(r.feature_a, r.feature_b): r["corr"] for r in stats.correlations(df, ["a", "b", "c"]).collect()}
    i = np.arange(500)
    for pair, x, y, keep in ((("a", "b"), a, b, i % 50 != 7), (("a", "c"), a, c, i != 3), (("b", "c"), b, c, (i % 50 != 7) & (i != 3))):
        assert got[pair] == pytest.approx(np.corrcoef(x[keep], y[keep])[0, 1], abs=1e-9)


def test_mrmr_ranks_a_redundant_twin_last(gappy):
    df, _ = gappy
    order = [r.feature for r in sel.select_features(df, ["a", "b", "c"], "y", "mrmr", topk=3).orderBy("pos").collect()]
    assert order.index("b") == 2 or order.index("a") == 2


def test_fits_use_complete_rows(gappy):
    df, _ = gappy
    whole = df.filter("b is not null and not isnan(c)")
    assert np.allclose(ridge_fit(df, ["a", "b", "c"], "y")[1], ridge_fit(whole, ["a", "b", "c"], "y")[1])


def test_sums_in_groups_of_tasks(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x")).repartition(200)
    got = sum_blocks(df, ["x"], None, lambda x, y, w, f: iter([(0, np.array([x.sum(), len(x)]))]))
    assert got[0].tolist() == pytest.approx([499500.0, 1000.0])


def test_random_concepts_keep_all_their_columns(spark):
    df = spark.range(1)
    cols = ["x_a", "x_b", "num", "z_1", "z_2", "z_3"]
    for seed in range(4):
        names = [r.feature for r in sel.select_features(df, cols, "y", "random-concept", ratio=0.67, seed=seed).collect()]
        picked = {n.split("_")[0] for n in names}
        assert len(picked) == 2 and names == [c for c in cols if c.split("_")[0] in picked]


def test_every_lasso_strength_is_a_row(gappy):
    df, _ = gappy
    whole = df.filter("b is not null and not isnan(c)").withColumn("cat", F.lit("k"))
    out = compare_selection(whole, "id", "y", ["a", "b", "c"], [], "classification", ["lasso"], [], [1], strengths=[1e-5, 0.01, 1.0]).collect()
    assert sorted(r.ratio for r in out) == [1e-5, 0.01, 1.0]
    assert next(r for r in out if r.ratio == 1e-5).frac == 0.0


def test_split_over_many_strata(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 3000).alias("stratum"))
    sizes = split(df, "id", "stratum").groupBy("stratum", "split").count().groupBy("split").agg(F.min("count").alias("low"), F.max("count").alias("high")).collect()
    assert {r.split for r in sizes} >= {"train", "test"} and all(r.low == r.high for r in sizes)


class _Cluster:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


class _Session:
    sparkContext = _Cluster()

    class conf:
        @staticmethod
        def get(_key, default):
            return default


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(NoSharedFolder):
        shared_dir(_Session())
