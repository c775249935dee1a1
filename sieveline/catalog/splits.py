"""Queries: splits, folds, samples (SMP1-SMP10) and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.catalog import query, rounded, table
from sieveline.catalog.fixtures import CUST, LINE, d6, duck_hash, fx_cust, fx_line
from sieveline.operators import split as sp
from sieveline.operators.encode import MixedEncoder
from sieveline.operators.select import by_ratio
from sieveline.operators.stats import fisher
from sieveline.runtime import cut_lineage, spread


def _duck_share(rel: str, seed, share: str, by: str | None, flag: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT *, row_number() OVER ({part} ORDER BY {duck_hash(seed, 'row_id')}, row_id)
      <= ceil(round(count(*) OVER ({part}) * {share}::DOUBLE, 9)) AS {flag} FROM {rel}"""


def _duck_split(rel_sql: str, by: str | None, seed: int = 1) -> str:
    return f"""
WITH fx AS ({rel_sql}), t AS ({_duck_share('fx', 42, '0.2', by, 'is_test')}),
v AS ({_duck_share('(SELECT * FROM t WHERE NOT is_test)', f'val{seed}', '0.2', by, 'is_val')}),
sp AS (SELECT * EXCLUDE (is_test, is_val), CASE WHEN is_val THEN 'val' ELSE 'train' END AS split FROM v
       UNION ALL SELECT * EXCLUDE (is_test), 'test' AS split FROM t WHERE is_test)
"""


@query("smp1_random_split", _duck_split(LINE, None) + "SELECT row_id, split FROM sp")
def smp1(spark, sf):
    return sp.split(fx_line(spark, sf).select("row_id"), "row_id")


@query("smp2_stratified_split", _duck_split(LINE, "label") + "SELECT row_id, label, split FROM sp")
def smp2(spark, sf):
    return sp.split(fx_line(spark, sf).select("row_id", "label"), "row_id", "label")


@query("smp2_split_sizes_over_seeds", " UNION ALL ".join(
    f"(SELECT {s} AS seed, label, split, count(*) AS n FROM ({_duck_split(CUST, 'label', s)} SELECT * FROM sp) GROUP BY ALL)"
    for s in range(1, 6)))
def smp2_sizes(spark, sf):
    df = fx_cust(spark, sf).select("row_id", "label")
    out = None
    for s in range(1, 6):
        part = sp.split(df, "row_id", "label", seed=s).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))
        part = part.select(F.lit(s).alias("seed"), "label", "split", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("smp3_balanced_classes", f"""
WITH fx AS ({LINE}), r AS (
  SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {duck_hash('bal42', 'row_id')}, row_id) AS rn FROM fx)
SELECT row_id, label FROM r WHERE label = 1 OR rn <= (SELECT count(*) FROM fx WHERE label = 1)""")
def smp3(spark, sf):
    return sp.balance(fx_line(spark, sf).select("row_id", "label"), "row_id", "label")


@query("smp4_stratified_cap", f"""
WITH fx AS ({LINE}), r AS (
  SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {duck_hash('cap1', 'row_id')}, row_id) AS rn,
         count(*) OVER (PARTITION BY label) AS nc, count(*) OVER () AS n FROM fx)
SELECT row_id, label FROM r WHERE n <= 50000 OR rn <= (50000 * nc) // n""")
def smp4(spark, sf):
    return sp.stratified_cap(fx_line(spark, sf).select("row_id", "label"), "row_id", "label", 50_000)


_NAMES = "SELECT DISTINCT p_name AS concept FROM part"


@query("smp5_random_concepts", f"""
WITH c AS ({_NAMES}) SELECT concept FROM c
QUALIFY row_number() OVER (ORDER BY {duck_hash(1, 'concept')}, concept) <= floor(0.3::DOUBLE * count(*) OVER ())""")
def smp5(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("concept")).distinct()
    return sp.sample_names(names, "concept", 0.3, seed=1)


_FEATURES = "SELECT DISTINCT concat_ws('_', p_name, p_type) AS feature FROM part"


@query("smp6_random_features", f"""
WITH c AS ({_FEATURES}) SELECT feature FROM c
QUALIFY row_number() OVER (ORDER BY {duck_hash(2, 'feature')}, feature) <= floor(0.5::DOUBLE * count(*) OVER ())""")
def smp6(spark, sf):
    names = table(spark, sf, "part").select(F.concat_ws("_", "p_name", "p_type").alias("feature")).distinct()
    return sp.sample_names(names, "feature", 0.5, seed=2)


@query("smp7_stratified_folds", f"""
WITH fx AS ({LINE})
SELECT row_id, label, (ntile(5) OVER (PARTITION BY label ORDER BY {duck_hash('fold1', 'row_id')}, row_id) - 1)::INT AS fold FROM fx""")
def smp7(spark, sf):
    return sp.folds(fx_line(spark, sf).select("row_id", "label"), "row_id", 5, "label")


@query("smp8_contiguous_folds", """
SELECT o_orderkey, (ntile(5) OVER (ORDER BY o_orderkey) - 1)::INT AS fold FROM orders""")
def smp8(spark, sf):
    return sp.block_folds(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("smp9_take_validation_part", _duck_split(LINE, "label") + "SELECT row_id, label FROM sp WHERE split = 'val'")
def smp9(spark, sf):
    df = sp.split(fx_line(spark, sf).select("row_id", "label"), "row_id", "label")
    return sp.take_split(df, "val").drop("split")


@query("smp10_random_scores", f"""
SELECT DISTINCT p_name AS concept, {d6(duck_hash(3, 'p_name') + '::DOUBLE / 1152921504606846976.0')} AS score FROM part""")
def smp10(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("concept")).distinct()
    return rounded(sp.random_scores(names, "concept", 3), "score")


_STATUS = ["F", "O"]


def _flagship_sql() -> str:
    feats = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    long = " UNION ALL ".join(
        [f"SELECT label, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM tr" for c in feats]
        + ["SELECT tr.label, 'l_linestatus_' || c.s AS feature, (tr.l_linestatus = c.s)::INT::DOUBLE AS v FROM tr, cats c"]
    )
    return _duck_split(LINE, "label") + f""",
tr AS (SELECT * FROM sp WHERE split = 'train'), cats AS (SELECT DISTINCT l_linestatus AS s FROM tr),
raw AS ({long}),
z AS (SELECT r.label, r.feature, CASE WHEN r.feature LIKE 'l_linestatus%' THEN v ELSE (v - m) / s END AS v
      FROM raw r JOIN (SELECT feature, avg(v) AS m, stddev_pop(v) AS s FROM raw GROUP BY feature) USING (feature)),
pc AS (SELECT feature, label, count(*) AS nc, avg(v) AS mu, var_pop(v) AS va FROM z GROUP BY ALL),
ov AS (SELECT feature, avg(v) AS m FROM z GROUP BY feature),
f AS (SELECT feature, sum(nc * (mu - m) ** 2) / sum(nc * va) AS score FROM pc JOIN ov USING (feature) GROUP BY feature),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, {duck_hash(1, 'feature')}, feature) AS pos, count(*) OVER () AS n FROM f)
SELECT feature, {d6('score')} AS score, pos::INT AS pos FROM r WHERE pos <= floor(0.5::DOUBLE * n)"""


@query("flagship_best_half_of_features", _flagship_sql())
def flagship(spark, sf):
    df = sp.split(spread(fx_line(spark, sf)), "row_id", "label")
    train = sp.take_split(df, "train").persist()
    model = MixedEncoder(["l_quantity", "l_discount", "l_tax", "l_extendedprice"], ["l_linestatus"]).fit(train)
    scores = cut_lineage(fisher(model.transform(train), model.feature_names, "label"))  # one row per feature
    train.unpersist()
    return rounded(by_ratio(scores, "feature", 0.5, seed=1), "score")
