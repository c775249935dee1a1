"""Queries: metrics, path tables, grids, report tables (AGG1-2, AGG21-32, JON11-12, EXP*, MOD10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.catalog import query, r6, rounded, rounded9, table
from sieveline.catalog.fixtures import CUST, LINE, PATHS, SCORES, d6, d9, fx_cust, fx_line, fx_paths, fx_scores, duck_long
from sieveline.functions.scalars import nan_to_null
from sieveline.operators import evaluate as ev
from sieveline.operators import report

_SEEDED = "SELECT p_brand AS fs_method, p_type AS datapred, p_size % 5 AS seed, avg(p_retailprice) / 2000 AS metric FROM part GROUP BY ALL"


def _seeded(spark, sf):
    return table(spark, sf, "part").groupBy(
        F.col("p_brand").alias("fs_method"), F.col("p_type").alias("datapred"), (F.col("p_size") % 5).alias("seed")
    ).agg((F.avg("p_retailprice") / 2000).alias("metric"))


@query("agg1_mean_and_std_over_seeds", f"""
SELECT fs_method, datapred, {d9('avg(metric)')} AS mean, {d9('stddev_pop(metric)')} AS std FROM ({_SEEDED}) GROUP BY ALL""")
def agg1(spark, sf):
    return rounded9(report.path_table(_seeded(spark, sf), ["fs_method", "datapred"], "metric"), "mean", "std")


@query("agg2_mean_skipping_nan", f"""
SELECT fs_method, {d9("avg(CASE WHEN seed <> 3 THEN sqrt(metric) END)")} AS mean FROM ({_SEEDED}) GROUP BY fs_method""")
def agg2(spark, sf):
    with_nan = F.when(F.col("seed") == 3, F.lit(float("nan"))).otherwise(F.sqrt("metric"))
    df = _seeded(spark, sf).withColumn("metric", with_nan)
    return rounded9(df.groupBy("fs_method").agg(F.avg(nan_to_null("metric")).alias("mean")), "mean")


# --- metrics on a deterministic score ------------------------------------------------------------

_PRED = f"""pred AS (SELECT l_linestatus AS split, label, round(1 / (1 + exp(-(l_quantity - 25) / 10 - l_discount * 5)), 9) AS prob,
  l_extendedprice AS y, l_quantity * 1500 AS yhat FROM ({LINE}))"""


def _pred(spark, sf):
    margin = (F.col("l_quantity") - 25) / 10 + F.col("l_discount") * 5
    return fx_line(spark, sf).select(
        F.col("l_linestatus").alias("split"), "label", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)), 9).alias("prob"),
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("yhat"),
    )


_RANKED = """rk AS (SELECT split, label, rank() OVER (PARTITION BY split ORDER BY prob)
    + (count(*) OVER (PARTITION BY split, prob) - 1) / 2.0 AS r FROM pred),
auc AS (SELECT split, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
    / (count(*) FILTER (label = 1)::DOUBLE * count(*) FILTER (label = 0)) AS auroc FROM rk GROUP BY split)"""
_AP = """th AS (SELECT split, prob, count(*) FILTER (label = 1) AS p, count(*) AS c FROM pred GROUP BY split, prob),
cu AS (SELECT split, p, sum(p) OVER w AS tp, sum(c) OVER w AS n, sum(p) OVER (PARTITION BY split) AS total FROM th
       WINDOW w AS (PARTITION BY split ORDER BY prob DESC)),
ap AS (SELECT split, sum(p / total::DOUBLE * tp / n) AS auprc FROM cu GROUP BY split)"""
_BACC = """ba AS (SELECT split, (avg((prob >= 0.5)::INT) FILTER (label = 1) + avg((prob < 0.5)::INT) FILTER (label = 0)) / 2 AS b_acc FROM pred GROUP BY split)"""
_ECE = """ec AS (SELECT split, sum(n * abs(y - p)) / sum(n) AS ece FROM (
   SELECT split, least(floor(prob * 10), 9) AS b, count(*) AS n, avg(label) AS y, avg(prob) AS p FROM pred GROUP BY ALL) GROUP BY split)"""
_LOSS = """ls AS (SELECT split, avg(-(label * ln(prob) + (1 - label) * ln(1 - prob))) AS loss FROM pred GROUP BY split)"""


@query("agg21_auroc", f"WITH {_PRED}, {_RANKED} SELECT split, {d6('auroc')} AS auroc FROM auc")
def agg21(spark, sf):
    return rounded(ev.auroc(_pred(spark, sf), "label", "prob", by=["split"]), "auroc")


@query("agg22_average_precision", f"WITH {_PRED}, {_AP} SELECT split, {d6('auprc')} AS auprc FROM ap")
def agg22(spark, sf):
    return rounded(ev.average_precision(_pred(spark, sf), "label", "prob", by=["split"]), "auprc")


@query("agg23_balanced_accuracy", f"WITH {_PRED}, {_BACC} SELECT split, {d6('b_acc')} AS b_acc FROM ba")
def agg23(spark, sf):
    return _pred(spark, sf).groupBy("split").agg(r6(ev.balanced_accuracy("label", "prob")).alias("b_acc"))


@query("agg24_calibration_error", f"WITH {_PRED}, {_ECE} SELECT split, {d6('ece')} AS ece FROM ec")
def agg24(spark, sf):
    return rounded(ev.calibration_error(_pred(spark, sf), "label", "prob", by=["split"]), "ece")


@query("agg25_mse_and_mae", f"WITH {_PRED} SELECT split, round(avg((yhat - y) ** 2), 2) + 0.0 AS mse, round(avg(abs(yhat - y)), 4) + 0.0 AS mae FROM pred GROUP BY split")
def agg25(spark, sf):
    return _pred(spark, sf).groupBy("split").agg(
        (F.round(ev.mse("y", "yhat"), 2) + 0.0).alias("mse"), (F.round(ev.mae("y", "yhat"), 4) + 0.0).alias("mae")
    )


@query("agg26_log_loss", f"WITH {_PRED}, {_LOSS} SELECT split, {d6('loss')} AS loss FROM ls")
def agg26(spark, sf):
    return _pred(spark, sf).groupBy("split").agg(r6(ev.log_loss("label", "prob")).alias("loss"))


@query("mod10_metric_bundle", f"WITH {_PRED}, {_RANKED}, {_AP}, {_BACC}, {_ECE}, {_LOSS} " + " UNION ALL ".join(
    f"SELECT split, '{m}' AS metric, {d6(m)} AS value FROM {t}"
    for m, t in [("auroc", "auc"), ("auprc", "ap"), ("b_acc", "ba"), ("ece", "ec"), ("loss", "ls")]))
def mod10(spark, sf):
    return rounded(ev.evaluate(_pred(spark, sf), "label", "prob", "classification", by=["split"]), "value")


@query("agg27_nonzero_fraction", f"""
WITH fx AS ({CUST}), c AS (SELECT feature, corr(value, label) AS w FROM ({duck_long(['c_acctbal', 'n_orders', 'avg_total', 'n_urgent'], 'label', 'fx')}) GROUP BY feature)
SELECT count(*) FILTER (abs(w) > 0.01) AS n, count(*) FILTER (abs(w) > 0.01) / count(*)::DOUBLE AS frac FROM c""")
def agg27(spark, sf):
    from sieveline.operators.stats import pearson

    coef = pearson(fx_cust(spark, sf), ["c_acctbal", "n_orders", "avg_total", "n_urgent"], "label")
    used = F.count_if(F.col("score") > 0.01)
    return coef.agg(used.alias("n"), (used / F.count(F.lit(1)).cast("double")).alias("frac"))


# --- areas under selection paths ---------------------------------------------------------------

_AREA = f"""
WITH fx AS ({PATHS}), area AS (
  SELECT fs_method, sum((frac - f0) * (metric + m0) / 2) AS area FROM (
    SELECT *, coalesce(lag(frac) OVER w, 0) AS f0, coalesce(lag(metric) OVER w, 0.5) AS m0 FROM fx
    WINDOW w AS (PARTITION BY fs_method ORDER BY frac)) GROUP BY fs_method)
"""


@query("agg28_path_area", _AREA + f"SELECT fs_method, {d9('area')} AS area FROM area")
def agg28(spark, sf):
    return rounded9(report.path_area(fx_paths(spark, sf), ["fs_method"]), "area")


@query("agg28_path_area_regression", _AREA.replace("coalesce(lag(metric) OVER w, 0.5)", "coalesce(lag(metric) OVER w, metric)") + f"SELECT fs_method, {d9('area')} AS area FROM area")
def agg28_regr(spark, sf):
    return rounded9(report.path_area(fx_paths(spark, sf), ["fs_method"], task="regression"), "area")


@query("agg29_percent_change", _AREA + f"""
SELECT fs_method, {d9("(area - b) / b * 100")} AS pct_change FROM area, (SELECT area AS b FROM area WHERE fs_method = 'Brand#1')""")
def agg29(spark, sf):
    areas = report.path_area(fx_paths(spark, sf), ["fs_method"])
    return rounded9(report.pct_change(areas, [], "fs_method", "Brand#1"), "pct_change")


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_TYPED = "SELECT p_brand AS fs_method, p_type AS datapred, CAST(p_size AS DOUBLE) / 50 AS frac, avg(p_retailprice) / 2000 AS metric FROM part GROUP BY ALL"
_TYPED_AREA = f"""
WITH fx AS ({_TYPED}), area AS (
  SELECT fs_method, datapred, sum((frac - f0) * (metric + m0) / 2) AS area FROM (
    SELECT *, coalesce(lag(frac) OVER w, 0) AS f0, coalesce(lag(metric) OVER w, 0.5) AS m0 FROM fx
    WINDOW w AS (PARTITION BY fs_method, datapred ORDER BY frac)) GROUP BY ALL)
"""


def _typed_areas(spark, sf):
    fx = table(spark, sf, "part").groupBy(
        F.col("p_brand").alias("fs_method"), F.col("p_type").alias("datapred"), (F.col("p_size").cast("double") / 50).alias("frac")
    ).agg((F.avg("p_retailprice") / 2000).alias("metric"))
    return report.path_area(fx, ["fs_method", "datapred"])


@query("agg30_pivoted_areas", _TYPED_AREA + "SELECT fs_method, " + ", ".join(
    d9(f"max(area) FILTER (datapred = '{t}')") + f' AS "{t}"' for t in _TYPES) + " FROM area GROUP BY fs_method")
def agg30(spark, sf):
    order = [f"Brand#{i}" for i in range(1, 26)]
    return rounded9(report.pivot_areas(_typed_areas(spark, sf), "fs_method", "datapred", _TYPES, order), *_TYPES)


@query("exp5_area_and_change_table", _TYPED_AREA + f"""
SELECT fs_method, datapred, {d9('area')} AS area, {d9('(area - b) / b * 100')} AS pct_change
FROM area JOIN (SELECT datapred, area AS b FROM area WHERE fs_method = 'Brand#1') USING (datapred)""")
def exp5(spark, sf):
    areas = _typed_areas(spark, sf)
    change = report.pct_change(areas, ["datapred"], "fs_method", "Brand#1")
    return rounded9(areas.join(change, ["fs_method", "datapred"]), "area", "pct_change")


_BOX = f"""
WITH fx AS ({LINE}), q AS (SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, avg(l_extendedprice) AS mean,
   stddev_samp(l_extendedprice) AS sd, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
   quantile_cont(l_extendedprice, 0.75) AS q3 FROM fx GROUP BY ALL),
w AS (SELECT fx.l_returnflag, fx.l_linestatus, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM fx JOIN q USING (l_returnflag, l_linestatus)
      WHERE l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL)
"""


@query("agg31_box_statistics", _BOX + f"""
SELECT l_returnflag, l_linestatus, n, {d6('mean')} AS mean, {d6('sd')} AS sd, {d6('q1')} AS q1, {d6('median')} AS median, {d6('q3')} AS q3, low, high
FROM q JOIN w USING (l_returnflag, l_linestatus)""")
def agg31(spark, sf):
    out = report.box_stats(fx_line(spark, sf), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return rounded(out, "mean", "sd", "q1", "median", "q3")


_COHORT_NUM = ["avg_total", "c_acctbal"]


@query("agg32_cohort_summary", f"""
WITH fx AS ({CUST}), t AS (SELECT count(*) AS t FROM fx)
{' UNION ALL '.join(f"SELECT '{c}' AS variable, NULL AS category, count({c}) AS n, t - count({c}) AS missing, {d6(f'avg({c})')} AS mean, {d6(f'stddev_samp({c})')} AS sd, NULL::DOUBLE AS share FROM fx, t GROUP BY t" for c in _COHORT_NUM)}
{' '.join(f" UNION ALL SELECT '{c}', {c}::VARCHAR, count(*), 0::BIGINT, NULL, NULL, {d6('count(*) / t::DOUBLE')} FROM fx, t GROUP BY {c}, t" for c in ['r_name', 'label'])}""")
def agg32(spark, sf):
    return rounded(report.cohort_summary(fx_cust(spark, sf), _COHORT_NUM, ["r_name", "label"]), "mean", "sd", "share")


# --- joins and grids ---------------------------------------------------------------------------

_RATIOS = [0.15, 0.3, 0.45, 0.6, 0.75, 0.9]


@query("jon11_value_at_ratio", f"""
WITH fx AS ({PATHS}), r AS (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in _RATIOS)}]) AS ratio)
SELECT fs_method, ratio, frac, {d9('metric')} AS metric FROM fx, r WHERE frac <= ratio
QUALIFY row_number() OVER (PARTITION BY fs_method, ratio ORDER BY frac DESC) = 1""")
def jon11(spark, sf):
    return rounded9(report.value_at_ratio(fx_paths(spark, sf), _RATIOS, ["fs_method"]), "metric")


@query("jon12_experiment_grid", """
WITH m AS (SELECT DISTINCT p_type AS model FROM part), f AS (SELECT DISTINCT p_brand AS fs_method FROM part),
s AS (SELECT unnest([1, 2, 3, 4, 5])::INT AS seed)
SELECT model, fs_method, ratio, seed FROM m, f, s, (VALUES (0.1::DOUBLE), (0.3), (1.0)) r(ratio)
UNION ALL SELECT model, 'all', 1.0, seed FROM m, s""")
def jon12(spark, sf):
    part = table(spark, sf, "part")
    models = sorted(r[0] for r in part.select("p_type").distinct().collect())  # parameter lists
    methods = sorted(r[0] for r in part.select("p_brand").distinct().collect())
    return report.experiment_grid(spark, models, [*methods, "all"], [0.1, 0.3, 1.0], range(1, 6))


@query("exp4_path_bands", f"""
WITH b AS (SELECT fs_method, datapred, avg(metric) AS mean, stddev_pop(metric) AS std FROM ({_SEEDED}) GROUP BY ALL)
SELECT fs_method, datapred, {d9('mean - std')} AS lower, {d9('mean + std')} AS upper FROM b""")
def exp4(spark, sf):
    paths = report.path_table(_seeded(spark, sf), ["fs_method", "datapred"], "metric")
    return rounded9(report.bands(paths).select("fs_method", "datapred", "lower", "upper"), "lower", "upper")


# --- agreement of scores with importance measures --------------------------------------------------

_FI = """fi AS (SELECT 'mi' AS fi_method, p_size % 2 AS seed, p_name || '_' || p_type AS feature, avg(p_partkey) AS score FROM part GROUP BY ALL
  UNION ALL SELECT 'pearson', 0, p_name, avg(p_size) FROM part GROUP BY p_name)"""


def _importance(spark, sf):
    part = table(spark, sf, "part")
    mi = part.groupBy((F.col("p_size") % 2).alias("seed"), F.concat_ws("_", "p_name", "p_type").alias("feature")).agg(F.avg("p_partkey").alias("score"))
    pe = part.groupBy(F.col("p_name").alias("feature")).agg(F.avg("p_size").alias("score")).withColumn("seed", F.lit(0))
    return mi.withColumn("fi_method", F.lit("mi")).unionByName(pe.withColumn("fi_method", F.lit("pearson")))


@query("imp6_agreement_table", f"""
WITH {_FI}, fx AS ({SCORES}), nf AS (SELECT fi_method, seed, count(*) AS nf FROM fi GROUP BY ALL), ns AS (SELECT llm_model, count(*) AS ns FROM fx GROUP BY ALL),
v AS (SELECT llm_model, fi_method, seed, feature AS k, fx.score AS x, fi.score AS y FROM fi JOIN nf USING (fi_method, seed) JOIN fx ON
   concept = CASE WHEN contains(feature, '_') THEN split_part(feature, '_', 1) ELSE feature END JOIN ns USING (llm_model) WHERE nf <> ns OR feature = concept),
t AS (SELECT a.llm_model, a.fi_method, a.seed, sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum((a.x <> b.x)::INT) * sum((a.y <> b.y)::INT)::DOUBLE) AS tau
   FROM v a JOIN v b ON a.llm_model = b.llm_model AND a.fi_method = b.fi_method AND a.seed = b.seed AND a.k < b.k GROUP BY ALL)
SELECT llm_model, fi_method, {d9('avg(tau)')} AS kendall_tau FROM t GROUP BY ALL""")
def imp6(spark, sf):
    from sieveline.operators.importance import agreement

    return rounded9(agreement(fx_scores(spark, sf), _importance(spark, sf)), "kendall_tau")


@query("imp7_task_guards", """
WITH i AS (SELECT p_type AS datapred, CASE p_size % 4 WHEN 0 THEN 'spearman' WHEN 1 THEN 'fisher' WHEN 2 THEN 'mi' ELSE 'pearson' END AS fi_method, count(*) AS n FROM part GROUP BY ALL)
SELECT datapred, fi_method, n FROM i WHERE (fi_method <> 'spearman' OR datapred IN ('ECONOMY', 'LARGE', 'MEDIUM'))
 AND (fi_method <> 'fisher' OR datapred NOT IN ('ECONOMY', 'LARGE', 'MEDIUM'))""")
def imp7(spark, sf):
    from sieveline.operators.importance import allowed

    part = table(spark, sf, "part")
    method = F.element_at(F.array(*[F.lit(m) for m in ("spearman", "fisher", "mi", "pearson")]), (F.col("p_size") % 4 + 1).cast("int"))
    rows = part.groupBy(F.col("p_type").alias("datapred"), method.alias("fi_method")).agg(F.count(F.lit(1)).alias("n"))
    regression = F.col("datapred").isin("ECONOMY", "LARGE", "MEDIUM")
    tasks = part.select(F.col("p_type").alias("datapred")).distinct().withColumn(
        "task", F.when(regression, "regression").otherwise("classification"))
    return allowed(rows, tasks)


@query("imp5_mean_importance", f"WITH {_FI} SELECT fi_method, feature, {d9('avg(score)')} AS score FROM fi GROUP BY ALL")
def imp5(spark, sf):
    from sieveline.operators.importance import mean_over_seeds

    return rounded9(mean_over_seeds(_importance(spark, sf), ["fi_method", "feature"]), "score")
