"""Queries: feature statistics (AGG3-AGG15) and their fixed-size results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.catalog import query, r6, rounded, table
from sieveline.catalog.fixtures import (
    BINS, CUST, CUST_NUM, DOC, LINE, LINE_NUM, d6, duck_long, fx_bins, fx_cust, fx_doc, fx_line,
)
from sieveline.operators import stats
from sieveline.operators.evaluate import class_weights
from sieveline.operators.neighbors import cosine_knn, inverse_laplacian
from sieveline.operators.ordering import quantiles

_LINE_LONG = duck_long(LINE_NUM, "label", "fx")
_MOMENTS = f"""
WITH fx AS ({LINE}), long AS ({_LINE_LONG})
SELECT feature, count(value) AS n, {d6('avg(value)')} AS mean, {d6('stddev_pop(value)')} AS sd
FROM long GROUP BY feature"""


@query("agg3_moments", _MOMENTS)
def agg3(spark, sf):
    return rounded(stats.moments(fx_line(spark, sf), LINE_NUM), "mean", "sd")


@query("agg4_pooled_moments", f"""
WITH fx AS ({BINS})
SELECT concept, 'value' AS feature, count(value) AS n, {d6('avg(value)')} AS mean, {d6('stddev_pop(value)')} AS sd
FROM fx GROUP BY concept""")
def agg4(spark, sf):
    return rounded(stats.moments(fx_bins(spark, sf), ["value"], by=["concept"]), "mean", "sd")


@query("agg5_class_weights", f"""
WITH fx AS ({LINE}), c AS (SELECT label, count(*) AS n FROM fx GROUP BY label)
SELECT label, n, {d6('(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n::DOUBLE)')} AS weight FROM c""")
def agg5(spark, sf):
    return rounded(class_weights(fx_line(spark, sf), "label"), "weight")


@query("agg6_exact_quantiles", f"""
WITH fx AS ({LINE}), long AS ({_LINE_LONG})
SELECT feature, {d6('quantile_cont(value, 0.5)')} AS q0, {d6('quantile_cont(value, 0.95)')} AS q1,
       {d6('quantile_cont(value, 0.998)')} AS q2
FROM long GROUP BY feature""")
def agg6(spark, sf):
    long = stats.to_long(fx_line(spark, sf), LINE_NUM, [])
    return rounded(quantiles(long, ["feature"], "value", [0.5, 0.95, 0.998], series=len(LINE_NUM)), "q0", "q1", "q2")


def _duck_mi(counts: str) -> str:
    return f"""
, cnt AS ({counts}),
tot AS (SELECT feature, sum(n) AS t FROM cnt GROUP BY feature),
px AS (SELECT feature, x, sum(n) AS nx FROM cnt GROUP BY feature, x),
py AS (SELECT feature, y, sum(n) AS ny FROM cnt GROUP BY feature, y)
SELECT feature, {d6('greatest(sum(n / t::DOUBLE * ln(n * t::DOUBLE / (nx * ny))), 0)')} AS score
FROM cnt JOIN tot USING (feature) JOIN px USING (feature, x) JOIN py USING (feature, y)
GROUP BY feature"""


@query("agg7_mutual_info_discrete", f"""
WITH fx AS ({LINE}), long AS ({duck_long(['l_linestatus', 'l_linenumber_', 'l_quantity'], 'label', '(SELECT *, CAST(l_discount AS VARCHAR) AS l_linenumber_ FROM fx)', 'VARCHAR')})
{_duck_mi('SELECT feature, value AS x, label AS y, count(*) AS n FROM long GROUP BY ALL')}""".replace("l_linenumber_", "discount_code"))
def agg7(spark, sf):
    df = fx_line(spark, sf).withColumn("discount_code", F.col("l_discount").cast("string"))
    return rounded(stats.mutual_info_discrete(df, ["l_linestatus", "discount_code", "l_quantity"], "label"), "score")


# brute windows and as-of joins; digamma of a count is a harmonic number minus Euler's constant
_MI_KNN = f"""
WITH fx AS ({LINE}), long AS ({_LINE_LONG}),
nb AS (SELECT feature, label, value, count(*) OVER (PARTITION BY feature, label) AS nc,
  list_sort(list_filter([value - lag(value, 1) OVER w, value - lag(value, 2) OVER w, value - lag(value, 3) OVER w,
    lead(value, 1) OVER w - value, lead(value, 2) OVER w - value, lead(value, 3) OVER w - value], lambda d: d IS NOT NULL)) AS ds
  FROM long WINDOW w AS (PARTITION BY feature, label ORDER BY value)),
pt AS (SELECT feature, value, nc, least(3, nc - 1) AS k, abs(ds[least(3, nc - 1)]) AS r FROM nb WHERE nc > 1),
cum AS (SELECT feature, value AS v, sum(count(*)) OVER (PARTITION BY feature ORDER BY value) AS upto, count(*) AS here FROM pt GROUP BY feature, value),
q AS (SELECT feature, value, nc, k, r, value + r AS hi, value - r AS lo FROM pt),
c AS (SELECT q.*, coalesce(b.upto, 0) AS below FROM q ASOF LEFT JOIN cum b ON q.feature = b.feature AND q.hi > b.v),
e AS (SELECT c.*, coalesce(u.upto, 0) AS outside FROM c ASOF LEFT JOIN cum u ON c.feature = u.feature AND c.lo >= u.v),
m AS (SELECT e.feature, nc, k, CASE WHEN r = 0 THEN cum.here ELSE below - outside END AS m FROM e JOIN cum ON cum.feature = e.feature AND cum.v = e.value),
h AS (SELECT i + 1 AS n, sum(1.0 / greatest(i, 1) * (i > 0)::INT) OVER (ORDER BY i) - 0.5772156649015329 AS psi FROM range(0, 1 + (SELECT count(*) FROM fx)) t(i))
SELECT feature, {d6('greatest(0, any_value(hn.psi) + avg(hk.psi) - avg(hc.psi) - avg(hm.psi))')} AS score
FROM m JOIN h hk ON hk.n = m.k JOIN h hc ON hc.n = m.nc JOIN h hm ON hm.n = m.m JOIN h hn ON hn.n = (SELECT count(*) FROM fx) GROUP BY feature"""


@query("agg8_mutual_info_knn", _MI_KNN)
def agg8(spark, sf):
    return rounded(stats.mutual_info_knn(fx_line(spark, sf), LINE_NUM, "label"), "score")


def _duck_bins(cols, k, relation="fx"):
    """Equal-depth bins of each column by edges at positions floor(j*n/k)."""
    edge_sql = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, list(v ORDER BY v) AS edges FROM (
              SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS p, count(*) OVER () AS n FROM {relation}
            ) WHERE p IN (SELECT floor(j * n / {float(k)}) FROM range(1, {k}) t(j))""" for c in cols
    )
    return edge_sql


_MI_BIN = f"""
WITH fx AS ({LINE}), ranked AS (
  SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS p,
         count(*) OVER (PARTITION BY feature) AS n FROM ({duck_long(LINE_NUM, '', 'fx')})),
edges AS (SELECT feature, value AS e FROM ranked, range(1, 10) t(j) WHERE p = floor(j * n / 10.0)),
dist AS (SELECT DISTINCT feature, value FROM ranked),
bins AS (SELECT feature, value, (SELECT count(*) FROM edges WHERE edges.feature = dist.feature AND e <= dist.value) AS b FROM dist),
"""


@query("agg9_mutual_info_binned", _MI_BIN + f"""
long AS ({_LINE_LONG})
{_duck_mi('SELECT feature, b AS x, label AS y, count(*) AS n FROM long JOIN bins USING (feature, value) GROUP BY ALL')}""")
def agg9(spark, sf):
    return rounded(stats.mutual_info_binned(fx_line(spark, sf), LINE_NUM, "label", bins=10), "score")


_REGR = ["l_quantity", "l_discount", "l_tax"]


@query("agg9_mutual_info_binned_regression", _MI_BIN + f"""
long AS ({duck_long(_REGR, 'l_extendedprice', 'fx')}),
yb AS (SELECT value AS l_extendedprice, b AS y FROM bins WHERE feature = 'l_extendedprice')
{_duck_mi('SELECT long.feature, b AS x, y, count(*) AS n FROM long JOIN bins USING (feature, value) JOIN yb USING (l_extendedprice) GROUP BY ALL')}""")
def agg9_regr(spark, sf):
    return rounded(
        stats.mutual_info_binned(fx_line(spark, sf), _REGR, "l_extendedprice", bins=10, label_bins=10), "score"
    )


@query("agg10_pearson", f"""
WITH fx AS ({LINE}), long AS ({_LINE_LONG})
SELECT feature, {d6('abs(corr(value, label))')} AS score FROM long GROUP BY feature""")
def agg10(spark, sf):
    return rounded(stats.pearson(fx_line(spark, sf), LINE_NUM, "label"), "score")


def _duck_spearman(cols, label):
    return f"""
WITH fx AS ({LINE}), long AS ({duck_long(cols, f'{label} AS y', 'fx')}),
rk AS (SELECT feature,
         rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry
       FROM long)
SELECT feature, {d6('abs(corr(rx::DOUBLE, ry::DOUBLE))')} AS score FROM rk GROUP BY feature"""


@query("agg11_spearman", _duck_spearman(LINE_NUM, "label"))
def agg11(spark, sf):
    return rounded(stats.spearman(fx_line(spark, sf), LINE_NUM, "label"), "score")


@query("agg11_spearman_regression", _duck_spearman(_REGR, "l_extendedprice"))
def agg11_regr(spark, sf):
    return rounded(stats.spearman(fx_line(spark, sf), _REGR, "l_extendedprice"), "score")


_SCATTER = f"""
WITH fx AS ({LINE}), long AS ({_LINE_LONG}),
pc AS (SELECT feature, label, count(*) AS nc, avg(value) AS mu, var_pop(value) AS v FROM long GROUP BY ALL),
ov AS (SELECT feature, count(*) AS n, avg(value) AS m FROM long GROUP BY ALL),
s AS (SELECT feature, sum(nc * (mu - m) ** 2) AS b, sum(nc * v) AS w, any_value(n) AS n, count(*) AS k
      FROM pc JOIN ov USING (feature) GROUP BY feature)
"""


@query("agg12_fisher", _SCATTER + f"SELECT feature, {d6('b / w')} AS score FROM s")
def agg12(spark, sf):
    return rounded(stats.fisher(fx_line(spark, sf), LINE_NUM, "label"), "score")


@query("agg14_f_classif", _SCATTER + f"SELECT feature, {d6('(b / (k - 1)) / (w / (n - k))')} AS score FROM s")
def agg14(spark, sf):
    return rounded(stats.f_classif(fx_line(spark, sf), LINE_NUM, "label"), "score")


@query("agg14_f_regression", f"""
WITH fx AS ({CUST}), long AS ({duck_long(['c_acctbal', 'n_orders', 'n_urgent'], 'avg_total AS y', 'fx')}),
r AS (SELECT feature, corr(value, y) ** 2 AS r2, count(*) AS n FROM long GROUP BY feature)
SELECT feature, {d6('r2 / (1 - r2) * (n - 2)')} AS score FROM r""")
def agg14_regr(spark, sf):
    return rounded(stats.f_regression(fx_cust(spark, sf), ["c_acctbal", "n_orders", "n_urgent"], "avg_total"), "score")


_PAIRS = [(a, b) for i, a in enumerate(CUST_NUM) for b in CUST_NUM[i + 1 :]]


@query("agg15_feature_correlations", f"WITH fx AS ({CUST}) " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {d6(f'corr({a}::DOUBLE, {b}::DOUBLE)')} AS corr FROM fx" for a, b in _PAIRS))
def agg15(spark, sf):
    return rounded(stats.correlations(fx_cust(spark, sf), CUST_NUM), "corr")


#: A feature with missing values: customers whose number of orders is a multiple of 5 lack a balance.
_GAPS = "SELECT * REPLACE (CASE WHEN n_orders % 5 <> 0 THEN c_acctbal END AS c_acctbal) FROM ({})"


def with_gaps(df):
    return df.withColumn("c_acctbal", F.when(F.col("n_orders") % 5 != 0, F.col("c_acctbal")))


@query("agg15_correlations_with_missing", f"WITH fx AS ({_GAPS.format(CUST)}) " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {d6(f'corr({a}::DOUBLE, {b}::DOUBLE)')} AS corr FROM fx" for a, b in _PAIRS))
def agg15_gaps(spark, sf):
    return rounded(stats.correlations(with_gaps(fx_cust(spark, sf)), CUST_NUM), "corr")


def with_nans(df):
    """The same gaps as NaN, which statistics take for missing as well."""
    return df.withColumn("c_acctbal", F.when(F.col("n_orders") % 5 != 0, F.col("c_acctbal")).otherwise(F.lit(float("nan"))))


def _nan_long(label: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value, {label} AS y FROM fx" for c in CUST_NUM if c != label)
    return f"WITH fx AS ({_GAPS.format(CUST)}), long AS (SELECT * FROM ({parts}) WHERE value IS NOT NULL)"


_NAN_SCATTER = _nan_long("label") + """,
pc AS (SELECT feature, y, count(*) AS nc, avg(value) AS mu, var_pop(value) AS v FROM long GROUP BY ALL),
ov AS (SELECT feature, count(*) AS n, avg(value) AS m FROM long GROUP BY ALL),
s AS (SELECT feature, sum(nc * (mu - m) ** 2) AS b, sum(nc * v) AS w, any_value(n) AS n, count(*) AS k FROM pc JOIN ov USING (feature) GROUP BY feature)
"""


@query("agg10_pearson_with_nan", _nan_long("label") + f" SELECT feature, {d6('abs(corr(value, y))')} AS score FROM long GROUP BY feature")
def agg10_nan(spark, sf):
    return rounded(stats.pearson(with_nans(fx_cust(spark, sf)), CUST_NUM, "label"), "score")


@query("agg12_fisher_with_nan", _NAN_SCATTER + f"SELECT feature, {d6('b / w')} AS score FROM s")
def agg12_nan(spark, sf):
    return rounded(stats.fisher(with_nans(fx_cust(spark, sf)), CUST_NUM, "label"), "score")


@query("agg14_f_classif_with_nan", _NAN_SCATTER + f"SELECT feature, {d6('(b / (k - 1)) / (w / (n - k))')} AS score FROM s")
def agg14_nan(spark, sf):
    return rounded(stats.f_classif(with_nans(fx_cust(spark, sf)), CUST_NUM, "label"), "score")


@query("agg14_f_regression_with_nan", _nan_long("avg_total") + f""", r AS (SELECT feature, corr(value, y) ** 2 AS r2, count(*) AS n FROM long GROUP BY feature)
SELECT feature, {d6('r2 / (1 - r2) * (n - 2)')} AS score FROM r""")
def agg14_regr_nan(spark, sf):
    cols = [c for c in CUST_NUM if c != "avg_total"]
    return rounded(stats.f_regression(with_nans(fx_cust(spark, sf)), cols, "avg_total"), "score")


_LINE_PAIRS = [(a, b) for i, a in enumerate(LINE_NUM) for b in LINE_NUM[i + 1 :]]


@query("agg15_line_correlations", f"WITH fx AS ({LINE}) " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {d6(f'corr({a}, {b})')} AS corr FROM fx" for a, b in _LINE_PAIRS))
def agg15_line(spark, sf):
    return rounded(stats.correlations(fx_line(spark, sf), LINE_NUM), "corr")


@query("agg15_embedding_correlations", f"""
WITH long AS (SELECT vec_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT 'e' || a.d AS feature_a, 'e' || b.d AS feature_b, {d6('corr(a.v, b.v)')} AS corr
FROM long a JOIN long b USING (vec_id) WHERE a.d < b.d GROUP BY a.d, b.d""")
def agg15_vec(spark, sf):
    df = table(spark, sf, "embeddings")
    wide = df.select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return rounded(stats.correlations(wide, [f"e{i}" for i in range(64)]), "corr")


_KNN = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
sim AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.e, b.e), 9) AS s
        FROM v a JOIN v b ON a.vec_id <> b.vec_id),
knn AS (SELECT src, dst, s, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS rn FROM sim QUALIFY rn <= 5)
"""


@query("jon10_cosine_knn", _KNN + f"SELECT src, dst, rn::INT AS rank, {d6('s')} AS similarity FROM knn")
def jon10(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return rounded(cosine_knn(df, "vec_id", "embedding", k=5), "similarity")


_LAP = _KNN + f""",
edge AS (SELECT src, dst, max(s) AS w FROM (
           SELECT src, dst, s FROM knn UNION ALL SELECT dst, src, s FROM knn) GROUP BY ALL),
selfw AS (SELECT src, dst, w FROM edge UNION ALL SELECT vec_id, vec_id, 1.0 FROM v),
deg AS (SELECT src AS vec_id, sum(w) AS d FROM selfw GROUP BY src),
f AS (SELECT vec_id, unnest(range(64)) AS j, unnest(e) AS x FROM v),
a AS (SELECT j, sum(x * x * d) AS fdf, sum(x * d) AS fd, sum(d) AS dd FROM f JOIN deg USING (vec_id) GROUP BY j),
b AS (SELECT p.j, sum(p.x * w * q.x) AS fwf FROM selfw JOIN f p ON p.vec_id = src JOIN f q ON q.vec_id = dst AND p.j = q.j GROUP BY p.j)
SELECT 'f' || j AS feature, {d6('1 / (1 - (fwf - fd * fd / dd) / (fdf - fd * fd / dd))')} AS score FROM a JOIN b USING (j)"""


@query("agg13_inverse_laplacian", _LAP)
def agg13(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return rounded(inverse_laplacian(df, "vec_id", "embedding", k=5), "score")


@query("agg19_mean_abs", f"""
WITH fx AS ({CUST}), long AS ({duck_long(CUST_NUM, '', 'fx')})
SELECT feature, {d6('avg(abs(value))')} AS score FROM long GROUP BY feature""")
def agg19(spark, sf):
    long = stats.to_long(fx_cust(spark, sf), CUST_NUM, [])
    return long.groupBy("feature").agg(r6(F.avg(F.abs("value"))).alias("score"))


@query("agg7_mutual_info_documents", f"""
WITH fx AS ({DOC}), long AS ({duck_long(['lang', 'source'], 'label', 'fx', 'VARCHAR')})
{_duck_mi('SELECT feature, value AS x, label AS y, count(*) AS n FROM long GROUP BY ALL')}""")
def agg7_doc(spark, sf):
    return rounded(stats.mutual_info_discrete(fx_doc(spark, sf), ["lang", "source"], "label"), "score")
