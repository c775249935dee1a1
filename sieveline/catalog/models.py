"""Queries: models, selection by fitting, importance by fitting (MOD*, SEL9-SEL16, IMP1-IMP4, EXP1-EXP2)."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sieveline.catalog import query, r6, rounded, table
from sieveline.catalog.fixtures import CUST, CUST_NUM, LINE, LINE_NUM, d6, duck_hash, fx_cust, fx_line
from sieveline.operators import importance as imp
from sieveline.operators import infold, linear, stats, trials
from sieveline.operators import select as sel
from sieveline.operators.encode import ColumnFilter, MixedEncoder
from sieveline.operators.split import block_folds, folds, split, take_split
from sieveline.operators.sparse import sparse_path
from sieveline.operators.textpipe import sequential_selection
from sieveline.catalog.statistics import _GAPS, with_gaps, with_nans
from sieveline.plans.experiments import compare_models, compare_selection, encoded_parts
from sieveline.runtime import spread

_CAT = ["r_name"]


def _encoded(spark, sf, label="label"):
    df = fx_cust(spark, sf)
    numeric = [c for c in CUST_NUM if c != label]
    model = MixedEncoder(numeric, _CAT).fit(df)
    out = model.transform(df.select("row_id", F.col(label).cast("double").alias("y"), *numeric, *_CAT))
    return out, model.feature_names


def _pairs(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ridge with two features, solved in closed form by SQL
_RIDGE = f"""
WITH fx AS ({CUST}), m AS (SELECT count(*) AS n, avg(n_orders) AS a, avg(n_urgent) AS b, avg(avg_total) AS y FROM fx),
s AS (SELECT sum((n_orders - a) ** 2) + 10 AS aa, sum((n_urgent - b) ** 2) + 10 AS bb, sum((n_orders - a) * (n_urgent - b)) AS ab,
  sum((n_orders - a) * (avg_total - m.y)) AS ay, sum((n_urgent - b) * (avg_total - m.y)) AS byy FROM fx, m),
w AS (SELECT (ay * bb - byy * ab) / (aa * bb - ab * ab) AS w1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS w2 FROM s)
"""


@query("mod2_ridge_regression", _RIDGE + """
SELECT 'n_orders' AS feature, round(w1, 4) + 0.0 AS coef FROM w UNION ALL SELECT 'n_urgent', round(w2, 4) + 0.0 FROM w
UNION ALL SELECT 'intercept', round(y - w1 * a - w2 * b, 4) + 0.0 FROM w, m""")
def mod2(spark, sf):
    cols = ["n_orders", "n_urgent"]
    b, w = linear.ridge_fit(fx_cust(spark, sf), cols, "avg_total", alpha=10.0)
    rows = [(c, float(v)) for c, v in zip([*cols, "intercept"], [*w, b], strict=True)]
    return _pairs(spark, rows, "feature string, coef double").withColumn("coef", F.round("coef", 4) + 0.0)


_LINE_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _line_grid_sql() -> str:
    a, b, c = _LINE_FEATURES
    alphas = ", ".join(f"({float(x)}::DOUBLE)" for x in linear.RIDGE_ALPHA)
    pairs = {"aa": (a, a), "ab": (a, b), "ac": (a, c), "bb": (b, b), "bc": (b, c), "cc": (c, c)}
    moments = ", ".join(f"sum(({x} - m_{x}) * ({y} - m_{y})) AS {k}" for k, (x, y) in pairs.items())
    labels = ", ".join(f"sum(({x} - m_{x}) * (y - m_y)) AS y{k}" for k, x in zip("abc", _LINE_FEATURES))
    means = ", ".join(f"avg({x}) AS m_{x}" for x in _LINE_FEATURES)
    keep = ", ".join(f"any_value(m_{x}) AS m_{x}" for x in [*_LINE_FEATURES, "y"])
    # Cramer's rule on the symmetric 3 x 3 system
    return f"""
WITH fx AS ({LINE}), t AS (SELECT {a}, {b}, {c}, l_extendedprice AS y,
  ntile(5) OVER (ORDER BY {duck_hash('fold1', 'row_id')}, row_id) - 1 AS fold FROM fx),
folds AS (SELECT unnest(range(5)) AS f), m AS (SELECT f, {means}, avg(y) AS m_y FROM t, folds WHERE fold <> f GROUP BY f),
s0 AS (SELECT f, {keep}, {moments}, {labels} FROM t, m WHERE fold <> f GROUP BY f),
s AS (SELECT * REPLACE (aa + alpha AS aa, bb + alpha AS bb, cc + alpha AS cc) FROM s0, (VALUES {alphas}) g(alpha)),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
w AS (SELECT f, alpha, m_{a}, m_{b}, m_{c}, m_y,
  (ya * (bb * cc - bc * bc) - ab * (yb * cc - bc * yc) + ac * (yb * bc - bb * yc)) / det AS w1,
  (aa * (yb * cc - bc * yc) - ya * (ab * cc - bc * ac) + ac * (ab * yc - yb * ac)) / det AS w2,
  (aa * (bb * yc - yb * bc) - ab * (ab * yc - yb * ac) + ya * (ab * bc - bb * ac)) / det AS w3 FROM d),
e AS (SELECT alpha, f, -avg(abs(y - (m_y + w1 * ({a} - m_{a}) + w2 * ({b} - m_{b}) + w3 * ({c} - m_{c})))) AS score
  FROM t JOIN w ON fold = f GROUP BY alpha, f)
SELECT alpha AS penalty, round(avg(score), 4) + 0.0 AS mean, round(stddev_pop(score), 4) + 0.0 AS std FROM e GROUP BY alpha"""


@query("mod3_ridge_grid_lines", _line_grid_sql())
def mod3_lines(spark, sf):
    df = fx_line(spark, sf).select("row_id", *_LINE_FEATURES, "l_extendedprice")
    df = folds(spread(df), "row_id", 5).persist()
    rows, _, _, _ = linear.grid_search(df, _LINE_FEATURES, "l_extendedprice", "fold", "regression")
    df.unpersist()
    out = _pairs(spark, rows, "penalty double, mean double, std double")
    return out.select("penalty", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


_CHAIN_ALPHA = [0.1, 10.0, 1000.0, 10000.0]


def _scaled_in_folds_sql() -> str:
    a, b, c = _LINE_FEATURES
    alphas = ", ".join(f"({x}::DOUBLE)" for x in _CHAIN_ALPHA)
    long = " UNION ALL ".join(f"SELECT fold, y, {j} AS j, {x}::DOUBLE AS v FROM t" for j, x in enumerate("abc"))
    value = lambda j: f"CASE {j} WHEN 0 THEN a WHEN 1 THEN b ELSE c END"
    det = "((aa + alpha) * (bb + alpha) - ab * ab)"
    return f"""
WITH fx AS ({LINE}), t AS (SELECT {a} AS a, {b} AS b, {c} AS c, l_extendedprice AS y,
  ntile(5) OVER (ORDER BY {duck_hash('fold1', 'row_id')}, row_id) - 1 AS fold FROM fx),
long AS ({long}), folds AS (SELECT unnest(range(5)) AS f),
st AS (SELECT f, j, avg(v) AS m, stddev_pop(v) AS s, avg(y) AS my, abs(corr(v, y)) AS r FROM long, folds WHERE fold <> f GROUP BY f, j),
best AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY r DESC, j) AS k FROM st),
p AS (SELECT u.f, u.my, u.m AS m1, u.s AS s1, u.j AS j1, w.m AS m2, w.s AS s2, w.j AS j2 FROM best u JOIN best w ON u.f = w.f AND u.k = 1 AND w.k = 2),
z AS (SELECT f, fold, y - my AS y, ({value('j1')} - m1) / s1 AS z1, ({value('j2')} - m2) / s2 AS z2 FROM t, p),
g AS (SELECT f, sum(z1 * z1) AS aa, sum(z1 * z2) AS ab, sum(z2 * z2) AS bb, sum(z1 * y) AS ay, sum(z2 * y) AS yb FROM z WHERE fold <> f GROUP BY f),
w AS (SELECT f, alpha, (ay * (bb + alpha) - yb * ab) / {det} AS w1, (yb * (aa + alpha) - ay * ab) / {det} AS w2 FROM g, (VALUES {alphas}) q(alpha)),
e AS (SELECT alpha, f, -avg(abs(y - w1 * z1 - w2 * z2)) AS score FROM z JOIN w USING (f) WHERE fold = f GROUP BY alpha, f)
SELECT alpha AS penalty, 2::INT AS size, round(avg(score), 4) + 0.0 AS mean, round(stddev_pop(score), 4) + 0.0 AS std FROM e GROUP BY alpha"""


@query("mod4_ridge_scaled_in_folds", _scaled_in_folds_sql())
def mod4_scaled(spark, sf):
    """Scaling and the choice of the two best columns are fitted inside every fold."""
    df = fx_line(spark, sf).select("row_id", *_LINE_FEATURES, "l_extendedprice")
    df = folds(spread(df), "row_id", 5).persist()
    found = infold.chain_search(df, _LINE_FEATURES, "l_extendedprice", "fold", "regression", _CHAIN_ALPHA, [2], "f")
    df.unpersist()
    out = found.table(spark).drop("best")
    return out.withColumn("mean", F.round("mean", 4) + 0.0).withColumn("std", F.round("std", 4) + 0.0)


@query("mod4_logistic_chain_in_folds")
def mod4_logistic(spark, sf):
    """A balanced logistic chain over (C, number of columns), chosen by MRMR inside every fold."""
    df, cols = _encoded(spark, sf)
    df = folds(df, "row_id", 5, "y").persist()
    found = infold.chain_search(df, cols, "y", "fold", "classification", linear.LOGISTIC_C, [2, 4, len(cols)], "mrmr")
    df.unpersist()
    return rounded(found.table(spark), "mean", "std")


def _newton_sql(steps: int = 30) -> str:
    """Balanced L2 logistic regression of two columns by Newton steps, solved by Cramer's rule."""
    det = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
    d0 = "(g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2))"
    d1 = "(h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02))"
    d2 = "(h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02))"
    return f"""
WITH RECURSIVE fx AS ({CUST}), n AS (SELECT count(*) AS n, sum(label) AS n1 FROM fx),
t AS MATERIALIZED (SELECT n_orders / 10.0::DOUBLE AS x1, c_acctbal / 10000.0::DOUBLE AS x2, label::DOUBLE AS y,
  CASE WHEN label = 1 THEN n / (2.0 * n1) ELSE n / (2.0 * (n - n1)) END AS w FROM fx, n),
it(k, b0, b1, b2) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT k + 1, b0 - {d0} / {det}, b1 - {d1} / {det}, b2 - {d2} / {det} FROM (
    SELECT k, b0, b1, b2, sum(w * (p - y)) AS g0, sum(w * (p - y) * x1) + b1 AS g1, sum(w * (p - y) * x2) + b2 AS g2,
      sum(q) AS h00, sum(q * x1) AS h01, sum(q * x2) AS h02, sum(q * x1 * x1) + 1 AS h11, sum(q * x1 * x2) AS h12, sum(q * x2 * x2) + 1 AS h22
    FROM (SELECT *, w * p * (1 - p) AS q FROM (SELECT it.*, t.*, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM it, t WHERE k < {steps}))
    GROUP BY k, b0, b1, b2)),
z AS (SELECT * FROM it WHERE k = {steps})
SELECT 'intercept' AS feature, round(b0, 4) + 0.0 AS coef FROM z UNION ALL SELECT 'x1', round(b1, 4) + 0.0 FROM z UNION ALL SELECT 'x2', round(b2, 4) + 0.0 FROM z"""


@query("mod1_balanced_logistic_two_columns", _newton_sql())
def mod1_two(spark, sf):
    df = fx_cust(spark, sf).select((F.col("n_orders") / 10).alias("x1"), (F.col("c_acctbal") / 10000).alias("x2"), "label")
    model = linear.logistic_ml(df, ["x1", "x2"], "label")
    rows = [("intercept", float(model.intercept)), *zip(["x1", "x2"], map(float, model.coefficients.toArray()), strict=True)]
    return _pairs(spark, rows, "feature string, coef double").withColumn("coef", F.round("coef", 4) + 0.0)


@query("mod1_balanced_logistic")
def mod1(spark, sf):
    df, cols = _encoded(spark, sf)
    model = linear.logistic_ml(df, cols, "y")
    rows = [(c, float(v)) for c, v in zip(cols, model.coefficients.toArray(), strict=True)]
    return rounded(_pairs(spark, rows, "feature string, coef double"), "coef")


@query("mod3_logistic_grid_search")
def mod3(spark, sf):
    df, cols = _encoded(spark, sf)
    df = folds(df, "row_id", 5, "y").persist()
    rows, best, _, _ = linear.grid_search(df, cols, "y", "fold", "classification")
    df.unpersist()
    out = _pairs(spark, rows, "penalty double, mean double, std double")
    return rounded(out.withColumn("best", F.col("penalty") == best), "mean", "std")


def _ridge_grid_sql() -> str:
    alphas = ", ".join(f"({float(a)}::DOUBLE)" for a in linear.RIDGE_ALPHA)
    return f"""
WITH fx AS ({CUST}), t AS (SELECT n_orders AS a, n_urgent AS b, avg_total AS y, ntile(5) OVER (ORDER BY row_id) - 1 AS fold FROM fx),
folds AS (SELECT unnest(range(5)) AS f), m AS (SELECT f, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM t, folds WHERE fold <> f GROUP BY f),
s AS (SELECT f, any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my, sum((a - ma) ** 2) AS aa, sum((b - mb) ** 2) AS bb, sum((a - ma) * (b - mb)) AS ab,
  sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS byy FROM t, m WHERE fold <> f GROUP BY f),
w AS (SELECT f, alpha, ma, mb, my, (ay * (bb + alpha) - byy * ab) / ((aa + alpha) * (bb + alpha) - ab * ab) AS w1,
  (byy * (aa + alpha) - ay * ab) / ((aa + alpha) * (bb + alpha) - ab * ab) AS w2 FROM s, (VALUES {alphas}) g(alpha)),
e AS (SELECT alpha, f, -avg(abs(y - (my + w1 * (a - ma) + w2 * (b - mb)))) AS score FROM t JOIN w ON fold = f GROUP BY alpha, f)
SELECT alpha AS penalty, round(avg(score), 4) + 0.0 AS mean, round(stddev_pop(score), 4) + 0.0 AS std FROM e GROUP BY alpha"""


@query("mod3_ridge_grid_two_features", _ridge_grid_sql())
def mod3_ridge_two(spark, sf):
    df = block_folds(fx_cust(spark, sf), "row_id", 5).persist()
    rows, _, _, _ = linear.grid_search(df, ["n_orders", "n_urgent"], "avg_total", "fold", "regression")
    df.unpersist()
    out = _pairs(spark, rows, "penalty double, mean double, std double")
    return out.select("penalty", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("mod3_ridge_grid_search")
def mod3_ridge(spark, sf):
    df, cols = _encoded(spark, sf, label="avg_total")
    df = block_folds(df, "row_id", 5).persist()
    rows, best, _, _ = linear.grid_search(df, cols, "y", "fold", "regression")
    df.unpersist()
    out = _pairs(spark, rows, "penalty double, mean double, std double")
    return out.select("penalty", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), (F.col("penalty") == best).alias("best"))


@query("mod4_mod5_udf2_udf7_fitted_chain")
def mod4(spark, sf):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    df = split(fx_cust(spark, sf), "row_id", "label")
    train = take_split(df, "train")
    encoder = MixedEncoder(CUST_NUM, _CAT)
    names = encoder.fit(train).feature_names
    stages = [
        encoder, ColumnFilter(names, ["row_id", "label", "split"]), VectorAssembler(inputCols=names, outputCol="features"),
        LogisticRegression(labelCol="label", standardization=False, regParam=0.01),
    ]
    fitted = Pipeline(stages=stages).fit(train)
    scored = fitted.transform(take_split(df, "test"))
    return scored.select("row_id", "label", r6(vector_to_array("probability")[1]).alias("prob"))


def _search(spark, sf, model, n_trials, rounds, space=None):
    df, cols = encoded_parts(fx_cust(spark, sf), "row_id", "label", CUST_NUM, _CAT, "classification", 1)
    return trials.random_search(df, cols, "label", "classification", model, n_trials, rounds, 1, space=space)


def _flat(t):
    params = F.array_join(F.transform(F.sort_array(F.map_keys("params")), lambda k: k), ",")
    return rounded(t.withColumn("params", params), "val_metric", "test_metric")


@query("mod6_tuned_linear_model")
def mod6(spark, sf):
    return _flat(_search(spark, sf, "linear", 40, 15))


@query("mod7_perceptron")
def mod7(spark, sf):
    small = dict(trials.SPACES["mlp"], d_hidden=("int", 8, 32))
    return _flat(_search(spark, sf, "mlp", 2, 15, small))


@query("mod8_boosted_trees_by_leaves")
def mod8(spark, sf):
    return _flat(_search(spark, sf, "lgb", 2, 5))


@query("mod9_boosted_trees_by_depth")
def mod9(spark, sf):
    small = dict(trials.SPACES["xgb"], max_depth=("int", 3, 6))
    return _flat(_search(spark, sf, "xgb", 2, 5, small))


@query("mod11_udf5_random_search_best")
def mod11(spark, sf):
    return rounded(trials.best_of(_search(spark, sf, "linear", 40, 15), "classification"), "test_metric")


# --- selection by statistics and fits ------------------------------------------------------------------


@query("sel9_udf3_filter_by_mutual_information", f"""
WITH fx AS ({LINE}), ranked AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS p, count(*) OVER (PARTITION BY feature) AS n
  FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value FROM fx" for c in LINE_NUM)})),
edges AS (SELECT feature, value AS e FROM ranked, range(1, 10) t(j) WHERE p = floor(j * n / 10.0)), dist AS (SELECT DISTINCT feature, value FROM ranked),
bins AS (SELECT feature, value, (SELECT count(*) FROM edges WHERE edges.feature = dist.feature AND e <= dist.value) AS x FROM dist),
long AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value, label AS y FROM fx" for c in LINE_NUM)}),
cnt AS (SELECT feature, x, y, count(*) AS n FROM long JOIN bins USING (feature, value) GROUP BY ALL), tot AS (SELECT feature, sum(n) AS t FROM cnt GROUP BY feature),
px AS (SELECT feature, x, sum(n) AS nx FROM cnt GROUP BY ALL), py AS (SELECT feature, y, sum(n) AS ny FROM cnt GROUP BY ALL),
mi AS (SELECT feature, greatest(sum(n / t::DOUBLE * ln(n * t::DOUBLE / (nx * ny))), 0) AS score FROM cnt JOIN tot USING (feature) JOIN px USING (feature, x) JOIN py USING (feature, y) GROUP BY feature)
SELECT feature, {d6('score')} AS score FROM mi WHERE score > (SELECT quantile_cont(score, 0.5) FROM mi)""")
def sel9(spark, sf):
    return rounded(sel.filter_features(fx_line(spark, sf), LINE_NUM, "label", "classification", 0.5), "score")


@query("sel10_mrmr")
def sel10(spark, sf):
    df, cols = _encoded(spark, sf)
    return rounded(sel.select_features(df, cols, "y", "mrmr", topk=len(cols)), "score")


def _mrmr_sql(source: str = CUST) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS v, label FROM fx" for c in CUST_NUM)
    corr = " UNION ALL ".join(
        f"SELECT '{a}' AS p, '{b}' AS q, greatest(abs(corr({a}::DOUBLE, {b}::DOUBLE)), 0.001) AS r FROM fx"
        for a in CUST_NUM for b in CUST_NUM if a != b)
    picks = []
    for step in range(1, len(CUST_NUM)):
        prior = " UNION ALL ".join(f"SELECT feature FROM s{i}" for i in range(step))
        picks.append(
            f"s{step} AS (SELECT f.feature, f.f / avg(c.r) AS score, {step} AS pos FROM f JOIN c ON c.p = f.feature "
            f"WHERE c.q IN ({prior}) AND f.feature NOT IN ({prior}) GROUP BY f.feature, f.f ORDER BY score DESC LIMIT 1)")
    allp = " UNION ALL ".join(f"SELECT feature, {d6('score')} AS score, pos::INT AS pos FROM s{i}" for i in range(len(CUST_NUM)))
    return f"""
WITH fx AS ({source}), long AS ({long}), pc AS (SELECT feature, label, count(v) AS nc, avg(v) AS mu, var_pop(v) AS va FROM long GROUP BY ALL),
ov AS (SELECT feature, count(v) AS n, avg(v) AS m FROM long GROUP BY feature),
f AS (SELECT feature, sum(nc * (mu - m) ** 2) / (sum(nc * va) / (any_value(n) - 2)) AS f FROM pc JOIN ov USING (feature) GROUP BY feature),
c AS ({corr}), s0 AS (SELECT feature, f AS score, 0 AS pos FROM f ORDER BY f DESC LIMIT 1), {", ".join(picks)} {allp}"""


@query("sel10_mrmr_numeric", _mrmr_sql())
def sel10_num(spark, sf):
    out = sel.select_features(fx_cust(spark, sf), CUST_NUM, "label", "mrmr", topk=len(CUST_NUM))
    return rounded(out, "score")


@query("sel10_mrmr_with_missing", _mrmr_sql(_GAPS.format(CUST)))
def sel10_gaps(spark, sf):
    out = sel.select_features(with_gaps(fx_cust(spark, sf)), CUST_NUM, "label", "mrmr", topk=len(CUST_NUM))
    return rounded(out, "score")


@query("sel10_mrmr_with_nan", _mrmr_sql(_GAPS.format(CUST)))
def sel10_nan(spark, sf):
    out = sel.select_features(with_nans(fx_cust(spark, sf)), CUST_NUM, "label", "mrmr", topk=len(CUST_NUM))
    return rounded(out, "score")


def _mrmr_embeddings_sql(k: int) -> str:
    picks = []
    for step in range(1, k):
        prior = " UNION ALL ".join(f"SELECT feature FROM s{i}" for i in range(step))
        picks.append(
            f"s{step} AS MATERIALIZED (SELECT f.feature, f.f / avg(c.r) AS score, {step} AS pos FROM f JOIN c ON c.p = f.feature "
            f"WHERE c.q IN ({prior}) AND f.feature NOT IN ({prior}) GROUP BY f.feature, f.f ORDER BY score DESC LIMIT 1)")
    every = " UNION ALL ".join(f"SELECT feature, {d6('score')} AS score, pos::INT AS pos FROM s{i}" for i in range(k))
    return f"""
WITH long AS MATERIALIZED (SELECT vec_id, label, 'e' || unnest(range(64)) AS feature, unnest(embedding)::DOUBLE AS v FROM embeddings),
pc AS (SELECT feature, label, count(v) AS nc, avg(v) AS mu, var_pop(v) AS va FROM long GROUP BY ALL),
ov AS (SELECT feature, count(v) AS n, avg(v) AS m FROM long GROUP BY feature),
f AS MATERIALIZED (SELECT feature, (sum(nc * (mu - m) ** 2) / (count(*) - 1)) / (sum(nc * va) / (any_value(n) - count(*))) AS f FROM pc JOIN ov USING (feature) GROUP BY feature),
c AS MATERIALIZED (SELECT a.feature AS p, b.feature AS q, greatest(abs(corr(a.v, b.v)), 0.001) AS r
  FROM long a JOIN long b USING (vec_id) WHERE a.feature <> b.feature GROUP BY ALL),
s0 AS MATERIALIZED (SELECT feature, f AS score, 0 AS pos FROM f ORDER BY f DESC LIMIT 1), {", ".join(picks)} {every}"""


@query("sel10_mrmr_embeddings", _mrmr_embeddings_sql(20))
def sel10_vec(spark, sf):
    df = table(spark, sf, "embeddings")
    cols = [f"e{i}" for i in range(64)]
    wide = df.select("label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    return rounded(sel.select_features(wide, cols, "label", "mrmr", topk=20), "score")


@query("sel11_lasso")
def sel11(spark, sf):
    df, cols = _encoded(spark, sf, label="avg_total")
    return sel.select_features(df, cols, "y", "lasso", "regression", strength=100.0).withColumn("score", F.round("score", 2))


_PATH_COLUMNS = {"n_orders": 10.0, "n_urgent": 5.0, "avg_total": 200000.0, "c_acctbal": 10000.0}


def _violations(df, cols, label, task, penalties, groups, sizes):
    """(penalty, grp, violation): by how much each group breaks the optimality conditions, from plain averages."""
    found = sparse_path(df, cols, label, task, penalties, groups, sizes=sizes)
    aggs = []
    for i, (b, w) in enumerate(found):
        margin = sum((F.col(c) * float(v) for c, v in zip(cols, w, strict=True)), F.lit(float(b)))
        error = (1 / (1 + F.exp(-margin)) if task == "classification" else margin) - F.col(label)
        aggs += [F.avg(error * F.col(c)).alias(f"{i}_{j}") for j, c in enumerate(cols)]
    grads = df.agg(*aggs).first()
    rows = []
    for i, (lam, (_, w)) in enumerate(zip(penalties, found, strict=True)):
        for g in sorted(set(groups)):
            idx = [j for j, k in enumerate(groups) if k == g]
            grad, beta = np.array([grads[f"{i}_{j}"] for j in idx]), w[idx]
            pen, size = lam / (np.sqrt(len(idx)) if sizes else 1.0), np.linalg.norm(beta)
            gap = np.linalg.norm(grad + pen * beta / size) if size else max(0.0, np.linalg.norm(grad) - pen)
            rows.append((float(lam), g, float(gap)))
    return rounded(df.sparkSession.createDataFrame(rows, "penalty double, grp int, violation double"), "violation")


def _no_violation_sql(penalties, n_groups):
    lams = ", ".join(f"({float(x)}::DOUBLE)" for x in penalties)
    return f"SELECT p.v AS penalty, g.v::INT AS grp, 0.0::DOUBLE AS violation FROM (VALUES {lams}) p(v), range(0, {n_groups}) g(v)"


def _path_rows(spark, sf):
    return fx_cust(spark, sf).select(*[(F.col(c) / s).alias(c) for c, s in _PATH_COLUMNS.items()], F.col("label").cast("double").alias("label")).persist()


@query("sel16_group_lasso_optimality", _no_violation_sql([*linear.GROUP_LAMBDAS, 0.0], 3))
def sel16_optimal(spark, sf):
    df = _path_rows(spark, sf)
    return _violations(df, list(_PATH_COLUMNS), "label", "classification", [*linear.GROUP_LAMBDAS, 0.0], [0, 0, 1, 2], True)


@query("sel11_lasso_optimality", _no_violation_sql([0.0005, 0.01, 0.05, 0.1, 1.0], 3))
def sel11_optimal(spark, sf):
    df, cols = _path_rows(spark, sf), ["n_orders", "n_urgent", "c_acctbal"]
    return _violations(df, cols, "avg_total", "regression", [0.0005, 0.01, 0.05, 0.1, 1.0], [0, 1, 2], False)


@query("sel12_recursive_elimination")
def sel12(spark, sf):
    df, cols = _encoded(spark, sf, label="avg_total")
    return sel.select_features(df, cols, "y", "rfe", "regression", topk=len(cols)).drop("score")


@query("sel13_udf4_forward_selection")
def sel13(spark, sf):
    df, cols = _encoded(spark, sf, label="avg_total")
    df = block_folds(df, "row_id", 5).persist()
    out = sel.select_features(df, cols, "y", "forward-seq", "regression", topk=len(cols), fold="fold")
    df.unpersist()
    return out.withColumn("score", F.round("score", 3))


@query("sel13_backward_selection")
def sel13_back(spark, sf):
    df, cols = _encoded(spark, sf, label="avg_total")
    df = block_folds(df, "row_id", 5).persist()
    out = sel.select_features(df, cols, "y", "backward-seq", "regression", topk=len(cols), fold="fold")
    df.unpersist()
    return out.drop("score")


@query("sel13_forward_selection_logistic")
def sel13_log(spark, sf):
    df = folds(fx_cust(spark, sf).withColumn("y", F.col("label").cast("double")), "row_id", 5, "y")
    model = MixedEncoder(CUST_NUM, []).fit(df)
    enc = model.transform(df).persist()
    out = sel.select_features(enc, CUST_NUM, "y", "forward-seq", "classification", topk=len(CUST_NUM), fold="fold")
    enc.unpersist()
    return out.withColumn("score", F.round("score", 4))


@query("sel15_udf6_sequential_by_replies")
def sel15(spark, sf):
    df, cols = _encoded(spark, sf, label="avg_total")
    g = stats.gram(df, [*cols, "y"])[0]

    def score(chosen):  # R^2 of the ridge fit, from the one Gram matrix
        b, w = linear.ridge_solve(g, 1.0, [cols.index(c) for c in chosen])
        beta = np.zeros(g.shape[0])
        beta[0], beta[-1] = b, -1.0
        for c, v in zip(chosen, w, strict=True):
            beta[1 + cols.index(c)] = v
        mean = g[0, -1] / g[0, 0]
        return float(1 - beta @ g @ beta / (g[-1, -1] - g[0, 0] * mean * mean))

    ranked = {r["feature"]: r["score"] for r in stats.pearson(df, cols, "y").collect()}  # one row per feature
    ask = lambda prompt: max((c for c in cols if c in prompt.split("from:")[1]), key=lambda c: ranked[c] or 0.0)
    order = sequential_selection(cols, ask, score, "R2", scores=ranked, buffer=5)
    return rounded(_pairs(spark, [(i, c, s) for i, (c, s) in enumerate(order)], "pos int, concept string, score double"), "score")


@query("sel16_group_lasso_path")
def sel16(spark, sf):
    parts, cols = encoded_parts(fx_cust(spark, sf), "row_id", "label", CUST_NUM, _CAT, "classification", 1)
    parts = parts.persist()
    groups, prefixes = [], {}
    for c in cols:
        concept = next((k for k in _CAT if c.startswith(k + "_")), c)
        groups.append(prefixes.setdefault(concept, len(prefixes)))
    rows = linear.group_lasso_path(take_split(parts, "train"), cols, "label", groups, evaluate_on=take_split(parts, "val"))
    parts.unpersist()
    return _pairs(spark, [(s, lam, n, a, ",".join(f)) for s, lam, n, a, f in rows],
                  "step int, lambda double, n_selected int, auroc double, features string").withColumn("auroc", F.round("auroc", 4))


# --- importance ---------------------------------------------------------------------------------------------


_PERM = f"""
WITH fx AS ({CUST}), t AS (SELECT row_id, n_orders AS a, n_urgent AS b, avg_total AS y, label FROM fx),
own AS (SELECT *, row_number() OVER (ORDER BY {duck_hash('own1', 'row_id')}, row_id) - 1 AS p FROM t),
don AS (SELECT r, a AS da, b AS db, row_number() OVER (PARTITION BY r ORDER BY {duck_hash('perm1', 'r', 'row_id')}, row_id) - 1 AS p FROM t, range(0, 30) u(r)),
"""


@query("imp1_permutation_importance_fixed_weights", _PERM + """
sc AS (SELECT r, abs(y - (1000 + 20000 * a - 900 * b)) AS e0, abs(y - (1000 + 20000 * da - 900 * b)) AS ea, abs(y - (1000 + 20000 * a - 900 * db)) AS eb FROM don JOIN own USING (p))
SELECT 'n_orders' AS feature, round(avg(ea) - avg(e0), 4) + 0.0 AS score FROM sc UNION ALL SELECT 'n_urgent', round(avg(eb) - avg(e0), 4) + 0.0 FROM sc""")
def imp1_fixed(spark, sf):
    out = imp.permutation(fx_cust(spark, sf), "row_id", ["n_orders", "n_urgent"], "avg_total", 1000.0, [20000.0, -900.0], "regression", 30)
    return out.withColumn("score", F.round("score", 4) + 0.0)


@query("imp1_permutation_auroc_fixed_weights", _PERM + f"""
sc AS (SELECT r, label, 3.0 * da - 1.0 * b AS sa, 3.0 * a - 1.0 * db AS sb, 3.0 * a - 1.0 * b AS s0 FROM don JOIN own USING (p)),
long AS (SELECT r, label, 'n_orders' AS feature, sa AS s FROM sc UNION ALL SELECT r, label, 'n_urgent', sb FROM sc UNION ALL SELECT r, label, 'base', s0 FROM sc),
rk AS (SELECT r, feature, label, rank() OVER w + (count(*) OVER (PARTITION BY r, feature, s) - 1) / 2.0 AS k FROM long WINDOW w AS (PARTITION BY r, feature ORDER BY s)),
au AS (SELECT r, feature, (sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
  / (count(*) FILTER (label = 1)::DOUBLE * count(*) FILTER (label = 0)) AS v FROM rk GROUP BY r, feature),
av AS (SELECT feature, avg(v) AS v FROM au GROUP BY feature)
SELECT feature, {d6("(SELECT v FROM av WHERE feature = 'base') - v")} AS score FROM av WHERE feature <> 'base'""")
def imp1_auc_fixed(spark, sf):
    out = imp.permutation(fx_cust(spark, sf), "row_id", ["n_orders", "n_urgent"], "label", 0.0, [3.0, -1.0], "classification", 30)
    return rounded(out, "score")


@query("imp1_permutation_importance")
def imp1(spark, sf):
    df, cols = _encoded(spark, sf, label="avg_total")
    b, w = linear.ridge_fit(df, cols, "y", 1.0)
    return imp.permutation(df, "row_id", cols, "y", b, w, "regression", n_repeats=30).withColumn("score", F.round("score", 3))


@query("imp1_permutation_importance_auroc")
def imp1_auc(spark, sf):
    parts, cols = encoded_parts(fx_cust(spark, sf), "row_id", "label", CUST_NUM, _CAT, "classification", 1)
    model = linear.logistic_ml(parts.filter("split != 'test'"), cols, "label")
    test = parts.filter("split = 'test'")
    out = imp.permutation(test, "row_id", cols, "label", model.intercept, model.coefficients.toArray(), "classification", n_repeats=30)
    return rounded(out, "score")


@query("imp2_linear_shapley_values", f"""
WITH fx AS ({CUST}), m AS (SELECT avg(n_orders) AS a, avg(n_urgent) AS b FROM fx)
SELECT row_id, {d6('2.5 * (n_orders - a)')} AS n_orders, {d6('-1.25 * (n_urgent - b)')} AS n_urgent FROM fx, m""")
def imp2(spark, sf):
    df, cols = fx_cust(spark, sf), ["n_orders", "n_urgent"]
    mean = df.agg(*[F.avg(c) for c in cols]).first()
    return rounded(imp.linear_shap(df, cols, [2.5, -1.25], mean, ["row_id"]), *cols)


@query("imp2_mean_absolute_shapley", f"""
WITH fx AS ({CUST}), m AS (SELECT avg(n_orders) AS a, avg(n_urgent) AS b FROM fx)
SELECT 'n_orders' AS feature, {d6('avg(abs(2.5 * (n_orders - a)))')} AS score FROM fx, m UNION ALL SELECT 'n_urgent', {d6('avg(abs(-1.25 * (n_urgent - b)))')} FROM fx, m""")
def imp2_mean(spark, sf):
    df, cols = fx_cust(spark, sf), ["n_orders", "n_urgent"]
    mean = df.agg(*[F.avg(c) for c in cols]).first()
    return rounded(imp.mean_abs(imp.linear_shap(df, cols, [2.5, -1.25], mean), cols), "score")


@query("imp3_sampled_shapley_of_trees")
def imp3(spark, sf):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    df, cols = _encoded(spark, sf, label="avg_total")
    vec = df.withColumn("features", array_to_vector(linear.features_array(cols)))
    model = GBTRegressor(labelCol="y", maxIter=5, maxDepth=3, seed=1).fit(vec)
    mean = list(df.agg(*[F.avg(F.col(f"`{c}`")) for c in cols]).first())

    def predict(x):
        return model.transform(x.withColumn("features", array_to_vector("x"))).drop("features")

    values = imp.sampled_shap(df, "row_id", cols, predict, [mean], n_orders=4)
    return values.groupBy("feature").agg(F.round(F.avg(F.abs("value")), 2).alias("score"))


@query("imp3_sampled_shapley_of_a_linear_model", f"""
WITH fx AS ({CUST}) SELECT 'n_orders' AS feature, {d6('avg(abs(2.5 * (n_orders - 7)))')} AS score FROM fx
UNION ALL SELECT 'n_urgent', {d6('avg(abs(-1.25 * (n_urgent - 2)))')} FROM fx""")
def imp3_linear(spark, sf):
    predict = lambda x: x.withColumn("prediction", F.col("x")[0] * 2.5 - F.col("x")[1] * 1.25)
    values = imp.sampled_shap(fx_cust(spark, sf), "row_id", ["n_orders", "n_urgent"], predict, [[7.0, 2.0]], n_orders=4)
    return rounded(values.groupBy("feature").agg(F.avg(F.abs("value")).alias("score")), "score")


@query("imp4_kmeans_sweep")
def imp4(spark, sf):
    df = table(spark, sf, "embeddings")
    cols = [f"e{i}" for i in range(64)]
    wide = df.select(*[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    curve, best, _ = imp.kmeans_sweep(wide, cols)
    return curve.select("k", F.round("inertia", 2).alias("inertia"), (F.col("k") == best).alias("knee"))


# --- experiments ----------------------------------------------------------------------------------------------


@query("exp1_selection_comparison")
def exp1(spark, sf):
    out = compare_selection(
        fx_cust(spark, sf), "row_id", "label", CUST_NUM, _CAT, "classification",
        ["filter-mi", "mrmr", "random-feature", "rfe"], [0.25, 0.5, 0.75, 1.0], [1, 2],
    )
    return rounded(out, "frac", "mean", "std")


@query("exp1_lasso_strengths")
def exp1_lasso(spark, sf):
    out = compare_selection(
        fx_cust(spark, sf), "row_id", "label", CUST_NUM, _CAT, "classification",
        ["lasso"], [], [1], strengths=[0.0005, 0.01, 0.05, 0.1, 1.0],
    )
    return rounded(out, "frac", "mean", "std")


@query("exp2_tuned_model_comparison")
def exp2(spark, sf):
    masks = {("all", 1.0): None, ("numeric", 0.5): CUST_NUM}
    out = compare_models(fx_cust(spark, sf), "row_id", "label", CUST_NUM, _CAT, "classification", ["linear"], masks, [1], n_trials=40)
    return rounded(out, "test_metric")
