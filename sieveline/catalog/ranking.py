"""Queries: ranks, windows, top-k, selection from scores (WIN*, TOP*, SEL1-SEL8, SEL17-18, AGG16-18, JON7-9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.catalog import query, r9, rounded9, table
from sieveline.catalog.fixtures import LINE, LINE_NUM, PATHS, SCORES, d9, duck_hash, duck_long, fx_line, fx_paths, fx_scores
from sieveline.operators import ranks as rk
from sieveline.operators import report, stats
from sieveline.operators import select as sel
from sieveline.operators.ordering import mid_ranks

_POS = f"row_number() OVER (PARTITION BY llm_model ORDER BY score DESC, {duck_hash(1, 'concept')}, concept)"
_ORDERED = f"WITH fx AS ({SCORES}), o AS (SELECT *, {_POS} AS pos, count(*) OVER (PARTITION BY llm_model) AS n FROM fx)"


def _s(spark, sf):
    return fx_scores(spark, sf)


@query("win1_order_with_tie_break", _ORDERED + "SELECT llm_model, concept, pos::INT AS pos FROM o")
def win1(spark, sf):
    return sel.ordered(_s(spark, sf), "concept", ["llm_model"]).select("llm_model", "concept", "pos")


@query("win2_mid_ranks", f"""
WITH fx AS ({LINE}), long AS ({duck_long(LINE_NUM, '', 'fx')})
SELECT feature, value, count(*) AS n, min(r) + (count(*) - 1) / 2.0::DOUBLE AS mid_rank
FROM (SELECT feature, value, rank() OVER (PARTITION BY feature ORDER BY value) AS r FROM long) GROUP BY feature, value""")
def win2(spark, sf):
    long = stats.to_long(fx_line(spark, sf), LINE_NUM, [])
    return mid_ranks(long, ["feature"], "value", series=len(LINE_NUM)).select("feature", "value", "n", "mid_rank")


@query("win3_position_scores", _ORDERED + "SELECT llm_model, concept, (n - (pos - 1))::DOUBLE AS score FROM o")
def win3(spark, sf):
    ranked = sel.ordered(_s(spark, sf), "concept", ["llm_model"]).withColumn("pos", F.col("pos") - 1).drop("score")
    return rk.rank_scores(ranked, ["llm_model"]).select("llm_model", "concept", "score")


@query("win4_first_occurrence", """
WITH f AS (SELECT p_brand, p_name AS concept, min(p_partkey) AS p FROM part GROUP BY ALL)
SELECT p_brand, concept, (row_number() OVER (PARTITION BY p_brand ORDER BY p) - 1)::INT AS pos FROM f""")
def win4(spark, sf):
    lists = table(spark, sf, "part").select("p_brand", F.col("p_name").alias("concept"), F.col("p_partkey").alias("pos"))
    return sel.dedupe_in_order(lists, ["p_brand"])


_COLS = """
WITH f AS (SELECT DISTINCT p_type || CASE WHEN p_size % 3 = 0 THEN '_mask' ELSE '_' || p_name END AS feature, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS k FROM part),
c AS (SELECT feature, (row_number() OVER (ORDER BY k, feature) - 1)::INT AS pos FROM f)
"""


def _columns(spark, sf):
    is_mask = F.col("p_size") % 3 == 0
    name = F.concat("p_type", F.when(is_mask, F.lit("_mask")).otherwise(F.concat(F.lit("_"), "p_name")))
    names = table(spark, sf, "part").select(name.alias("feature"), is_mask.cast("int").alias("k")).distinct()
    rows = sorted((r["k"], r["feature"]) for r in names.collect())  # the column list
    return spark.createDataFrame([(f, i) for i, (_, f) in enumerate(rows)], "feature string, pos int")


@query("win5_contiguous_groups", _COLS + """
SELECT feature, pos, coalesce(sum(s) OVER (ORDER BY pos), 0)::INT AS group_id FROM (
  SELECT *, (split_part(feature, '_', 1) <> lag(split_part(feature, '_', 1)) OVER (ORDER BY pos))::INT AS s FROM c)""")
def win5(spark, sf):
    return sel.groups_contiguous(_columns(spark, sf))


@query("sel17_groups_by_prefix", _COLS + "SELECT split_part(feature, '_', 1) AS concept, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM c GROUP BY 1")
def sel17(spark, sf):
    g = sel.groups_by_prefix(_columns(spark, sf))
    return g.select("concept", F.array_join("positions", ",").alias("positions"))


_TRIALS = "SELECT p_brand AS trial, p_size AS epoch, avg(p_retailprice) / 2000 AS val_metric, min(p_retailprice) / 2000 AS test_metric FROM part GROUP BY p_brand, p_size"


def _trials(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("trial"), F.col("p_size").alias("epoch")).agg(
        (F.avg("p_retailprice") / 2000).alias("val_metric"), (F.min("p_retailprice") / 2000).alias("test_metric")
    )


_TRIAL_COLS = f"trial, epoch, {d9('val_metric')} AS val_metric, {d9('test_metric')} AS test_metric"


@query("win6_best_epoch_per_trial", f"""
SELECT {_TRIAL_COLS} FROM ({_TRIALS}) QUALIFY row_number() OVER (PARTITION BY trial ORDER BY val_metric DESC, epoch) = 1""")
def win6(spark, sf):
    return rounded9(report.best_row(_trials(spark, sf), ["trial"], "val_metric", "max", ["epoch"]), "val_metric", "test_metric")


@query("win7_best_trial", f"SELECT {_TRIAL_COLS} FROM ({_TRIALS}) ORDER BY val_metric, trial, epoch LIMIT 1")
def win7(spark, sf):
    best = report.best_row(_trials(spark, sf), [], "val_metric", "min", ["trial", "epoch"])
    return rounded9(best, "val_metric", "test_metric")


@query("mod13_trial_summary", f"""
WITH t AS ({_TRIALS}), b AS (SELECT trial FROM t ORDER BY val_metric DESC, trial, epoch LIMIT 1)
SELECT t.trial, t.epoch, {d9('t.val_metric')} AS val_metric FROM t JOIN b USING (trial)""")
def mod13(spark, sf):
    t = _trials(spark, sf)
    best = report.best_row(t, [], "val_metric", "max", ["trial", "epoch"])
    return rounded9(t.join(F.broadcast(best.select("trial")), "trial").select("trial", "epoch", "val_metric"), "val_metric")


@query("win8_early_stop", f"""
WITH t AS ({_TRIALS}), a AS (SELECT *, max(val_metric) OVER (PARTITION BY trial ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM t),
l AS (SELECT *, max(CASE WHEN prev IS NULL OR val_metric > prev THEN epoch END) OVER (PARTITION BY trial ORDER BY epoch) AS last FROM a),
s AS (SELECT *, coalesce(max((epoch - last >= 10)::INT) OVER (PARTITION BY trial ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stop FROM l)
SELECT trial, max(last) AS best_step, {d9('max(val_metric)')} AS best_value FROM s WHERE stop = 0 GROUP BY trial""")
def win8(spark, sf):
    return rounded9(report.early_stop(_trials(spark, sf), ["trial"], "epoch", "val_metric"), "best_value")


def _duck_halving() -> str:
    parts, prev = [], None
    for r in (1, 2, 4, 8):
        alive = "" if prev is None else f" AND trial IN (SELECT trial FROM h{prev})"
        parts.append(
            f"h{r} AS (SELECT {r} AS rung, trial, val_metric FROM (SELECT *, row_number() OVER (ORDER BY val_metric DESC, trial) AS rn, "
            f"count(*) OVER () AS n FROM t WHERE epoch = {r}{alive}) WHERE rn <= greatest(floor(n / 2), 1))"
        )
        prev = r
    return f"WITH t AS ({_TRIALS}), {', '.join(parts)} " + " UNION ALL ".join(
        f"SELECT rung, trial, {d9('val_metric')} AS val_metric FROM h{r}" for r in (1, 2, 4, 8))


@query("mod12_successive_halving", _duck_halving())
def mod12(spark, sf):
    return rounded9(report.halving(_trials(spark, sf), "trial", "epoch", "val_metric"), "val_metric")


@query("win9_trapezoid_steps", f"""
WITH fx AS ({PATHS}) SELECT fs_method, frac, {d9('(frac - coalesce(lag(frac) OVER w, 0)) * (metric + coalesce(lag(metric) OVER w, 0.5)) / 2')} AS piece
FROM fx WINDOW w AS (PARTITION BY fs_method ORDER BY frac)""")
def win9(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("fs_method").orderBy("frac")
    piece = (F.col("frac") - F.coalesce(F.lag("frac").over(w), F.lit(0.0))) * (
        F.col("metric") + F.coalesce(F.lag("metric").over(w), F.lit(0.5))) / 2
    return fx_paths(spark, sf).select("fs_method", "frac", r9(piece).alias("piece"))


_CURVE = "SELECT p_brand, p_size AS k, 1.0 / p_size + min(p_partkey) / 1e9 AS inertia FROM part GROUP BY p_brand, p_size"


@query("win10_knee", f"""
WITH c AS ({_CURVE}), g AS (SELECT p_brand, k, 1 - (inertia - min(inertia) OVER w) / (max(inertia) OVER w - min(inertia) OVER w)
   - (k - min(k) OVER w) / (max(k) OVER w - min(k) OVER w)::DOUBLE AS gap FROM c WINDOW w AS (PARTITION BY p_brand))
SELECT p_brand, k AS knee FROM g QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY gap DESC, k) = 1""")
def win10(spark, sf):
    curve = table(spark, sf, "part").groupBy("p_brand", F.col("p_size").alias("k")).agg(
        (F.lit(1.0) / F.first("p_size") + F.min("p_partkey") / F.lit(1e9)).alias("inertia")
    )
    return report.knee(curve, "k", "inertia", ["p_brand"])


# --- selection by score ---------------------------------------------------------------------


@query("top1_top5_per_model", _ORDERED + f"SELECT llm_model, concept, {d9('score')} AS score FROM o WHERE pos <= 5")
def top1(spark, sf):
    return rounded9(sel.by_topk(_s(spark, sf), "concept", 5, ["llm_model"]).drop("pos"), "score")


@query("top2_top_ratio_per_model", _ORDERED + f"SELECT llm_model, concept, {d9('score')} AS score FROM o WHERE pos <= floor(0.3::DOUBLE * n)")
def top2(spark, sf):
    return rounded9(sel.by_ratio(_s(spark, sf), "concept", 0.3, ["llm_model"]).drop("pos"), "score")


@query("top3_top_percentile", f"""
WITH f AS (SELECT concept, avg(score) AS score FROM ({SCORES}) GROUP BY concept), c AS (SELECT *, count(*) OVER () AS n, (SELECT quantile_cont(score, 0.7) FROM f) AS cut FROM f)
SELECT concept, {d9('score')} AS score FROM c WHERE score > cut""")
def top3(spark, sf):
    mean = _s(spark, sf).groupBy("concept").agg(F.avg("score").alias("score"))
    return rounded9(sel.top_percentile(mean, "concept", 30), "score")


@query("top4_importance_order", f"""
WITH f AS (SELECT concept, avg(score) AS score FROM ({SCORES}) GROUP BY concept)
SELECT concept, (row_number() OVER (ORDER BY score DESC, {duck_hash(1, 'concept')}, concept) - 1)::INT AS pos FROM f""")
def top4(spark, sf):
    mean = _s(spark, sf).groupBy("concept").agg(F.avg("score").alias("score"))
    return sel.ordered(mean, "concept").select("concept", (F.col("pos") - 1).cast("int").alias("pos"))


def _ranked(spark, sf):
    o = sel.ordered(_s(spark, sf), "concept", ["llm_model"])
    return o.select("llm_model", "concept", (F.col("pos") - 1).cast("int").alias("pos"))


@query("top5_prefix_by_ratio", _ORDERED + "SELECT llm_model, concept FROM o WHERE pos - 1 < floor(0.25::DOUBLE * n)")
def top5(spark, sf):
    return sel.prefix_by_ratio(_ranked(spark, sf), 0.25, ["llm_model"]).select("llm_model", "concept")


@query("top6_all_prefixes", _ORDERED + "SELECT llm_model, ratio, count(*) AS n FROM o, (VALUES (0.1::DOUBLE), (0.3), (0.5), (1.0)) t(ratio) WHERE pos - 1 < floor(ratio * n) GROUP BY ALL")
def top6(spark, sf):
    cut = sel.prefixes(_ranked(spark, sf), [0.1, 0.3, 0.5, 1.0], ["llm_model"])
    return cut.groupBy("llm_model", "ratio").agg(F.count(F.lit(1)).alias("n"))


_REG = "SELECT p_brand AS datapred, p_size AS step, (count(*) - 1)::BIGINT AS n_selected, avg(p_retailprice) / 2000 AS auroc FROM part GROUP BY p_brand, p_size"


def _reg(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("datapred"), F.col("p_size").alias("step")).agg(
        (F.count(F.lit(1)) - 1).alias("n_selected"), (F.avg("p_retailprice") / 2000).alias("auroc")
    )


@query("top7_nearest_size", f"""
SELECT datapred, step, n_selected, {d9('auroc')} AS auroc FROM ({_REG}) WHERE n_selected > 0
QUALIFY row_number() OVER (PARTITION BY datapred ORDER BY abs(n_selected - 3), step) = 1""")
def top7(spark, sf):
    return rounded9(sel.nearest_size(_reg(spark, sf), 3, ["datapred"]), "auroc")


@query("fil7_nonempty_selections", f"SELECT datapred, step, n_selected FROM ({_REG}) WHERE n_selected > 0")
def fil7(spark, sf):
    return _reg(spark, sf).filter("n_selected > 0").select("datapred", "step", "n_selected")


@query("exp6_path_with_chosen_point", f"""
WITH p AS ({_REG}), c AS (SELECT datapred, step FROM p WHERE n_selected > 0 QUALIFY row_number() OVER (PARTITION BY datapred ORDER BY abs(n_selected - 2), step) = 1)
SELECT p.datapred, p.step, n_selected, (c.step IS NOT NULL) AS chosen FROM p LEFT JOIN c ON p.datapred = c.datapred AND p.step = c.step""")
def exp6(spark, sf):
    return report.flag_chosen(_reg(spark, sf), 2, ["datapred"]).select("datapred", "step", "n_selected", "chosen")


@query("sel18_size_from_scores", f"""
WITH s AS (SELECT llm_model AS datapred, floor(0.1::DOUBLE * count(*)) AS target FROM ({SCORES}) GROUP BY llm_model)
SELECT datapred, step, n_selected FROM ({_REG}) JOIN s USING (datapred) WHERE n_selected > 0
QUALIFY row_number() OVER (PARTITION BY datapred ORDER BY abs(n_selected - target), step) = 1""")
def sel18(spark, sf):
    scores = _s(spark, sf)
    kept = sel.by_ratio(scores, "concept", 0.1, ["llm_model"]).groupBy("llm_model").agg(F.count(F.lit(1)).alias("k"))
    # a model whose share rounds down to nothing has target 0
    target = scores.select("llm_model").distinct().join(kept, "llm_model", "left").select(
        F.col("llm_model").alias("datapred"), F.coalesce("k", F.lit(0)).alias("target")
    )
    path = _reg(spark, sf).join(target, "datapred")
    return sel.nearest_size(path, "target", ["datapred"]).select("datapred", "step", "n_selected")


@query("top8_sorted_results", f"WITH fx AS ({PATHS}) SELECT fs_method, frac, {d9('metric')} AS metric FROM fx ORDER BY fs_method, frac")
def top8(spark, sf):
    return rounded9(fx_paths(spark, sf), "metric").orderBy("fs_method", "frac")


@query("top9_buffered_candidates", _ORDERED + f""", chosen AS (SELECT llm_model, concept FROM o WHERE pos <= 3),
rest AS (SELECT llm_model, concept, score FROM o WHERE pos > 3)
SELECT llm_model, concept FROM rest QUALIFY row_number() OVER (PARTITION BY llm_model ORDER BY score DESC, {duck_hash(1, 'concept')}, concept) <= 10""")
def top9(spark, sf):
    scores = _s(spark, sf)
    chosen = sel.by_topk(scores, "concept", 3, ["llm_model"]).select("llm_model", "concept")
    rest = scores.join(chosen, ["llm_model", "concept"], "left_anti")
    return sel.by_topk(rest, "concept", 10, ["llm_model"]).select("llm_model", "concept")


@query("sel1_all", "SELECT DISTINCT p_name AS feature FROM part")
def sel1(spark, sf):
    df = table(spark, sf, "part")
    names = sorted(r[0] for r in df.select("p_name").distinct().collect())  # a concept list
    return sel.select_features(df, names, "p_size", "all").select("feature")


@query("sel2_explicit_list", "SELECT DISTINCT p_name AS feature FROM part WHERE p_name LIKE 'red%'")
def sel2(spark, sf):
    df = table(spark, sf, "part")
    names = sorted(r[0] for r in df.select("p_name").distinct().collect())  # a concept list
    return sel.select_features(df, names, "p_size", "all", feature_list=[n for n in names if n.startswith("red")] + ["x"]).select("feature")


@query("sel3_score_threshold", f"WITH fx AS ({SCORES}) SELECT llm_model, concept FROM fx WHERE score >= 0.475003")
def sel3(spark, sf):
    return sel.select_by_score(_s(spark, sf), threshold=0.475003).select("llm_model", "concept")


@query("sel4_score_ratio", _ORDERED + "SELECT llm_model, concept FROM o WHERE pos <= floor(0.5::DOUBLE * n)")
def sel4(spark, sf):
    return sel.select_by_score(_s(spark, sf), ratio=0.5, by=["llm_model"]).select("llm_model", "concept")


@query("sel5_score_topk", _ORDERED + "SELECT llm_model, concept FROM o WHERE pos <= 7")
def sel5(spark, sf):
    return sel.select_by_score(_s(spark, sf), topk=7, by=["llm_model"]).select("llm_model", "concept")


def _typo(c):
    return F.concat(F.substring(c, 1, 3), F.substr(c, F.lit(5)), F.lit("s"))


# similarity by an independent quadratic program in SQL over the distinct texts
_SIM = """
RECURSIVE texts AS (SELECT DISTINCT substr(p_name, 1, 3) || substr(p_name, 5) || 's' AS a FROM part),
cons AS (SELECT concept AS b, (row_number() OVER (ORDER BY concept) - 1)::INT AS pos FROM (SELECT DISTINCT p_name AS concept FROM part)),
dp AS (
  SELECT a, b, pos, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS row FROM texts, cons
  UNION ALL
  SELECT a, b, pos, i + 1, list_reduce(list_concat([[0]], list_transform(range(1, length(b) + 1), lambda j: [j])),
      lambda acc, jj: list_append(acc, CASE WHEN a[i + 1] = b[jj[1]] THEN row[jj[1]] + 1 ELSE greatest(row[jj[1] + 1], acc[len(acc)]) END))
  FROM dp WHERE i < length(a)),
sim AS (SELECT a, b, pos, CAST(round_even(200.0 * row[len(row)] / (length(a) + length(b)), 0) AS INT) AS s FROM dp WHERE i = length(a)),
best AS (SELECT a, b AS concept, s AS similarity FROM sim QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, pos) = 1)
"""


def _concept_list(spark, sf):
    names = sorted(r[0] for r in table(spark, sf, "part").select("p_name").distinct().collect())  # a concept list
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "concept string, pos int")


@query("jon7_fuzzy_match", f"WITH {_SIM} SELECT p_partkey, concept, similarity FROM part JOIN best ON a = substr(p_name, 1, 3) || substr(p_name, 5) || 's'")
def jon7(spark, sf):
    texts = table(spark, sf, "part").select("p_partkey", _typo("p_name").alias("text"))
    return rk.fuzzy_match(texts, "text", _concept_list(spark, sf)).select("p_partkey", "concept", "similarity")


@query("sel6_ranked_list_by_ratio", f"""
WITH {_SIM}, lists AS (SELECT p_brand, p_partkey AS pos, concept FROM part JOIN best ON a = substr(p_name, 1, 3) || substr(p_name, 5) || 's'),
f AS (SELECT p_brand, concept, (row_number() OVER (PARTITION BY p_brand ORDER BY min(pos)) - 1) AS pos FROM lists GROUP BY p_brand, concept),
n AS (SELECT p_brand, count(*) AS k FROM f GROUP BY p_brand),
miss AS (SELECT p_brand, b AS concept, k + row_number() OVER (PARTITION BY p_brand ORDER BY {duck_hash(1, 'b')}, b) - 1 AS pos FROM n, cons
         WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.p_brand = n.p_brand AND f.concept = cons.b)),
full_list AS (SELECT * FROM f UNION ALL SELECT * FROM miss)
SELECT p_brand, concept, pos::INT AS pos FROM full_list WHERE pos < floor(0.6::DOUBLE * (SELECT count(*) FROM cons))""")
def sel6(spark, sf):
    lists = table(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("pos"), _typo("p_name").alias("text"))
    return sel.select_ranked(lists, ["p_brand"], _concept_list(spark, sf), ratio=0.6)


@query("set5_missing_appended", f"""
WITH cons AS (SELECT DISTINCT p_name AS concept FROM part),
f AS (SELECT p_brand, p_name AS concept, row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) - 1 AS pos FROM part GROUP BY p_brand, p_name),
n AS (SELECT p_brand, count(*) AS k FROM f GROUP BY p_brand)
SELECT p_brand, concept, pos::INT AS pos FROM (
  SELECT * FROM f UNION ALL SELECT p_brand, concept, k + row_number() OVER (PARTITION BY p_brand ORDER BY {duck_hash(1, 'concept')}, concept) - 1
  FROM n, cons WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.p_brand = n.p_brand AND f.concept = cons.concept))""")
def set5(spark, sf):
    ranked = sel.dedupe_in_order(
        table(spark, sf, "part").select("p_brand", F.col("p_name").alias("concept"), F.col("p_partkey").alias("pos")), ["p_brand"]
    )
    return sel.append_missing(ranked, ["p_brand"], _concept_list(spark, sf))


def _one_hot(spark, sf):
    """Two columns of every concept of the saved scores."""
    names = table(spark, sf, "part").select("p_name").distinct().collect()  # a concept list
    return sorted(f"{r[0]}_{s}" for r in names for s in "ab")


_M0 = "m0 AS (SELECT min(llm_model) AS m FROM fx)"


def _m0(spark, sf):
    return _s(spark, sf).agg(F.min("llm_model")).first()[0]


def _dispatched(spark, sf, method, saved=None, **size):
    df = table(spark, sf, "part")
    saved = _s(spark, sf) if saved is None else saved
    out = sel.select_features(df, _one_hot(spark, sf), "p_size", f"{method}:{_m0(spark, sf)}", saved=saved, **size)
    return out.select("feature")


_TWO = ", (VALUES ('a'), ('b')) t(s) WHERE llm_model = m"
_CUT = 0.02


@query("sel_dispatch_llm_ratio", _ORDERED + f", {_M0} SELECT concept || '_' || s AS feature FROM o, m0{_TWO} AND pos <= floor(0.3::DOUBLE * n)")
def dispatch_ratio(spark, sf):
    return _dispatched(spark, sf, "llm-ratio", ratio=0.3)


@query("sel_dispatch_llm_topk", _ORDERED + f", {_M0} SELECT concept || '_' || s AS feature FROM o, m0{_TWO} AND pos <= 7")
def dispatch_topk(spark, sf):
    return _dispatched(spark, sf, "llm-topk", topk=7)


@query("sel_dispatch_llm_threshold", _ORDERED + f", {_M0} SELECT concept || '_' || s AS feature FROM o, m0{_TWO} AND score >= {_CUT}")
def dispatch_threshold(spark, sf):
    return _dispatched(spark, sf, "llm-threshold", threshold=_CUT)


@query("sel_dispatch_llm_rank", _ORDERED + f""", {_M0},
h AS (SELECT concept, pos FROM o, m0 WHERE llm_model = m AND pos % 2 = 1),
z AS (SELECT DISTINCT concept FROM fx WHERE concept NOT IN (SELECT concept FROM h)),
k AS (SELECT concept, row_number() OVER (ORDER BY pos) AS p FROM h UNION ALL
      SELECT concept, (SELECT count(*) FROM h) + row_number() OVER (ORDER BY {duck_hash(1, 'concept')}, concept) FROM z)
SELECT concept || '_' || s AS feature FROM k, (VALUES ('a'), ('b')) t(s) WHERE p <= floor(0.8::DOUBLE * (SELECT count(*) FROM k))""")
def dispatch_rank(spark, sf):
    ranked = sel.ordered(_s(spark, sf), "concept", ["llm_model"]).filter("pos % 2 = 1")
    return _dispatched(spark, sf, "llm-rank", saved=ranked, ratio=0.8)


@query("sel8_random_concepts", f"""
WITH f AS (SELECT p_brand || '_' || p_name AS feature, p_brand AS concept FROM (SELECT DISTINCT p_brand, p_name FROM part)),
c AS (SELECT DISTINCT concept FROM f),
k AS (SELECT concept FROM c QUALIFY row_number() OVER (ORDER BY {duck_hash(4, 'concept')}, concept) <= floor(0.4::DOUBLE * count(*) OVER ()))
SELECT feature FROM f JOIN k USING (concept)""")
def sel8_concepts(spark, sf):
    df = table(spark, sf, "part")
    names = df.select(F.concat_ws("_", "p_brand", "p_name").alias("f")).distinct().collect()  # a column list
    return sel.select_features(df, sorted(r[0] for r in names), "p_size", "random-concept", ratio=0.4, seed=4).select("feature")


@query("sel8_random_concepts_and_features", f"""
WITH c AS (SELECT DISTINCT p_name AS feature FROM part)
SELECT feature FROM c QUALIFY row_number() OVER (ORDER BY {duck_hash(4, 'feature')}, feature) <= floor(0.4::DOUBLE * count(*) OVER ())""")
def sel8(spark, sf):
    df = table(spark, sf, "part")
    names = sorted(r[0] for r in df.select("p_name").distinct().collect())  # a concept list
    return sel.select_features(df, names, "p_size", "random-feature", ratio=0.4, seed=4).select("feature")


# --- agreement -------------------------------------------------------------------------------

_TAU = """
, pr AS (SELECT a.{by} AS {by}, sign(a.x - b.x) * sign(a.y - b.y) AS s, (a.x <> b.x)::INT AS ux, (a.y <> b.y)::INT AS uy
         FROM v a JOIN v b ON a.{by} = b.{by} AND a.k < b.k)
SELECT {by}, round(sum(s) / sqrt(sum(ux) * sum(uy)::DOUBLE), 9) + 0.0 AS tau FROM pr GROUP BY {by}"""


@query("agg16_kendall_tau", f"""
WITH fx AS ({SCORES}), m AS (SELECT p_name AS concept, count(*) AS y FROM part GROUP BY p_name),
v AS (SELECT llm_model, concept AS k, score AS x, y FROM fx JOIN m USING (concept))""" + _TAU.format(by="llm_model"))
def agg16(spark, sf):
    other = table(spark, sf, "part").groupBy(F.col("p_name").alias("concept")).agg(F.count(F.lit(1)).alias("y"))
    pairs = _s(spark, sf).join(other, "concept")
    return rounded9(rk.kendall_tau(pairs, "score", "y", ["llm_model"]).drop("n"), "tau")


@query("jon9_pairwise_concordance", """
WITH v AS (SELECT l_returnflag AS flag, l_quantity AS x, l_discount AS y, count(*) AS c FROM lineitem GROUP BY ALL),
n AS (SELECT flag, sum(c) AS n FROM v GROUP BY flag),
tx AS (SELECT flag, sum(t * (t - 1) / 2) AS t FROM (SELECT flag, x, sum(c) AS t FROM v GROUP BY flag, x) GROUP BY flag),
ty AS (SELECT flag, sum(t * (t - 1) / 2) AS t FROM (SELECT flag, y, sum(c) AS t FROM v GROUP BY flag, y) GROUP BY flag),
s AS (SELECT a.flag, sum(a.c * b.c * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM v a JOIN v b ON a.flag = b.flag GROUP BY a.flag)
SELECT flag, n.n::BIGINT AS n, round(s.s / sqrt((n.n * (n.n - 1) / 2 - tx.t) * (n.n * (n.n - 1) / 2 - ty.t)), 9) + 0.0 AS tau
FROM s JOIN n USING (flag) JOIN tx USING (flag) JOIN ty USING (flag)""")
def jon9(spark, sf):
    df = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return rounded9(rk.kendall_tau(df, "l_quantity", "l_discount", ["flag"]), "tau")


@query("jon8_scores_expanded_to_features", f"""
WITH fx AS ({SCORES}), f AS (SELECT p_name || '_' || p_type AS feature, avg(p_size) AS score FROM part GROUP BY 1)
SELECT llm_model, feature, {d9('fx.score')} AS concept_score, {d9('f.score')} AS feature_score FROM f JOIN fx ON split_part(feature, '_', 1) = concept""")
def jon8(spark, sf):
    feats = table(spark, sf, "part").groupBy(F.concat_ws("_", "p_name", "p_type").alias("feature")).agg(F.avg("p_size").alias("score"))
    out = rk.expand_to_features(_s(spark, sf), feats, ["llm_model"])
    return rounded9(out, "concept_score", "feature_score")


_SAMPLES = "SELECT p_brand, p_size % 5 AS sample_id, p_name AS concept, (row_number() OVER (PARTITION BY p_brand, p_size % 5 ORDER BY min(p_partkey)) - 1) AS pos FROM part GROUP BY p_brand, p_size % 5, p_name"


@query("agg17_borda", f"""
WITH s AS ({_SAMPLES}), c AS (SELECT DISTINCT p_name AS concept FROM part), n AS (SELECT count(*) AS n FROM c),
k AS (SELECT p_brand, sample_id FROM s GROUP BY ALL),
r AS (SELECT k.p_brand, c.concept, coalesce(s.pos + 1, n.n + 1) AS rk FROM k CROSS JOIN c CROSS JOIN n
      LEFT JOIN s ON s.p_brand = k.p_brand AND s.sample_id = k.sample_id AND s.concept = c.concept),
m AS (SELECT p_brand, concept, avg(rk) AS mean_rank FROM r GROUP BY ALL)
SELECT p_brand, concept, {d9('mean_rank')} AS mean_rank, (row_number() OVER (PARTITION BY p_brand ORDER BY mean_rank, concept) - 1)::INT AS pos FROM m""")
def agg17(spark, sf):
    first = table(spark, sf, "part").select(
        "p_brand", (F.col("p_size") % 5).alias("sample_id"), F.col("p_name").alias("concept"), F.col("p_partkey").alias("pos")
    )
    samples = sel.dedupe_in_order(first, ["p_brand", "sample_id"])
    return rounded9(rk.borda(samples, ["p_brand"], "sample_id", _concept_list(spark, sf)), "mean_rank")


@query("agg18_feature_to_concept", f"""
SELECT p_brand, p_name AS concept, {d9('sum(s)')} AS score FROM (SELECT p_brand, p_name, p_type, avg(p_size) AS s FROM part GROUP BY ALL) GROUP BY p_brand, p_name""")
def agg18(spark, sf):
    feats = table(spark, sf, "part").groupBy("p_brand", F.concat_ws("_", "p_name", "p_type").alias("feature")).agg(F.avg("p_size").alias("score"))
    return rounded9(rk.to_concept(feats, ["p_brand"]), "score")


@query("agg20_mean_over_seeds", f"SELECT p_name AS feature, {d9('avg(s)')} AS score FROM (SELECT p_name, p_size % 5 AS seed, max(p_retailprice) AS s FROM part GROUP BY ALL) GROUP BY p_name")
def agg20(spark, sf):
    from sieveline.operators.importance import mean_over_seeds

    per_seed = table(spark, sf, "part").groupBy(F.col("p_name").alias("feature"), (F.col("p_size") % 5).alias("seed")).agg(F.max("p_retailprice").alias("score"))
    return rounded9(mean_over_seeds(per_seed), "score")
