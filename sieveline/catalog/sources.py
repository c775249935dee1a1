"""Queries: scans and sinks (SRC1-SRC14, SNK1-SNK5), FIL8, EXP3.

Each source query writes a given table in the source's format to the session's
shared scratch folder and scans it back with the library reader.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.catalog import query, rounded9, table
from sieveline.catalog.fixtures import (
    BINS, COMPLETIONS, PATHS, SCORES, d9, duck_hash, fx_bins, fx_completions, fx_paths, fx_scores,
)
from sieveline.operators.report import missing_keys
from sieveline.operators.select import by_ratio
from sieveline.operators.textpipe import parse_scores
from sieveline.runtime import scratch_path
from sieveline.sources import readers, sinks

_CSV_COLS = "l_orderkey BIGINT, l_quantity DOUBLE, l_discount DOUBLE, l_returnflag STRING, l_shipdate DATE"
_CSV_SQL = "SELECT l_orderkey, l_quantity, l_discount, l_returnflag, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate FROM lineitem"


def _line_csv(df):
    return df.select(
        "l_orderkey", "l_quantity", "l_discount", "l_returnflag", F.col("l_shipdate").cast("date").alias("l_shipdate")
    )


@query("src1_csv_scan", _CSV_SQL)
def src1(spark, sf):
    path = scratch_path(spark, "src1")
    _line_csv(table(spark, sf, "lineitem")).write.option("header", True).csv(path)
    return readers.read_csv(spark, path, _CSV_COLS).withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


@query("src2_stacked_semicolon_csv", "SELECT p_partkey, p_name, p_retailprice FROM part")
def src2(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    paths = []
    for parity in (0, 1):
        paths.append(scratch_path(spark, "src2"))
        part.filter(F.col("p_partkey") % 2 == parity).write.option("header", True).option("sep", ";").csv(paths[-1])
    return readers.read_csv(spark, paths, "p_partkey BIGINT, p_name STRING, p_retailprice DOUBLE", sep=";")


@query("src3_arff_scan", """
SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, p_name, CASE WHEN p_size = 7 THEN NULL ELSE p_type END AS p_type,
       p_retailprice FROM part""")
def src3(spark, sf):
    root = scratch_path(spark, "src3")
    header = [
        "% a comment", "@RELATION parts", "", "@ATTRIBUTE p_partkey INTEGER", "@attribute 'p_name' string",
        "@attribute p_type {'ECONOMY', other}", "@attribute p_retailprice real % price", "@DATA",
    ]
    spark.createDataFrame([(h,) for h in header], "value string").coalesce(1).write.text(f"{root}/a")
    quoted = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    kind = F.when(F.col("p_size") == 7, F.lit("?")).otherwise(quoted("p_type"))
    row = F.concat_ws(",", F.col("p_partkey").cast("string"), quoted("p_name"), kind, F.col("p_retailprice").cast("string"))
    table(spark, sf, "part").select(row.alias("value")).write.text(f"{root}/b")
    return readers.read_arff(spark, [f"{root}/a", f"{root}/b"])


@query("src4_staged_csv_with_missing", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders""")
def src4(spark, sf):
    path = scratch_path(spark, "src4")
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    table(spark, sf, "orders").select("o_orderkey", price.alias("o_totalprice")).write.option("header", True).csv(path)
    return readers.read_csv(spark, path, "o_orderkey BIGINT, o_totalprice DOUBLE")


@query("src5_survey_partitions", """
SELECT n_name AS state, count(*) AS n, round(sum(c_acctbal), 4) + 0.0 AS total
FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE n_name IN (SELECT n_name FROM nation WHERE n_regionkey = 1) GROUP BY n_name""")
def src5(spark, sf):
    path = scratch_path(spark, "src5")
    nation = table(spark, sf, "nation")
    survey = table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    survey.select(
        "c_custkey", "c_acctbal", F.lit(2018).alias("year"), F.lit("1-Year").alias("horizon"), F.col("n_name").alias("state")
    ).write.partitionBy("year", "horizon", "state").parquet(path)
    states = [r["n_name"] for r in nation.filter("n_regionkey = 1").collect()]
    scan = readers.read_survey(spark, path, states, 2018, "1-Year")
    return scan.groupBy("state").agg(
        F.count(F.lit(1)).alias("n"), (F.round(F.sum("c_acctbal"), 4) + 0.0).alias("total")
    )


@query("src6_static_bundle", """
SELECT c_custkey AS entity, 'segment' AS concept, c_mktsegment AS category, 1.0::DOUBLE AS value, 1.0::DOUBLE AS mask FROM customer
UNION ALL SELECT c_custkey, 'balance', NULL, c_acctbal, 1.0 FROM customer""")
def src6(spark, sf):
    path = scratch_path(spark, "src6")
    c = table(spark, sf, "customer")
    seg = c.select(F.col("c_custkey").alias("entity"), F.lit("segment").alias("concept"),
                   F.col("c_mktsegment").alias("category"), F.lit(1.0).alias("value"), F.lit(1.0).alias("mask"))
    bal = c.select(F.col("c_custkey").alias("entity"), F.lit("balance").alias("concept"),
                   F.lit(None).cast("string").alias("category"), F.col("c_acctbal").alias("value"), F.lit(1.0).alias("mask"))
    seg.unionByName(bal).write.parquet(path)
    return spark.read.parquet(path)


@query("src7_series_bundle", f"WITH fx AS ({BINS}) SELECT entity, concept, bin, value FROM fx")
def src7(spark, sf):
    path = scratch_path(spark, "src7")
    bins = fx_bins(spark, sf)
    both = bins.withColumn("L", F.lit(720)).withColumn("bin_size", F.lit(4)).unionByName(
        bins.withColumn("L", F.lit(24)).withColumn("bin_size", F.lit(1))
    )
    both.write.partitionBy("L", "bin_size").parquet(path)
    return readers.read_series_bundle(spark, path, 720, 4).select("entity", "concept", "bin", "value")


_LISTS = """
WITH s AS (SELECT DISTINCT p_type AS concept FROM part), t AS (SELECT DISTINCT p_name AS concept FROM part)
SELECT concept, (row_number() OVER (ORDER BY concept) - 1)::INT AS pos, 'static' AS kind FROM s
UNION ALL SELECT concept, (row_number() OVER (ORDER BY concept) - 1 + (SELECT count(*) FROM s))::INT, 'series' FROM t"""


@query("src8_concept_lists", _LISTS)
def src8(spark, sf):
    part = table(spark, sf, "part")

    def listed(col, kind):
        names = sorted(r[0] for r in part.select(col).distinct().collect())  # a concept list
        return spark.createDataFrame([(n, i, kind) for i, n in enumerate(names)], "concept string, pos int, kind string")

    return readers.union_lists(listed("p_type", "static"), listed("p_name", "series"))


@query("set2_union_of_lists", f"SELECT kind, count(*) AS n, max(pos) AS last FROM ({_LISTS}) GROUP BY kind")
def set2(spark, sf):
    return src8(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))


@query("src9_concept_dictionary", """
SELECT p_name AS feature, min_by(p_type, p_partkey) AS dtype FROM part GROUP BY p_name""")
def src9(spark, sf):
    path = scratch_path(spark, "src9")
    table(spark, sf, "part").select(
        F.col("p_name").alias("feature"), F.col("p_partkey").alias("itemid"), F.col("p_type").alias("dtype")
    ).write.option("header", True).csv(path)
    mapping = readers.read_csv(spark, path, "feature STRING, itemid BIGINT, dtype STRING")
    return readers.first_by_key(mapping, "feature", "itemid", "dtype")


@query("src10_labels", "SELECT doc_id AS stay_id, CAST(quality AS DOUBLE) AS label FROM labels")
def src10(spark, sf):
    path = scratch_path(spark, "src10")
    table(spark, sf, "labels").write.option("header", True).csv(path)
    df = readers.read_csv(spark, path, "doc_id BIGINT, quality INT, toxic INT")
    return df.select(F.col("doc_id").alias("stay_id"), F.col("quality").cast("double").alias("label"))


@query("src11_prompt_texts", """
SELECT p_brand AS datapred, 'template' AS kind, 'Score ' || string_agg(DISTINCT p_name, ', ' ORDER BY p_name) AS text
FROM part GROUP BY p_brand""")
def src11(spark, sf):
    path = scratch_path(spark, "src11")
    names = F.array_join(F.sort_array(F.collect_set("p_name")), ", ")  # a concept list per brand
    texts = table(spark, sf, "part").groupBy(F.col("p_brand").alias("datapred")).agg(
        F.concat(F.lit("Score "), names).alias("value")
    )
    texts.withColumn("kind", F.lit("template")).write.partitionBy("datapred", "kind").text(path)
    whole = spark.read.text(path, wholetext=True)
    return whole.select("datapred", "kind", F.regexp_replace("value", r"\n$", "").alias("text"))


def _saved_scores(spark, sf):
    scores = fx_scores(spark, sf)
    variants = F.explode(F.array(F.lit("plain"), F.lit("context")))
    full = scores.withColumn("variant", variants).withColumn("decoding", F.lit("greedy"))
    return full.withColumn("datapred", F.lit("parts/price")).withColumn(
        "score", F.when(F.col("variant") == "context", F.col("score") * 2).otherwise(F.col("score"))
    )


@query("src12_saved_scores", f"""
WITH fx AS ({SCORES}) SELECT concept, {d9('score * 2')} AS score FROM fx WHERE llm_model = 'Brand#2'""")
def src12(spark, sf):
    path = scratch_path(spark, "src12")
    sinks.write_scores(_saved_scores(spark, sf), path)
    got = readers.read_scores(spark, path, "parts/price", "Brand#2", "greedy", "context")
    return rounded9(got.select("concept", "score"), "score")


@query("snk1_written_scores", f"""
WITH fx AS ({SCORES}) SELECT llm_model, v.variant, count(*) AS n FROM fx, (VALUES ('plain'), ('context')) v(variant) GROUP BY ALL""")
def snk1(spark, sf):
    path = scratch_path(spark, "snk1")
    sinks.write_scores(_saved_scores(spark, sf), path)
    return spark.read.parquet(path).groupBy("llm_model", "variant").agg(F.count(F.lit(1)).alias("n"))


_MASK = f"""
WITH fx AS ({SCORES}), r AS (
  SELECT *, row_number() OVER (PARTITION BY llm_model ORDER BY score DESC, {duck_hash(1, 'concept')}, concept) AS pos,
         count(*) OVER (PARTITION BY llm_model) AS n FROM fx)
"""


@query("src13_saved_mask", _MASK + "SELECT concept AS feature FROM r WHERE llm_model = 'Brand#3' AND pos <= floor(0.3::DOUBLE * n)")
def src13(spark, sf):
    path = scratch_path(spark, "src13")
    kept = by_ratio(fx_scores(spark, sf), "concept", 0.3, by=["llm_model"])
    sinks.write_masks(
        kept.select(F.col("llm_model").alias("method"), F.lit("parts").alias("datapred"), F.lit(0.3).alias("ratio"),
                    F.lit(1).alias("seed"), F.col("concept").alias("feature")), path)
    return readers.read_mask(spark, path, "parts", "Brand#3", 0.3, 1)


@query("snk2_written_masks", _MASK + "SELECT llm_model AS method, count(*) AS n FROM r WHERE pos <= floor(0.3::DOUBLE * n) GROUP BY llm_model")
def snk2(spark, sf):
    path = scratch_path(spark, "snk2")
    kept = by_ratio(fx_scores(spark, sf), "concept", 0.3, by=["llm_model"])
    sinks.write_masks(
        kept.select(F.col("llm_model").alias("method"), F.lit("parts").alias("datapred"), F.lit(0.3).alias("ratio"),
                    F.lit(1).alias("seed"), F.col("concept").alias("feature")), path)
    return spark.read.parquet(path).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("src14_prior_results", f"WITH fx AS ({PATHS}) SELECT fs_method, count(*) AS n FROM fx GROUP BY fs_method")
def src14(spark, sf):
    schema = "fs_method STRING, frac DOUBLE, metric DOUBLE"
    nothing = readers.read_if_exists(spark, scratch_path(spark, "absent"), schema)
    written = sinks.rewrite(fx_paths(spark, sf), "src14")
    both = nothing.unionByName(readers.read_if_exists(spark, written, schema))
    return both.groupBy("fs_method").agg(F.count(F.lit(1)).alias("n"))


_OLD_NEW = f"""
WITH fx AS ({PATHS}), old AS (SELECT * FROM fx WHERE frac <= 0.6), new AS (SELECT * FROM fx WHERE frac >= 0.4)
"""


@query("snk3_append_distinct", _OLD_NEW + f"""
SELECT fs_method, frac, {d9('metric')} AS metric FROM (SELECT * FROM old UNION SELECT * FROM new)""")
def snk3(spark, sf):
    fx = rounded9(fx_paths(spark, sf), "metric")
    merged = sinks.append_distinct(fx.filter("frac <= 0.6"), fx.filter("frac >= 0.4"))
    return spark.read.parquet(sinks.rewrite(merged, "snk3", ["fs_method", "frac"]))


@query("set4_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
def set4(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_tax").distinct()


@query("snk4_upsert_last_wins", _OLD_NEW + f"""
SELECT fs_method, frac, {d9('metric')} AS metric FROM old WHERE frac < 0.4
UNION ALL SELECT fs_method, frac, {d9('metric + 1')} FROM new""")
def snk4(spark, sf):
    fx = fx_paths(spark, sf)
    newer = fx.filter("frac >= 0.4").withColumn("metric", F.col("metric") + 1)
    return rounded9(sinks.upsert([fx.filter("frac <= 0.6"), newer], ["fs_method", "frac"]), "metric")


@query("snk5_rejected_completions", f"""
WITH fx AS ({COMPLETIONS}) SELECT concept, sample_id, text FROM fx WHERE sample_id % 4 = 3""")
def snk5(spark, sf):
    return sinks.rejects(parse_scores(fx_completions(spark, sf))).select("concept", "sample_id", "text")


_GRID = f"""
WITH fx AS ({PATHS}), grid AS (SELECT DISTINCT fs_method, (j / 50.0)::DOUBLE AS frac FROM fx, range(1, 51) t(j))
"""


def _grid(spark, sf):
    fx = fx_paths(spark, sf)
    sizes = F.explode(F.sequence(F.lit(1), F.lit(50)))
    grid = fx.select("fs_method").distinct().withColumn("_j", sizes)
    return grid.select("fs_method", (F.col("_j") / F.lit(50.0)).alias("frac")), fx


@query("fil8_missing_keys", _GRID + """
SELECT fs_method, round(frac, 2) AS frac FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM fx WHERE fx.fs_method = g.fs_method AND fx.frac = g.frac)""")
def fil8(spark, sf):
    grid, done = _grid(spark, sf)
    return missing_keys(grid, done, ["fs_method", "frac"]).select("fs_method", F.round("frac", 2).alias("frac"))


@query("exp3_recompute_keys", _GRID + """
SELECT fs_method, round(frac, 2) AS frac FROM grid g
WHERE fs_method = 'Brand#1' OR NOT EXISTS (SELECT 1 FROM fx WHERE fx.fs_method = g.fs_method AND fx.frac = g.frac)""")
def exp3(spark, sf):
    grid, done = _grid(spark, sf)
    todo = missing_keys(grid, done, ["fs_method", "frac"], recompute=F.col("fs_method") == "Brand#1")
    return todo.select("fs_method", F.round("frac", 2).alias("frac"))
