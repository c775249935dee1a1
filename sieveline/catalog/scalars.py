"""Queries: scalar functions (SCA*, STR*, ARR2) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.catalog import query, r6, rounded9, table
from sieveline.catalog.fixtures import COMPLETIONS, SCORES, d6, d9, fx_completions, fx_scores
from sieveline.functions import scalars as sc
from sieveline.functions import text as tx
from sieveline.operators.ranks import lcs_length, similarity
from sieveline.plans import datasets as ds


@query("sca1_arithmetic_and_log", f"""
SELECT o_orderkey, CAST(2023 - year(o_orderdate) AS INT) AS age, {d6('ln(o_totalprice)')} AS log_price FROM orders""")
def sca1(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", sc.years_since(2023, F.year("o_orderdate")).alias("age"), r6(F.log("o_totalprice")).alias("log_price")
    )


@query("sca2_whole_days", """
SELECT l_orderkey, l_linenumber, CAST(floor((epoch(l_shipdate) - epoch(o_orderdate)) / 86400.0) AS BIGINT) AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def sca2(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        "l_orderkey", "l_linenumber", sc.whole_days("o_orderdate", "l_shipdate").alias("days")
    )


@query("sca3_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y FROM orders")
def sca3(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))


@query("sca5_bytes_to_text", "SELECT p_partkey, p_name FROM part")
def sca5(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("b"))
    return raw.select("p_partkey", F.decode("b", "UTF-8").alias("p_name"))


@query("sca7_math", f"""
SELECT c_custkey, {d6('abs(c_acctbal)')} AS a, CAST(sign(c_acctbal) AS DOUBLE) AS s, {d6('sqrt(abs(c_acctbal))')} AS r,
 {d6('1 / (1 + exp(-c_acctbal / 1000))')} AS p FROM customer""")
def sca7(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        "c_custkey", r6(F.abs(b)).alias("a"), F.signum(b).alias("s"), r6(F.sqrt(F.abs(b))).alias("r"),
        r6(sc.sigmoid(b / 1000)).alias("p"),
    )


@query("str1_feature_names", "SELECT DISTINCT p_name || '_' || p_type AS feature FROM part")
def str1(spark, sf):
    return table(spark, sf, "part").select(sc.feature_name("p_name", "p_type").alias("feature")).distinct()


@query("str2_str3_concept_of_feature", """
SELECT DISTINCT feature, split_part(feature, '_', 1) AS concept, contains(feature, '_') AS one_hot FROM (
  SELECT p_name || '_' || p_type AS feature FROM part UNION ALL SELECT p_name FROM part)""")
def str2(spark, sf):
    part = table(spark, sf, "part")
    names = part.select(sc.feature_name("p_name", "p_type").alias("feature")).unionByName(part.select(F.col("p_name").alias("feature")))
    return names.distinct().select("feature", sc.concept_of("feature").alias("concept"), sc.is_one_hot("feature").alias("one_hot"))


_METHOD = "CASE p_size % 3 WHEN 0 THEN 'lasso' WHEN 1 THEN concat('llm-ratio:', p_brand, ':greedy::') ELSE concat('llm-rank:', p_brand, ':consistent:context:expls') END"


@query("str4_method_fields", f"""
SELECT p_partkey, split_part(m, ':', 1) AS method, split_part(m, ':', 2) AS llm_model, split_part(m, ':', 3) AS decoding,
 split_part(m, ':', 4) AS context, split_part(m, ':', 5) AS examples FROM (SELECT p_partkey, {_METHOD} AS m FROM part)""")
def str4(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.expr(_METHOD).alias("m"))
    return df.select("p_partkey", *[e.alias(n) for n, e in sc.method_fields("m").items()])


_CODES = list(ds.DATASET_NAMES)


@query("str5_display_names", "SELECT p_partkey, CASE p_size % 17 " + " ".join(
    f"WHEN {i} THEN '{ds.DATASET_NAMES[c]}'" for i, c in enumerate(_CODES)) + " END AS name FROM part")
def str5(spark, sf):
    codes = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("p_size") % 17 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", sc.lookup(ds.DATASET_NAMES, codes).alias("name"))


@query("exp7_model_index", "SELECT p_partkey, CASE p_size % 5 " + " ".join(
    f"WHEN {i} THEN {4 - i}" for i in range(5)) + " END AS idx FROM part")
def exp7(spark, sf):
    models = F.element_at(F.array(*[F.lit(c) for c in ds.MODEL_NAMES]), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", sc.lookup(ds.MODEL_INDEX, models).alias("idx"))


# longest common subsequence by an independent recursive program over prefixes
_LCS = """
WITH RECURSIVE pairs AS (
  SELECT DISTINCT p_name AS a, p_type AS b FROM part),
dp AS (
  SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS row FROM pairs
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_concat([[0]], list_transform(range(1, length(b) + 1), lambda j: [j])),
      lambda acc, jj: list_append(acc, CASE WHEN a[i + 1] = b[jj[1]] THEN row[jj[1]] + 1
        ELSE greatest(row[jj[1] + 1], acc[len(acc)]) END))
  FROM dp WHERE i < length(a))
SELECT a AS p_name, b AS p_type, CAST(row[len(row)] AS INT) AS lcs,
       CAST(round_even(200.0 * row[len(row)] / (length(a) + length(b)), 0) AS INT) AS similarity
FROM dp WHERE i = length(a)"""


@query("str6_similarity", _LCS)
def str6(spark, sf):
    df = table(spark, sf, "part").select("p_name", "p_type").distinct()
    a, b = F.col("p_name"), F.col("p_type")
    return df.select("p_name", "p_type", lcs_length(a, b).alias("lcs"), similarity(a, b).alias("similarity"))


@query("str7_drop_lines", f"""
WITH fx AS ({COMPLETIONS}) SELECT sample_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT contains(x, 'reasoning')), chr(10)) AS text FROM fx""")
def str7(spark, sf):
    return fx_completions(spark, sf).select("sample_id", tx.drop_lines("text", "reasoning").alias("text"))


_LISTED = "SELECT p_brand, string_agg(n || '. ' || p_name, chr(10) ORDER BY n) AS text FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS n FROM (SELECT DISTINCT p_brand, p_name FROM part)) GROUP BY p_brand"


def _brand_lists(spark, sf):
    part = table(spark, sf, "part")
    return part.groupBy("p_brand").agg(F.sort_array(F.collect_set("p_name")).alias("names"))  # a concept list per brand


@query("str9_numbered_list", _LISTED)
def str9(spark, sf):
    return _brand_lists(spark, sf).select("p_brand", tx.numbered_list("names").alias("text"))


@query("str8_numbered_items", "SELECT DISTINCT p_brand, p_name AS item FROM part")
def str8(spark, sf):
    texts = _brand_lists(spark, sf).select("p_brand", tx.numbered_list("names").alias("text"))
    return texts.select("p_brand", F.explode(tx.numbered_items("text")).alias("item"))


@query("str10_outer_braces", f"WITH fx AS ({COMPLETIONS}) SELECT sample_id, regexp_extract(text, '(?s)\\{{.*\\}}', 0) AS body FROM fx")
def str10(spark, sf):
    return fx_completions(spark, sf).select("sample_id", tx.braces("text").alias("body"))


@query("str11_parsed_reply", f"""
WITH fx AS ({COMPLETIONS}), b AS (SELECT sample_id, regexp_extract(text, '(?s)\\{{.*\\}}', 0) AS body FROM fx)
SELECT sample_id, CASE WHEN body <> '' THEN CAST(json_extract_string(body, '$.score') AS DOUBLE) END AS score,
  CASE WHEN body <> '' THEN json_extract_string(body, '$.reasoning') END AS reasoning FROM b""")
def str11(spark, sf):
    parsed = fx_completions(spark, sf).select("sample_id", tx.parse_reply(tx.braces("text")).alias("p"))
    return parsed.select("sample_id", "p.score", "p.reasoning")


@query("str12_variant_names", """
SELECT DISTINCT p_size, concat_ws('_', CASE WHEN p_size % 2 = 0 THEN 'greedy' ELSE 'consistent' END, CASE WHEN p_size % 3 = 0 THEN 'context' END,
  CASE WHEN p_size % 5 = 0 THEN 'expls' WHEN p_size % 7 = 0 THEN 'examples' END, CASE WHEN p_size % 4 = 0 THEN '0_10' WHEN p_size % 4 = 1 THEN '8_24' END) AS variant FROM part""")
def str12(spark, sf):
    s = F.col("p_size")
    df = table(spark, sf, "part").select("p_size").distinct().select(
        "p_size", F.when(s % 2 == 0, "greedy").otherwise("consistent").alias("d"),
        (s % 3 == 0).alias("c"), (s % 7 == 0).alias("e"), (s % 5 == 0).alias("x"),
        F.when(s % 4 == 1, 8).otherwise(0).alias("lo"), F.when(s % 4 == 0, 10).when(s % 4 == 1, 24).otherwise(1).alias("hi"),
    )
    return df.select("p_size", sc.variant_name("d", "c", "e", "x", "lo", "hi").alias("variant"))


@query("arr2_map_and_rows", f"WITH fx AS ({SCORES}) SELECT llm_model, concept, {d9('score')} AS score FROM fx")
def arr2(spark, sf):
    as_map = fx_scores(spark, sf).groupBy("llm_model").agg(
        F.map_from_entries(F.collect_list(F.struct("concept", "score"))).alias("m")  # one entry per concept
    )
    rows = as_map.select("llm_model", F.explode(F.map_entries("m")).alias("e"))
    return rounded9(rows.select("llm_model", F.col("e.key").alias("concept"), F.col("e.value").alias("score")), "score")


