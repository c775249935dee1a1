"""Queries: the text steps from prompts to scores and ranks (LLM1-LLM11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.catalog import query, rounded9, table
from sieveline.catalog.fixtures import COMPLETIONS, d9, fx_completions
from sieveline.catalog.ranking import _SIM, _concept_list, _typo
from sieveline.operators import textpipe as tp
from sieveline.plans.datasets import SCORE_RANGES


def _esc(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_TEMPLATE = "{context}\nScore features between {min_score} and {max_score}.\n{format_instructions}\n{examples}"
_CONTEXT = "You are given parts."
_EXAMPLES = 'Example:\n"reasoning": "none"\n"score": 0.5'
_SHOWN = 'Example:\n"score": 0.5'


def _texts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_type").alias("datapred")).distinct().select(
        "datapred", F.lit(_TEMPLATE).alias("template"), F.lit(_CONTEXT).alias("context"), F.lit(_EXAMPLES).alias("examples")
    )


def _prompt_concepts(spark, sf):
    model = F.when(F.col("p_size") % 2 == 0, "gpt-4-0613").otherwise("llama-2-7b-chat")
    return table(spark, sf, "part").select(
        F.col("p_type").alias("datapred"), model.alias("llm_model"), F.col("p_name").alias("concept")
    ).distinct()


def _variant_rows(ranges) -> str:
    rows = []
    for d in ("greedy", "consistent"):
        for c in (False, True):
            for e in ("none", "examples", "expls"):
                for lo, hi in ranges:
                    name = "_".join([d, *(["context"] if c else []), *([e] if e != "none" else []), *([] if (lo, hi) == (0, 1) else [str(lo), str(hi)])])
                    ctx = _CONTEXT if c else ""
                    ex = {"none": "", "examples": _SHOWN, "expls": _EXAMPLES}[e]
                    base = f"{ctx}\nScore features between {lo} and {hi}.\n{tp.SCORE_FORMAT}\n{ex}"
                    rows.append(f"('{d}', '{name}', {_esc(base)})")
    return ", ".join(rows)


def _render_sql(ranges, samples: int, where: str = "true") -> str:
    tail = "'Provide a score and reasoning for \"' || concept || '\" formatted according to the output schema above:'"
    return f"""
WITH c AS (SELECT DISTINCT p_type AS datapred, CASE WHEN p_size % 2 = 0 THEN 'gpt-4-0613' ELSE 'llama-2-7b-chat' END AS llm_model, p_name AS concept FROM part)
SELECT datapred, llm_model, decoding, variant, concept, s::INT AS sample_id,
 CASE WHEN llm_model LIKE 'llama-2%' THEN '<s>[INST] <<SYS>>' || chr(10) || base || '<</SYS>>' || chr(10) || chr(10) || {tail} || ' [/INST]' || chr(10)
  ELSE base || chr(10) || {tail} || chr(10) END AS prompt
FROM c, (VALUES {_variant_rows(ranges)}) v(decoding, variant, base), range(1, {samples + 1}) t(s) WHERE {where}"""


@query("llm1_rendered_score_prompts", _render_sql(SCORE_RANGES[:1], 2))
def llm1(spark, sf):
    return tp.render_scores(_prompt_concepts(spark, sf), _texts(spark, sf), tp.variants(spark), 2)


@query("llm9_score_range_prompts", _render_sql(SCORE_RANGES, 1))
def llm9(spark, sf):
    return tp.render_scores(_prompt_concepts(spark, sf), _texts(spark, sf), tp.variants(spark, SCORE_RANGES), 1)


@query("llm10_prompt_variants", f"""
SELECT datapred, variant, count(*) AS n FROM ({_render_sql(SCORE_RANGES[:1], 5)}) GROUP BY ALL""")
def llm10(spark, sf):
    prompts = tp.render_scores(_prompt_concepts(spark, sf), _texts(spark, sf), tp.variants(spark), 5)
    return prompts.groupBy("datapred", "variant").agg(F.count(F.lit(1)).alias("n"))


@query("llm11_prompts_of_given_concepts", _render_sql(SCORE_RANGES[:1], 1, "concept IN (SELECT p_name FROM part GROUP BY p_name HAVING avg(p_size) > 26)"))
def llm11(spark, sf):
    wanted = table(spark, sf, "part").groupBy(F.col("p_name").alias("concept")).agg(F.avg("p_size").alias("m")).filter("m > 26")
    prompts = tp.render_scores(_prompt_concepts(spark, sf), _texts(spark, sf), tp.variants(spark), 1)
    return tp.only(prompts, wanted).select("datapred", "llm_model", "decoding", "variant", "concept", "sample_id", "prompt")


@query("llm2_completed_prompts", f"""
SELECT datapred, llm_model, variant, concept, '{{"score": 0.' || (length(prompt) % 10) || '}}' AS text FROM ({_render_sql(SCORE_RANGES[:1], 1)})""")
def llm2(spark, sf):
    prompts = tp.render_scores(_prompt_concepts(spark, sf), _texts(spark, sf), tp.variants(spark), 1)
    reply = lambda batch: ['{"score": 0.' + str(len(p) % 10) + "}" for p in batch]
    return tp.complete(prompts, reply).select("datapred", "llm_model", "variant", "concept", "text")


_PARSED = f"""
WITH fx AS ({COMPLETIONS}), p AS (SELECT concept, sample_id, text, CASE WHEN sample_id % 4 <> 3
  THEN CAST(json_extract_string(regexp_extract(text, '(?s)\\{{.*\\}}', 0), '$.score') AS DOUBLE) END AS score,
  CASE WHEN sample_id % 4 <> 3 THEN json_extract_string(regexp_extract(text, '(?s)\\{{.*\\}}', 0), '$.reasoning') END AS reasoning FROM fx)
"""


@query("llm3_parsed_scores", _PARSED + "SELECT concept, sample_id, score, reasoning FROM p")
def llm3(spark, sf):
    return tp.parse_scores(fx_completions(spark, sf)).select("concept", "sample_id", "score", "reasoning")


@query("llm4_average_scores", _PARSED + f"""
SELECT concept, {d9('avg(score)')} AS score, string_agg(CASE WHEN score IS NULL THEN
  coalesce(nullif(regexp_extract(text, '(?s)\\{{.*\\}}', 0), ''), text) ELSE reasoning END, '|' ORDER BY sample_id) AS explanations FROM p GROUP BY concept""")
def llm4(spark, sf):
    avg = tp.average_scores(tp.parse_scores(fx_completions(spark, sf)), ["concept"])
    joined = F.when(F.size("explanations") > 0, F.array_join("explanations", "|"))
    return rounded9(avg.withColumn("explanations", joined), "score")


@query("llm5_rendered_rank_prompts", f"""
WITH c AS (SELECT DISTINCT p_type AS datapred, p_name AS concept FROM part),
l AS (SELECT datapred, count(*) AS n, string_agg(i || '. ' || concept, chr(10) ORDER BY i) AS items FROM (
  SELECT *, row_number() OVER (PARTITION BY datapred ORDER BY concept) AS i FROM c) GROUP BY datapred)
SELECT datapred, CASE WHEN datapred <> 'PROMO' THEN 'Rank ' || datapred || ': ' || {_esc(tp.LIST_FORMAT)} || chr(10) || 'Rank all ' || n || ' features in the following list:' || chr(10) || items || '.' || chr(10) END AS prompt FROM l""")
def llm5(spark, sf):
    from pyspark.sql import Window

    names = table(spark, sf, "part").select(F.col("p_type").alias("datapred"), F.col("p_name").alias("concept")).distinct()
    listed = names.withColumn("pos", F.row_number().over(Window.partitionBy("datapred").orderBy("concept")))
    templates = names.select("datapred").distinct().filter("datapred != 'PROMO'").withColumn(
        "template", F.concat(F.lit("Rank "), "datapred", F.lit(": {format_instructions}")))
    return tp.render_rank(listed, templates, "gpt-4-0613")


@query("llm6_aggregated_rankings", f"""
WITH {_SIM}, items AS (SELECT p_brand, p_size % 5 AS sample_id, p_partkey AS pos, concept FROM part JOIN best ON a = substr(p_name, 1, 3) || substr(p_name, 5) || 's'),
s AS (SELECT p_brand, sample_id, concept, row_number() OVER (PARTITION BY p_brand, sample_id ORDER BY min(pos)) - 1 AS pos FROM items GROUP BY p_brand, sample_id, concept),
n AS (SELECT count(*) AS n FROM cons), k AS (SELECT p_brand, sample_id FROM s GROUP BY ALL),
m AS (SELECT k.p_brand, cons.b AS concept, avg(coalesce(s.pos + 1, n.n + 1)) AS mean_rank FROM k CROSS JOIN cons CROSS JOIN n
  LEFT JOIN s ON s.p_brand = k.p_brand AND s.sample_id = k.sample_id AND s.concept = cons.b GROUP BY ALL)
SELECT p_brand, concept, {d9('mean_rank')} AS mean_rank, (row_number() OVER (PARTITION BY p_brand ORDER BY mean_rank, concept) - 1)::INT AS pos FROM m""")
def llm6(spark, sf):
    part = table(spark, sf, "part")
    line = F.struct("p_partkey", _typo("p_name").alias("t"))
    lists = part.groupBy("p_brand", (F.col("p_size") % 5).alias("sample_id")).agg(
        F.transform(F.sort_array(F.collect_list(line)), lambda s: s["t"]).alias("items")  # one reply's list
    )
    from sieveline.functions.text import numbered_list

    replies = lists.select("p_brand", "sample_id", numbered_list("items").alias("text"))
    return rounded9(tp.aggregate_ranks(replies, ["p_brand"], _concept_list(spark, sf)), "mean_rank")


@query("llm7_rendered_next_prompts", """
WITH c AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS i FROM (SELECT DISTINCT p_brand, p_name FROM part)),
l AS (SELECT p_brand, string_agg(p_name, ''', ''' ORDER BY p_name) FILTER (i <= 2) AS a, string_agg(p_name, ''', ''' ORDER BY p_name) FILTER (i > 2) AS b FROM c GROUP BY p_brand)
SELECT p_brand, chr(10) || 'I used the features [''' || a || '''], ' || chr(10) || 'and the trained model achieved a test AUROC of 0.75. ' || chr(10) ||
 'What feature should I add next from: [''' || b || ''']? ' || chr(10) || 'Give me just the name of the feature to add (no other text).' || chr(10) || ' [/INST]' AS prompt FROM l""")
def llm7(spark, sf):
    names = F.sort_array(F.collect_set("p_name"))  # a concept list per brand
    state = table(spark, sf, "part").groupBy("p_brand").agg(names.alias("n")).select(
        "p_brand", F.slice("n", 1, 2).alias("chosen"), F.slice("n", F.lit(3), F.greatest(F.size("n") - 2, F.lit(0))).alias("candidates"),
        F.lit("AUROC").alias("metric"), F.lit("0.75").alias("value"))
    return tp.render_next(state, "llama-2-7b-chat").select("p_brand", "prompt")


@query("llm8_resolved_replies", f"""
WITH {_SIM}, taken AS (SELECT DISTINCT p_name AS concept FROM part WHERE p_name LIKE 'red%')
SELECT p_partkey, concept, CASE WHEN concept IN (SELECT concept FROM taken) THEN 'I already selected "' || concept || '". Only choose from the list of candidate features.' END AS retry
FROM part JOIN best ON a = substr(p_name, 1, 3) || substr(p_name, 5) || 's'""")
def llm8(spark, sf):
    part = table(spark, sf, "part")
    chosen = part.filter(F.col("p_name").startswith("red")).select(F.col("p_name").alias("concept"))
    replies = part.select("p_partkey", _typo("p_name").alias("text"))
    return tp.resolve_next(replies, _concept_list(spark, sf), chosen).select("p_partkey", "concept", "retry")
