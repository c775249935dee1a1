"""Batch text pipeline: render prompts → completions → parse → aggregate.

Completion calls are the only Python step; rendering, parsing and aggregation are
column expressions, so they run inside Spark's generated code over any number of
prompts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions import text as tx
from sieveline.functions.scalars import variant_name
from sieveline.operators.ranks import borda, fuzzy_match
from sieveline.operators.select import dedupe_in_order
from sieveline.plans.datasets import SCORE_RANGES
from sieveline.runtime import broadcast_if_small

# --- fixed values: instruction texts and chat tags ------------------------------------

SCORE_INSTRUCTION = 'Provide a score and reasoning for "{concept}" formatted according to the output schema above:'
RANK_INSTRUCTION = "Rank all {n_concepts} features in the following list:\n{concepts}."
NEXT_INSTRUCTION = (
    "\nI used the features {concept_order}, \n"
    "and the trained model achieved a test {metric} of {value}. \n"
    "What feature should I add next from: {candidate_concepts}? \n"
    "Give me just the name of the feature to add (no other text).\n"
)
RETRY_MESSAGE = 'I already selected "{concept}". Only choose from the list of candidate features.'
TAG_OPEN, TAG_SYSTEM_END, TAG_CLOSE = "<s>[INST] <<SYS>>\n", "<</SYS>>\n\n", " [/INST]\n"
TAGGED_MODELS = "llama-2"

SCORE_FORMAT = (
    'The output should be a JSON object with the keys "reasoning" (string, logical reasoning behind feature '
    'importance score) and "score" (number, feature importance score).'
)
LIST_FORMAT = (
    "Your response should be a numbered list with each item on a new line. For example: \n\n1. foo\n\n2. bar\n\n3. baz"
)


def variants(spark, ranges=SCORE_RANGES[:1]) -> DataFrame:
    """Prompt variants: decoding x context x (none, examples, expls) x score range."""
    rows = [
        (d, c, e in ("examples", "expls"), e == "expls", lo, hi)
        for d in ("greedy", "consistent") for c in (False, True) for e in ("none", "examples", "expls")
        for lo, hi in ranges
    ]
    df = spark.createDataFrame(
        rows, "decoding string, context boolean, examples boolean, expls boolean, min_score int, max_score int"
    )
    return df.withColumn("variant", variant_name("decoding", "context", "examples", "expls", "min_score", "max_score"))


def with_instruction(template: Column, instruction: str, llm_model: Column) -> Column:
    """Template plus instruction; chat models of the tagged family get their tags."""
    plain = F.concat(template, F.lit("\n" + instruction + "\n"))
    tagged = F.concat(F.lit(TAG_OPEN), template, F.lit(TAG_SYSTEM_END + instruction + TAG_CLOSE))
    return F.when(llm_model.startswith(TAGGED_MODELS), tagged).otherwise(plain)


def render_scores(concepts: DataFrame, texts: DataFrame, variant_table: DataFrame, n_samples: int = 1) -> DataFrame:
    """One prompt per (datapred, model, variant, concept, sample).

    ``concepts`` has (datapred, llm_model, concept); ``texts`` has (datapred,
    template, context, examples).  The variants are unfolded from a literal list,
    so no join without a key is formed.
    """
    listed = [r.asDict() for r in variant_table.collect()]  # a fixed table of a few dozen rows
    unfolded = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in listed]))
    rows = concepts.join(broadcast_if_small(texts), "datapred").withColumn("_v", unfolded)
    rows = rows.withColumn("sample_id", F.explode(F.sequence(F.lit(1), F.lit(n_samples))))
    shown = F.when(F.col("_v.expls"), F.col("examples")).when(
        F.col("_v.examples"), tx.drop_lines("examples", "reasoning")
    ).otherwise(F.lit(""))
    base = with_instruction(F.col("template"), SCORE_INSTRUCTION, F.col("llm_model"))
    prompt = tx.fill(base, {
        "context": F.when(F.col("_v.context"), F.col("context")).otherwise(F.lit("")),
        "min_score": F.col("_v.min_score"), "max_score": F.col("_v.max_score"),
        "format_instructions": SCORE_FORMAT, "examples": shown, "concept": F.col("concept"),
    })
    return rows.select(
        "datapred", "llm_model", F.col("_v.decoding").alias("decoding"), F.col("_v.variant").alias("variant"),
        "concept", "sample_id", prompt.alias("prompt"),
    )


def only(prompts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Prompts of the given concepts only."""
    return prompts.join(wanted.select("concept").distinct(), "concept", "left_semi")


def complete(prompts: DataFrame, fn: Callable[[pd.Series], pd.Series], batch_size: int = 64) -> DataFrame:
    """Add ``text`` by a user function over batches of prompts (mapInPandas)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), batch_size):
                part = b.iloc[lo : lo + batch_size]
                yield part.assign(text=list(fn(part["prompt"])))

    schema = T.StructType([*prompts.schema.fields, T.StructField("text", T.StringType())])
    return prompts.mapInPandas(run, schema)


def complete_from_table(prompts: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """Completions from a saved table instead of a model."""
    return prompts.join(saved.select(*keys, "text"), keys, "left")


def parse_scores(completions: DataFrame) -> DataFrame:
    """Add (score, reasoning): the whole text as JSON, else its outermost braces.

    A NULL score marks a reject; the text stays with the row.
    """
    first, second = tx.parse_reply("text"), tx.parse_reply(tx.braces("text"))
    parsed = completions.withColumn("_a", first).withColumn("_b", second)
    from_whole = F.col("_a.score").isNotNull()
    return parsed.withColumn("score", F.coalesce("_a.score", "_b.score")).withColumn(
        "reasoning", F.when(from_whole, F.col("_a.reasoning")).otherwise(F.col("_b.reasoning"))
    ).drop("_a", "_b")


def average_scores(parsed: DataFrame, by: list[str]) -> DataFrame:
    """(by, score, explanations): mean over usable samples, all explanations in sample order.

    A sample without a score explains itself by what could not be parsed: the part in
    braces, or the whole reply.  The samples of one concept and variant are few by design
    (a handful per cell).
    """
    braced = tx.braces("text")
    unparsed = F.when(F.length(braced) > 0, braced).otherwise(F.col("text"))
    reason = F.when(F.col("score").isNull(), unparsed).otherwise(F.col("reasoning"))
    parsed = parsed.withColumn("reasoning", reason)
    note = F.struct("sample_id", F.col("reasoning"))
    return parsed.groupBy(*by).agg(
        F.avg("score").alias("score"),
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("reasoning").isNotNull(), note))), lambda s: s["reasoning"]
        ).alias("explanations"),
    )


def render_rank(concepts: DataFrame, templates: DataFrame, llm_model: str) -> DataFrame:
    """One ranking prompt per datapred with the numbered list of its concepts.

    A datapred without a rank template keeps a NULL prompt, so it shows up.
    """
    lists = concepts.groupBy("datapred").agg(
        F.sort_array(F.collect_list(F.struct("pos", "concept"))).alias("_l")  # a dataset's column list
    )
    rows = lists.join(templates, "datapred", "left")
    base = with_instruction(F.col("template"), RANK_INSTRUCTION, F.lit(llm_model))
    prompt = tx.fill(base, {
        "n_concepts": F.size("_l"), "concepts": tx.numbered_list(F.col("_l.concept")), "format_instructions": LIST_FORMAT,
    })
    return rows.select("datapred", F.when(F.col("template").isNotNull(), prompt).alias("prompt"))


def parse_rank_lists(completions: DataFrame, by: list[str], concepts: DataFrame) -> DataFrame:
    """(by, sample_id, pos, concept): numbered items matched to concept names, repeats dropped."""
    items = completions.select(*by, "sample_id", F.posexplode(tx.numbered_items("text")).alias("pos", "text"))
    return dedupe_in_order(fuzzy_match(items, "text", concepts), [*by, "sample_id"])


def aggregate_ranks(completions: DataFrame, by: list[str], concepts: DataFrame) -> DataFrame:
    """Borda order of the concepts over the samples of each group."""
    return borda(parse_rank_lists(completions, by, concepts), by, "sample_id", concepts)


def render_next(state: DataFrame, llm_model: str) -> DataFrame:
    """Sequential prompt from (chosen array, metric name, value, candidates array)."""
    shown = lambda c: F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))
    text = tx.fill(F.lit(NEXT_INSTRUCTION + (" [/INST]" if llm_model.startswith(TAGGED_MODELS) else "")), {
        "concept_order": shown("chosen"), "metric": F.col("metric"), "value": F.col("value"),
        "candidate_concepts": shown("candidates"),
    })
    return state.withColumn("prompt", text)


def resolve_next(replies: DataFrame, candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """Reply → candidate; ``retry`` holds the message to send when it was already chosen."""
    matched = fuzzy_match(replies, "text", candidates)
    taken = chosen.select("concept").distinct().withColumn("_taken", F.lit(True))
    retry = F.when(F.col("_taken"), F.replace(F.lit(RETRY_MESSAGE), F.lit("{concept}"), F.col("concept")))
    return matched.join(taken, "concept", "left").withColumn("retry", retry).drop("_taken")


def sequential_selection(
    concepts: list[str], ask: Callable[[str], str], score: Callable[[list[str]], float], metric: str,
    llm_model: str = "", start: list[str] | None = None, scores: dict[str, float] | None = None,
    buffer: int | None = None, max_retries: int = 3,
) -> list[tuple[str, float]]:
    """Ask for the next concept, train and score, feed the metric back, until all are chosen.

    ``ask`` completes one prompt, ``score`` runs one fit-and-evaluate Spark job for
    a list of concepts.  ``start`` resumes a saved order; ``buffer`` offers only
    the best-scored candidates.  State is column-sized.
    """
    from sieveline.operators.ranks import lcs_ratio

    order = list(start or [])
    out = [(c, score(order[: i + 1])) for i, c in enumerate(order)]
    value = out[-1][1] if out else float("nan")
    while len(order) < len(concepts):
        candidates = [c for c in concepts if c not in order]
        if buffer and scores:
            candidates = sorted(candidates, key=lambda c: -scores.get(c, float("-inf")))[:buffer]
        prompt = NEXT_INSTRUCTION.format(
            concept_order=str(order), metric=metric, value=value, candidate_concepts=str(candidates)
        )
        reply = ask(prompt)
        pick = max(candidates, key=lambda c: lcs_ratio(c, reply))
        for _ in range(max_retries):
            if pick not in order:
                break
            reply = ask(RETRY_MESSAGE.format(concept=pick))
            pick = max(candidates, key=lambda c: lcs_ratio(c, reply))
        order.append(pick)
        value = score(order)
        out.append((pick, value))
    return out


__all__ = [
    "aggregate_ranks", "average_scores", "complete", "complete_from_table", "only",
    "parse_rank_lists", "parse_scores", "render_next", "render_rank", "render_scores", "resolve_next",
    "sequential_selection", "variants", "with_instruction",
]
