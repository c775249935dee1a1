"""Rank agreement, rank aggregation and fuzzy matching of concept names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.scalars import concept_of, is_one_hot
from sieveline.operators.ordering import cumulative
from sieveline.runtime import TooManyRows, broadcast_if_small, small_rows

_MATCH_CHUNK = 1000  # concepts compared per row; longer lists are split into chunks


# --- Kendall's tau-b -----------------------------------------------------------------


def kendall_tau(pairs: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """(by, tau, n): tau-b without forming pairs.

    Each value is replaced by the number of smaller values, an integer that keeps
    order and ties.  Two rows then differ first at one bit of x and one bit of y;
    counting rows per (bit of x, common x prefix, bit of y, common y prefix) by
    their two bits gives concordant and discordant pairs as products of counts.
    That is one map-side reduced aggregate of n*log(n)^2 rows, with no pair
    emitted and no group gathered.
    """
    by = list(by)
    keys = by or ["_all"]
    base = (pairs if by else pairs.withColumn("_all", F.lit(0))).select(
        *keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    ).filter(F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y"))
    rx = cumulative(base, keys, "_x", {"n": F.lit(1)}, settle=True).select(
        *keys, "_x", F.col("before_n").alias("_rx"), F.col("n").alias("_tx"), F.col("total_n").alias("_n")
    )
    ry = cumulative(base, keys, "_y", {"n": F.lit(1)}, settle=True).select(*keys, "_y", F.col("before_n").alias("_ry"))
    cells = base.groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_c"))
    coded = cells.join(rx, [*keys, "_x"]).join(ry, [*keys, "_y"])

    bits = F.ceil(F.log2(F.greatest(F.col("_n"), F.lit(2)).cast("double"))).cast("int")
    levels = F.sequence(F.lit(0), bits)
    spread = coded.select(*keys, "_rx", "_ry", "_c", F.explode(levels).alias("_i"), levels.alias("_l")).select(
        *keys, "_rx", "_ry", "_c", "_i", F.explode("_l").alias("_j")
    )
    bit_x = F.pmod(F.expr("shiftright(_rx, _i)"), F.lit(2))
    bit_y = F.pmod(F.expr("shiftright(_ry, _j)"), F.lit(2))

    def count_of(bx: int, by_: int) -> Column:
        return F.sum(F.when((bit_x == bx) & (bit_y == by_), F.col("_c")).otherwise(0)).cast("double")

    quads = spread.groupBy(
        *keys, "_i", F.expr("shiftright(_rx, _i + 1)").alias("_px"), "_j", F.expr("shiftright(_ry, _j + 1)").alias("_py")
    ).agg(count_of(0, 0).alias("a"), count_of(1, 1).alias("b"), count_of(0, 1).alias("c"), count_of(1, 0).alias("d"))
    gap = quads.groupBy(*keys).agg(F.sum(F.col("a") * F.col("b") - F.col("c") * F.col("d")).alias("_gap"))

    def untied(col: str) -> DataFrame:
        per = cells.groupBy(*keys, col).agg(F.sum("_c").cast("double").alias("_t"))
        t, n = F.col("_t"), F.sum("_t")
        pairs_all = n * (n - 1) / 2.0
        return per.groupBy(*keys).agg(
            (pairs_all - F.sum(t * (t - 1) / 2.0)).alias(f"_u{col}"), n.cast("bigint").alias(f"_n{col}")
        )

    both = gap.join(untied("_x"), keys).join(untied("_y"), keys)
    scale = F.sqrt(F.col("_u_x") * F.col("_u_y"))
    return both.select(*by, F.when(scale > 0, F.col("_gap") / scale).alias("tau"), F.col("_n_x").alias("n"))


def expand_to_features(concept_scores: DataFrame, features: DataFrame, by: list[str] = ()) -> DataFrame:
    """Attach concept-level scores to features: (by, feature, concept_score, feature_score).

    When the two tables differ in size, a one-hot feature takes the score of the
    concept before its first underscore; otherwise names must be equal.
    """
    by = list(by)
    n_features = features.count()
    sizes = broadcast_if_small(
        concept_scores.groupBy(*by).agg((F.count(F.lit(1)) != n_features).alias("_expand"))
    ) if by else None
    right = concept_scores.select(*by, F.col("concept").alias("_concept"), F.col("score").alias("concept_score"))
    feats = features.select("feature", F.col("score").alias("feature_score"))
    if by:
        right = right.join(sizes, by)
    else:
        right = right.withColumn("_expand", F.lit(concept_scores.count() != n_features))
    # a feature matches by its full name, or by its prefix where names are expanded
    keyed = feats.select(
        "feature", "feature_score",
        F.explode(F.array_distinct(F.array(
            F.struct(F.lit(True).alias("_expand"), F.when(is_one_hot("feature"), concept_of("feature")).otherwise(F.col("feature")).alias("_concept")),
            F.struct(F.lit(False).alias("_expand"), F.col("feature").alias("_concept")),
        ))).alias("_k"),
    ).select("feature", "feature_score", "_k.*")
    return right.join(keyed, ["_expand", "_concept"]).select(*by, "feature", "concept_score", "feature_score")


def to_concept(features: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sum feature scores to their concept (the part before the first underscore)."""
    return features.groupBy(*by, concept_of("feature").alias("concept")).agg(F.sum("score").alias("score"))


# --- rank lists -----------------------------------------------------------------------


def borda(samples: DataFrame, by: list[str], sample: str, concepts: DataFrame) -> DataFrame:
    """(by, concept, mean_rank, pos) from ranked lists (by, sample, pos, concept).

    ``pos`` counts from 0 in each list; a concept missing from a list ranks one
    after the last concept.  Ordered by mean rank, then by name.
    """
    names = broadcast_if_small(concepts.select("concept").distinct())
    n = concepts.select("concept").distinct().count()
    lists = samples.groupBy(*by).agg(F.countDistinct(sample).alias("_k"))
    seen = samples.join(names, "concept", "left_semi").groupBy(*by, "concept").agg(
        F.sum(F.col("pos") + 1).alias("_sum"), F.count(F.lit(1)).alias("_seen")
    )
    every = [r["concept"] for r in small_rows(concepts.select("concept").distinct())]
    grid = lists.withColumn("concept", F.explode(F.array(*[F.lit(c) for c in every])))
    filled = grid.join(seen, [*by, "concept"], "left")
    total = F.coalesce("_sum", F.lit(0)) + (F.col("_k") - F.coalesce("_seen", F.lit(0))) * (n + 1)
    mean = filled.select(*by, "concept", (total / F.col("_k").cast("double")).alias("mean_rank"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return mean.withColumn("pos", (F.row_number().over(w.orderBy("mean_rank", "concept")) - 1).cast("int"))


def rank_scores(ranked: DataFrame, by: list[str] = (), pos: str = "pos") -> DataFrame:
    """A ranked list as scores: ``n - pos`` for 0-based positions."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return ranked.withColumn("score", (F.count(F.lit(1)).over(w) - F.col(pos)).cast("double"))


# --- fuzzy matching ---------------------------------------------------------------------


def lcs_ratio(a: str, b: str) -> int:
    """Similarity 0..100: round(100 * 2 * LCS / (len a + len b)).

    The longest common subsequence is counted with one machine word per row of
    bits (Hyyro's bit-parallel recurrence on Python integers).
    """
    if not a and not b:
        return 100
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    lcs = len(a) - bin(state).count("1")
    return int(round(200.0 * lcs / (len(a) + len(b))))


def lcs_length(a: Column, b: Column) -> Column:
    """LCS length of two short strings as a pure column expression (two-row dynamic program)."""
    chars_b = F.when(F.length(b) > 0, F.split(b, "")).otherwise(F.array().cast("array<string>"))
    chars_a = F.when(F.length(a) > 0, F.split(a, "")).otherwise(F.array().cast("array<string>"))
    start = F.transform(F.concat(F.array(F.lit("")), chars_b), lambda _: F.lit(0))

    def row(prev, ca):
        steps = F.sequence(F.lit(1), F.size(chars_b))
        grown = F.aggregate(
            F.when(F.size(chars_b) > 0, steps).otherwise(F.array().cast("array<int>")),
            F.array(F.lit(0)),
            lambda acc, j: F.concat(acc, F.array(
                F.when(F.element_at(chars_b, j) == ca, F.element_at(prev, j) + 1)
                .otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(acc, -1)))
            )),
        )
        return grown

    last = F.aggregate(chars_a, start, row)
    return F.element_at(last, -1)


def similarity(a: Column, b: Column) -> Column:
    """``lcs_ratio`` as a column expression."""
    total = F.length(a) + F.length(b)
    ratio = F.rint(F.lit(200.0) * lcs_length(a, b) / total).cast("int")
    return F.when(total == 0, F.lit(100)).otherwise(ratio)


def _best_of(concepts: list[str]):
    @F.pandas_udf("idx int, score int")
    def best(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            top, at = -1, -1
            for i, c in enumerate(concepts):
                s = lcs_ratio(t, c)
                if s > top:
                    top, at = s, i
            rows.append((at, top))
        return pd.DataFrame(rows, columns=["idx", "score"])

    return best


def fuzzy_match(df: DataFrame, text: str, concepts: DataFrame) -> DataFrame:
    """Add ``concept`` and ``similarity``: the most similar concept of each text.

    ``concepts`` has (concept, pos); ties go to the first in list order.  Distinct
    texts are matched once against the concept list, which is a dataset's column
    list.  Only the best match leaves a task; a very long list is walked in
    chunks whose winners are compared afterwards.
    """
    names = [r["concept"] for r in small_rows(concepts.select("concept", "pos").orderBy("pos"))]
    if not names:
        raise TooManyRows("no concepts to match against")
    distinct = df.select(F.coalesce(F.col(text), F.lit("")).alias("_t")).distinct()
    # an edit costs a text pair shorter than 200 characters more than half a point,
    # so such an exact name scores 100 alone and needs no comparison
    first_at = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("_t"))
    plain = (first_at > 0) & (F.length("_t") + max(len(c) for c in names) < 200)
    exact = distinct.filter(plain).select("_t", F.col("_t").alias("concept"), F.lit(100).alias("similarity"))
    winners = distinct.filter(~plain)
    for n, lo in enumerate(range(0, len(names), _MATCH_CHUNK)):
        winners = winners.withColumn(f"_m{n}", _best_of(names[lo : lo + _MATCH_CHUNK])("_t"))
    chunks = range(0, len(names), _MATCH_CHUNK)
    best = F.array(*[
        F.struct(F.col(f"_m{n}.score").alias("s"), (-(F.col(f"_m{n}.idx") + lo)).alias("i"))
        for n, lo in enumerate(chunks)
    ])
    top = F.array_max(best)
    lookup = F.array(*[F.lit(c) for c in names])
    winners = winners.select("_t", F.element_at(lookup, 1 - top["i"]).alias("concept"), top["s"].alias("similarity"))
    winners = winners.unionByName(exact)
    return df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).join(winners, "_t").drop("_t")
