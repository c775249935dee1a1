"""Exact ordering at scale: cumulative counts, ranks, order statistics, quantiles.

A plain ``Window.partitionBy(series).orderBy(value)`` sorts one whole series in
one task.  Series here are features or models, so a single one can hold a third
of all rows.  The functions below never do that:

1. rows are first reduced to one row per (series, distinct value), map-side;
2. each series is range-split into buckets at approximate quantiles of its distinct
   values, so a bucket holds about ``1/buckets`` of them however skewed the series are;
3. windows run per (series, bucket) and are shifted by the bucket totals, a table
   of ``series x buckets`` rows.

Sketches, bucket totals and brackets are tables of the same plan: nothing is run or
collected while a plan is built, and no number of series is too many.  A caller that
knows how many series there can be says so with ``series``; only then are these tables
broadcast, when their size is bounded by it.  The bucket edges only decide where the
work runs; the results are exact.

A sketch that is made twice need not come out the same, since it depends on the order in
which parts arrive.  Order statistics therefore use theirs in one branch.  Running totals
use theirs in two, which must share an exchange; with ``settle`` the reduced rows and the
edges are written out first, once, so that nothing is made again whatever Spark shares.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions.scalars import HASH_BITS, nan_to_null
from sieveline.runtime import cut_lineage, shuffle_width, small_rows, TooManyRows

_STEP = 64  # edges compared per level when a value is placed in its bucket
_BROADCAST_BYTES = 64 << 20


def bucket_count(df: DataFrame) -> int:
    """Buckets per series: twice the shuffle width, so windows use the whole cluster."""
    return max(8, 2 * shuffle_width(df.sparkSession))


def _bounded(table: DataFrame, by: list[str], series: int | None, row_bytes: int) -> DataFrame:
    """``table`` (a row or few for each series) with a broadcast hint if its size is known to be small."""
    most = 1 if not by else series
    return F.broadcast(table) if most is not None and most * row_bytes <= _BROADCAST_BYTES else table


def _bucket_of(value: str, n_edges: int) -> Column:
    """Number of edges below the value: first among every 64th edge, then among 64."""
    below = lambda e: e < F.col(value)
    if n_edges <= _STEP:
        return F.size(F.filter("_edges", below))
    coarse = F.size(F.filter("_coarse", below))
    fine = F.size(F.filter(F.slice("_edges", coarse * _STEP + 1, _STEP), below))
    return coarse * _STEP + fine


def cumulative(
    df: DataFrame,
    by: list[str],
    value: str,
    sums: dict[str, Column],
    buckets: int | None = None,
    series: int | None = None,
    settle: bool = False,
) -> DataFrame:
    """One row per (``by``, distinct ``value``) with exact running totals.

    For each ``name → expression`` in ``sums`` the result has ``name`` (the sum
    over rows with that value), ``before_name`` (sum over strictly smaller
    values) and ``total_name`` (sum over the series).  Missing values are skipped.
    The rows are read once and reduced; sketch, buckets and totals are made of the
    reduced rows.  ``settle`` writes these out, now: for operators that run jobs anyway.
    """
    keys = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    base = base.withColumn(value, nan_to_null(F.col(value))).filter(F.col(value).isNotNull())
    b = buckets or bucket_count(df)
    probs = [i / b for i in range(1, b)]

    per_value = base.groupBy(*keys, value).agg(*[F.sum(e).alias(k) for k, e in sums.items()])
    # naming the sums keeps this branch equal to the others, so that they share one exchange
    whole = reduce(lambda x, y: x | y, [F.col(k).isNotNull() for k in sums], F.lit(True))
    if settle:
        per_value = cut_lineage(per_value)
    edges = per_value.groupBy(*keys).agg(F.percentile_approx(F.when(whole, F.col(value)), probs, 10 * b).alias("_edges"))
    if settle:
        edges = cut_lineage(edges)
    if len(probs) > _STEP:
        every = F.transform(
            F.sequence(F.lit(_STEP), F.lit(len(probs)), F.lit(_STEP)), lambda i: F.element_at("_edges", i)
        )
        edges = edges.withColumn("_coarse", every)
    tagged = per_value.join(_bounded(edges, by, series, 9 * b), keys)
    tagged = tagged.withColumn("_b", _bucket_of(value, len(probs))).drop("_edges", "_coarse")

    over_buckets = Window.partitionBy(*keys).orderBy("_b")
    prior = over_buckets.rowsBetween(Window.unboundedPreceding, -1)
    entire = Window.partitionBy(*keys)
    offsets = (
        tagged.groupBy(*keys, "_b")
        .agg(*[F.sum(k).alias(f"_s_{k}") for k in sums])
        .select(
            *keys,
            "_b",
            *[F.coalesce(F.sum(f"_s_{k}").over(prior), F.lit(0)).alias(f"_off_{k}") for k in sums],
            *[F.sum(f"_s_{k}").over(entire).alias(f"total_{k}") for k in sums],
        )
    )
    within = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.select(
        "*", *[F.coalesce(F.sum(k).over(within), F.lit(0)).alias(f"_in_{k}") for k in sums]
    )
    out = local.join(_bounded(offsets, by, series, b * (32 + 16 * len(sums))), [*keys, "_b"])
    return out.select(
        *by,
        value,
        *list(sums),
        *[(F.col(f"_in_{k}") + F.col(f"_off_{k}")).alias(f"before_{k}") for k in sums],
        *[f"total_{k}" for k in sums],
    )


def mid_ranks(df: DataFrame, by: list[str], value: str, series: int | None = None, settle: bool = False) -> DataFrame:
    """(``by``, ``value``, ``n``, ``mid_rank``): average rank of each distinct value."""
    cum = cumulative(df, by, value, {"n": F.lit(1)}, series=series, settle=settle)
    return cum.select(
        *by, value, "n", (F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)).alias("mid_rank"), "total_n"
    )


# ---------------------------------------------------------------------------
# exact values at given positions: quantiles and equal-depth edges
# ---------------------------------------------------------------------------

_ACCURACY = 10_000  # the sketch's rank error is at most n / _ACCURACY
_MARGIN = 3.0 / _ACCURACY


def _merged(spans: Column) -> Column:
    """Sorted (lo, hi) spans with those that meet joined."""
    kind = "array<struct<lo:double,hi:double>>"

    def add(found, span):
        last = F.try_element_at(found, F.lit(-1))
        longer = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], span["hi"]).alias("hi"))
        meets = (F.size(found) > 0) & (span["lo"] <= last["hi"])
        joined = F.concat(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.array(longer))
        return F.when(meets, joined).otherwise(F.concat(found, F.array(span))).cast(kind)

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def values_at(
    df: DataFrame, by: list[str], value: str, probs: list[float], positions: Callable[[Column], Column],
    series: int | None = None,
) -> DataFrame:
    """Exact order statistics: ``by``, ``n`` (values in the series) and ``at``, the values at 0-based positions.

    ``positions(n)`` is the array of wanted positions of a series of ``n`` values, each
    within one rank of a share in ``probs``.  A quantile sketch brackets every wanted value.
    One more pass keeps the rows inside brackets, a few thousandths of all, and counts the
    others by the bracket that follows them; a window over both gives the ranks.
    Brackets and counts are tables on the executors, joined by series.
    """
    keys = list(by) or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    base = base.select(*keys, nan_to_null(F.col(value)).alias("_v")).filter(F.col("_v").isNotNull())
    grid = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-_MARGIN, _MARGIN)})
    place = {p: i for i, p in enumerate(grid)}
    sketch = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
        F.percentile_approx("_v", grid, _ACCURACY).alias("_e"),
    )
    end = lambda p: F.col("_e")[place[min(max(p, 0.0), 1.0)]]
    spans = F.array(*[F.struct(end(p - _MARGIN).alias("lo"), end(p + _MARGIN).alias("hi")) for p in probs])
    # the margin is a few ranks at least; in a shorter series every value is a candidate
    entire = F.array(F.struct(F.col("_least").alias("lo"), F.col("_most").alias("hi")))
    brackets = sketch.select(*keys, "n", _merged(F.when(F.col("n") * _MARGIN >= 4, spans).otherwise(entire)).alias("_m"))
    room = 64 + 16 * len(probs)

    tagged = base.join(_bounded(brackets.drop("n"), by, series, room), keys)
    tagged = tagged.withColumn("_s", F.size(F.filter("_m", lambda m: m["hi"] < F.col("_v"))))
    tagged = tagged.withColumn("_in", F.coalesce(F.try_element_at("_m", F.col("_s") + 1)["lo"] <= F.col("_v"), F.lit(False)))
    # values inside brackets, and one row for the others before each bracket; both small
    cells = tagged.groupBy(*keys, "_s", "_in", F.when(F.col("_in"), F.col("_v")).alias("_x")).agg(F.count(F.lit(1)).alias("c"))
    # one window over these few rows, so that brackets are made and used once
    in_order = Window.partitionBy(*keys).orderBy("_s", "_in", "_x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.select(
        *keys, F.sum("c").over(Window.partitionBy(*keys)).alias("n"), "_in", "_x",
        F.coalesce(F.sum("c").over(in_order), F.lit(0)).alias("_low"), F.col("c").alias("_c"),
    ).filter("_in")
    ranked = ranked.withColumn("_p", positions(F.col("n")))
    covered = lambda p: (p >= F.col("_low")) & (p < F.col("_low") + F.col("_c"))
    hits = ranked.withColumn("_h", F.filter(F.array_distinct("_p"), covered)).filter(F.size("_h") > 0)
    hits = hits.select(*keys, "n", "_p", F.explode("_h").alias("_h"), "_x")
    found = hits.groupBy(*keys, "n", "_p").agg(F.map_from_entries(F.collect_list(F.struct("_h", "_x"))).alias("_f"))
    missed = F.raise_error(F.lit("a wanted value lies outside its bracket")).cast("array<double>")
    at = F.transform("_p", lambda p: F.col("_f")[p])
    at = F.when(F.size(F.col("_f")) == F.size(F.array_distinct("_p")), at).otherwise(missed)
    return found.select(*by, "n", at.alias("at"))


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], series: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: ``by`` plus ``q0 .. qk``."""
    def ends(n):
        spot = [F.lit(float(p)) * (n - 1) for p in probs]
        return F.array(*[f(x).cast("long") for x in spot for f in (F.floor, F.ceil)])

    found = values_at(df, by, value, probs, ends, series)
    cuts = []
    for i, p in enumerate(probs):
        low, high = F.col("at")[2 * i], F.col("at")[2 * i + 1]
        spot = F.lit(float(p)) * (F.col("n") - 1)
        cuts.append((low + (high - low) * (spot - F.floor(spot))).alias(f"q{i}"))
    return found.select(*by, *cuts)


def equal_depth_edges(df: DataFrame, by: list[str], value: str, k: int, series: int | None = None) -> DataFrame:
    """``by`` plus ``edges``: the values at 0-based positions ``floor(j*n/k)``, j=1..k-1.

    ``size(filter(edges, e <= v))`` is then the equal-depth bin of ``v``; equal
    values always share a bin.
    """
    if k < 2:
        counts = df.filter(nan_to_null(F.col(value)).isNotNull())
        counts = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0")
        return counts.select(*by, F.array().cast("array<double>").alias("edges"))
    starts = lambda n: F.array(*[F.floor(F.lit(j) * n / F.lit(k)).cast("long") for j in range(1, k)])
    return values_at(df, by, value, [j / k for j in range(1, k)], starts, series).select(*by, F.col("at").alias("edges"))


def bin_of(value, edges) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.size(F.filter(edges, lambda e: e <= v))


# ---------------------------------------------------------------------------
# exact cuts of a total order: "the first k rows of each stratum"
# ---------------------------------------------------------------------------

_INLINE_CUTS = 256  # cuts that are looked at as literals; more are a table


def _level_bits(df: DataFrame, bits: int) -> int:
    """Key bits of a histogram: some hundred buckets a shuffle partition, so a bucket's rows are few."""
    return min(bits, max(12, (128 * shuffle_width(df.sparkSession)).bit_length()))


def exact_cuts(
    df: DataFrame, by: list[str], key: Column, tie: str, ranks: Callable[[Column], Column], bits: int = HASH_BITS,
) -> dict[tuple, list[tuple]] | DataFrame:
    """Boundary rows of the order (``key``, ``tie``) within each stratum.

    ``ranks(n)`` is the ascending array of how many rows of a stratum of ``n`` go before each
    cut (it may use the columns ``by``); a cut is the (key, tie) of the first row after it,
    and is left out when every row lies before it.

    A histogram of the key's top bits, a map-side reduced aggregate, says in which bucket
    each cut lies and how many rows precede it there; only the rows of these buckets are
    numbered.  Histogram, buckets and cuts are tables by (stratum, bucket), so any number of
    strata will do.  A few cuts come back as {stratum: [(key, tie)]}, and applying them is
    a projection; many as a table (``by``, ``_bounds``).

    ``key`` is a BIGINT in [0, 2**bits); rows with a NULL key take no part.
    """
    base = df.select(*by, key.alias("_k"), F.col(tie).alias("_t")).filter(F.col("_k").isNotNull())
    shift = bits - _level_bits(df, bits)
    base = base.withColumn("_b", F.shiftright("_k", shift))
    hist = base.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    stratum = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # buckets of the histogram
    prior = stratum.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select("*", F.coalesce(F.sum("_c").over(prior), F.lit(0)).alias("_low"), F.sum("_c").over(stratum).alias("_n"))
    inside = lambda r: (r >= F.col("_low")) & (r < F.col("_low") + F.col("_c"))
    hits = hist.select(*by, "_b", F.transform(F.filter(ranks(F.col("_n")), inside), lambda r: (r - F.col("_low")).cast("long")).alias("_r"))
    hits = hits.filter(F.size("_r") > 0)
    hits = hits.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(by)], F.col("_b").alias("_of_b"), "_r")
    few = _collected(hits, _INLINE_CUTS)
    if few is not None:
        hits = F.broadcast(df.sparkSession.createDataFrame(few, hits.schema))
    cond = [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(by)]
    rows = base.join(hits, reduce(lambda x, y: x & y, cond, F.col("_b") == F.col("_of_b"))).select(*by, "_b", "_k", "_t", "_r")
    number = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_k", "_t")) - 1
    times = F.size(F.filter("_r", lambda r: r == F.col("_i")))  # equal ranks are cuts of their own
    bounds = rows.withColumn("_i", number.cast("long")).withColumn("_times", times).filter("_times > 0")
    bounds = bounds.select(*by, F.struct(F.col("_k").alias("k"), F.col("_t").alias("t"), "_times").alias("_c"))
    table = bounds.groupBy(*by).agg(F.sort_array(F.collect_list("_c")).alias("_c"))  # a stratum's cuts
    each = F.flatten(F.transform("_c", lambda c: F.array_repeat(F.struct(c["k"].alias("k"), c["t"].alias("t")), c["_times"])))
    table = table.select(*by, each.alias("_bounds"))
    if few is None:
        return table
    return {tuple(r[c] for c in by): [(x["k"], x["t"]) for x in r["_bounds"]] for r in table.collect()}  # at most _INLINE_CUTS


def _collected(df: DataFrame, limit: int) -> list | None:
    """The rows, if there are at most ``limit``."""
    try:
        return small_rows(df, limit)
    except TooManyRows:
        return None


def with_cut_index(df: DataFrame, by: list[str], cuts: dict | DataFrame, key: str, tie: str, out: str) -> DataFrame:
    """Add ``out`` = the number of cuts at or before the row (0 = before the first).

    A projection with literal bounds, or a join with the table of bounds.
    """
    if isinstance(cuts, dict):
        return df.withColumn(out, _inline_index(by, cuts, F.col(key), tie))
    after = lambda b: (F.col(key) > b["k"]) | ((F.col(key) == b["k"]) & (F.col(tie) >= b["t"]))
    named = cuts.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(by)], "_bounds")
    cond = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(by)], F.lit(True))
    joined = df.join(named, cond, "left")
    index = F.coalesce(F.size(F.filter("_bounds", after)), F.lit(0))
    return joined.withColumn(out, index).drop("_bounds", *[f"_of_{i}" for i in range(len(by))])


def _same(by: list[str], stratum: tuple) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, stratum, strict=True)], F.lit(True))


def _inline_index(by: list[str], cuts: dict, key: Column, tie: str) -> Column:
    out = F.lit(0)
    for s, bounds in cuts.items():
        passed = F.lit(0)
        for k, t in bounds:
            passed = passed + ((key > F.lit(k)) | ((key == F.lit(k)) & (F.col(tie) >= F.lit(t)))).cast("int")
        out = passed if not by else F.when(_same(by, s), passed).otherwise(out)
    return out


def row_positions(df: DataFrame, key: Column, tie: str, out: str, by: list[str] = ()) -> DataFrame:
    """0-based position of every row in the order (``key`` hash, ``tie``) of its group, exact.

    The hash's top bits split the order into buckets; windows run per bucket and
    are shifted by the bucket sizes.
    """
    by = list(by)
    bits = max(3, bucket_count(df).bit_length())
    tagged = df.withColumn("_k", key).withColumn("_b", F.shiftright(F.col("_k"), HASH_BITS - bits))
    counts = tagged.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    # a few bucket sizes for each shuffle partition and group
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_b", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    rn = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_k", tie)) - 1
    return (
        tagged.withColumn("_rn", rn)
        .join(offsets if by else F.broadcast(offsets), [*by, "_b"])
        .withColumn(out, (F.col("_rn") + F.col("_off")).cast("bigint"))
        .drop("_k", "_b", "_rn", "_off")
    )


__all__ = [
    "bin_of", "cumulative", "equal_depth_edges", "exact_cuts", "mid_ranks", "quantiles",
    "row_positions", "values_at", "with_cut_index",
]
