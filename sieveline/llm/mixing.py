"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's texts are shuffled (by a seeded hash) into one stream of words, cut into blocks
of equally many words. The schedule maps golden-ratio points through the cumulative target
shares: slot i belongs to the source on which point i falls, and the slot's rank among its
source's slots says which block it takes; past the last block the stream starts again. So any
stretch of the schedule holds the sources near their shares. Slots beyond a source's target
are left out, missing ones follow at the end, and the last one is cut to the exact target.

Targets: sources ordered by code point, null last, have the weights in turn and share the
total size; a target stops at ``cap`` times its source's size and the excess is shared again
by weight. Sizes are words; null and empty texts have none and nothing is taken from them.
Rows that repeat an id are documents of their own. Everything depends on the rows alone, so
reruns agree. One row for each source is held by the driver. An empty table gives an empty
result.

Prefix sums of a source's stream run over (source, hash range) groups, and ranks of slots
over ranges of slots: no source is sorted in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.arrays import batch_of, slices, words
from sieveline.llm.frames import kept, named, row_key

#: Golden-ratio step on a circle of 2**31 points (the nearest odd number to 2**31 / phi).
_CIRCLE, _STEP = 1 << 31, 1327217885
#: Hash ranges of a source's stream: at least so many, and one for so many rows.
_RANGES, _RANGE_ROWS = 1 << 10, 100_000
_SLOT_RANGE = 1 << 16


def _sizes(batches):
    schema = pa.schema([("key", pa.int64()), ("other", pa.int64()), ("id", pa.int64()), ("source", pa.string()), ("size", pa.int64())])
    for rows, data, offsets in slices(batches, "text"):
        _, _, before = words(data, offsets)
        yield batch_of(schema, [rows.column("key"), rows.column("other"), rows.column("id"), rows.column("source"), np.diff(before)])


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> dict[str | None, float]:
    """Each source's target size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = float(sum(sizes.values()))
    out, rest = {}, list(order)
    while rest:
        level = (total - sum(out.values())) / sum(weight[s] for s in rest)
        full = [s for s in rest if weight[s] * level > cap * sizes[s]]
        for s in full or rest:
            out[s] = float(cap * sizes[s]) if full else weight[s] * level
        rest = [s for s in rest if s not in out]
    return out


def _slots(edges):
    """(slot range, source, slot, rank within both)."""

    def task(batches):
        schema = pa.schema([("range", pa.int64()), ("no", pa.int32()), ("slot", pa.int64()), ("local", pa.int64())])
        for batch in batches:
            slot = batch.column("id").to_numpy()
            point = (slot % _CIRCLE * _STEP + _STEP // 2) % _CIRCLE / _CIRCLE
            no = np.minimum(np.searchsorted(edges, point, "right"), len(edges) - 1)
            yield batch_of(schema, [slot // _SLOT_RANGE, no.astype(np.int32), slot, np.zeros(len(slot), np.int64)])

    return task


def schedule(df_session, plan: list[dict], block: int) -> DataFrame:
    """(no, slot, rank, block, words): slots in mixing order and the block that each takes."""
    spark = df_session
    total = sum(p["target"] for p in plan)
    n = math.ceil(total / block) if total > 0 else 0
    edges = np.cumsum([p["target"] / total if total > 0 else 0 for p in plan])
    slots = spark.range(n).mapInArrow(_slots(edges), "range long, no int, slot long, local long").drop("local")
    inside = Window.partitionBy("range", "no").orderBy("slot")
    local = slots.withColumn("local", F.row_number().over(inside) - 1)
    counts = slots.groupBy("range", "no").count()
    before = counts.select("range", "no", F.coalesce(F.sum("count").over(Window.partitionBy("no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = local.join(before, ["range", "no"]).select("no", "slot", (F.col("before") + F.col("local")).alias("rank"))
    table = spark.createDataFrame([(i, p["blocks"], p["need"], p["last"], p["size"]) for i, p in enumerate(plan)], "no int, blocks long, need long, last long, size long")
    have = counts.groupBy("no").agg(F.sum("count").alias("have"))
    short = table.join(have, "no", "left").filter(F.col("need") > F.coalesce("have", F.lit(0)))
    tail = short.select("no", F.explode(F.sequence(F.coalesce("have", F.lit(0)).cast("long"), F.col("need") - 1)).alias("rank")).select("no", (F.lit(n) + F.col("rank")).alias("slot"), "rank")
    out = ranked.unionByName(tail).join(table, "no").filter("rank < need")
    at = F.col("rank") % F.col("blocks")
    whole = F.least(F.lit(block).cast("long"), F.col("size") - at * F.lit(block))
    return out.select("no", "slot", "rank", at.alias("block"), F.when((F.col("rank") == F.col("need") - 1) & (F.col("last") > 0), F.col("last")).otherwise(whole).alias("words"), (~((F.col("rank") == F.col("need") - 1) & (F.col("last") > 0))).alias("whole"))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> list:
    """``key`` and ``other``: hashes of a row's id and text, and of all its columns. Rows that share both are copies."""
    return [row_key(id_col, text_col).alias("key"), F.xxhash64(F.lit(1), *[named(c) for c in df.columns]).alias("other")]


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, block: int = 1024, seed: int = 0) -> DataFrame:
    """(key, other, ``id_col``, size, source_size, target, start, taken) for every row of ``df``.

    ``start`` is the text's place in its source's stream, ``taken`` the words that the mix
    takes; ``key`` and ``other`` tell rows apart.
    """
    spark = df.sparkSession
    rows = df.select(*_keyed(df, id_col, text_col), named(id_col).cast("long").alias("id"), named(source_col).cast("string").alias("source"), named(text_col).cast("binary").alias("text"))
    sized = kept(rows.mapInArrow(_sizes, "key long, other long, id long, source string, size long"))
    found = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    by_source, counts = {r["source"]: r["n"] for r in found}, {r["source"]: r["rows"] for r in found}
    goal = targets(by_source, weights, cap)
    plan = []
    for source, target in goal.items():
        size, words_wanted = by_source[source], math.floor(target + 0.5)
        passes, rest = divmod(words_wanted, size) if size else (0, 0)
        blocks = -(-size // block)
        plan.append({"source": source, "size": size, "target": target, "blocks": max(1, blocks), "need": passes * blocks + -(-rest // block), "last": rest % block})
    table = spark.createDataFrame([(i, p["source"], p["size"], p["target"]) for i, p in enumerate(plan)], "no int, source string, source_size long, target double")
    ranges = max(_RANGES, -(-sum(counts.values()) // _RANGE_ROWS))
    placed = sized.withColumn("h", F.xxhash64("key", F.lit(seed))).withColumn("part", F.pmod(F.col("h"), F.lit(ranges)).cast("int"))
    parts = placed.groupBy("source", "part").agg(F.sum("size").alias("n"))
    parts = parts.join(table, parts["source"].eqNullSafe(table["source"])).select("no", "source_size", "target", parts["source"].alias("of"), F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(Window.partitionBy("no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "part").orderBy("h", "key", "size", "other").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(parts, placed["source"].eqNullSafe(parts["of"]) & (placed["part"] == parts["of_part"]))
    placed = kept(placed.select("key", "other", "id", "size", "no", "source_size", "target", (F.col("before") + F.col("inside")).alias("start")))
    # blocks that a text reaches into, and how often and how far each block is taken
    taken = schedule(spark, plan, block).groupBy("no", "block").agg(F.count_if("whole").alias("times"), F.max(F.when(~F.col("whole"), F.col("words"))).alias("part"))
    reach = placed.filter("size > 0").select("no", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block) - F.col("block") * block
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("block") * block
    parts_taken = reach.join(taken, ["no", "block"]).select("no", "start", (F.col("times") * (high - low) + F.greatest(F.lit(0), F.least(high, F.coalesce("part", F.lit(0))) - low)).alias("n"))
    sums = parts_taken.groupBy("no", "start").agg(F.sum("n").alias("n"), F.lit(True).alias("some"))
    out = placed.withColumn("some", F.col("size") > 0).join(sums, ["no", "start", "some"], "left")
    return out.select("key", "other", F.col("id").alias(id_col), "size", "source_size", "target", "start", F.coalesce("n", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: ``df``'s rows as often as they are taken whole, then cut to the words taken in part.

    Texts of which nothing is taken go. A cut text is its first words, joined by one space.
    """
    found = mix(df, id_col, text_col, source_col, **options).filter("taken > 0")
    times, left = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    pieces = F.concat(F.array_repeat(F.lit(-1).cast("long"), times), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<long>")))
    taken = found.select("key", "other", F.explode(pieces).alias("first"))  # at most cap + 1 for a row
    rows = df.select(*_keyed(df, id_col, text_col), F.struct("*").alias("row")).dropDuplicates(["key", "other"])
    rows = rows.join(taken, ["key", "other"]).select("row", "first")
    text = F.col("row").getField(text_col)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1), F.lit(1), F.greatest(F.col("first"), F.lit(1)).cast("int")), " ")
    text = F.when(F.col("first") < 0, text).otherwise(cut)
    return rows.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns])
