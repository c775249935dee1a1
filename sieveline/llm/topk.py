"""Exact top-k search by tiled matrix products.

Queries are gathered into tiles and all rows into shards of bounded size; every tile meets
every shard as one product of matrices. A tile's k best of a shard are cut by partial
selection, and the lists of a query are merged in a tree, ``fan_in`` at a time, so neither
a query's nor a shard's scores are ever gathered whole. Only the (few) queries are copied.

Components become floor(scale * x). Products whose sums stay below 2**53 are exact in
doubles; larger ones are computed in Python integers and clamp at the ends of 64 bits.
Equal scores go to the smaller id. Rows with the query's id are its own and no candidates.
Vectors that are null or hold null or non-finite components take no part, nor do rows
without an id; vectors of another length than the query's are no candidates. Rows that
repeat a candidate count each. An id that is a query with several vectors is answered for
each. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.arrays import batch_of, by_group
from sieveline.llm.vectors import matrices, usable

TILE_ROWS, SHARD_ROWS, FAN_IN = 1024, 8192, 64
_BLOCK = pa.schema([("part", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("cells", pa.binary())])
_BLOCK_DDL = "part long, dim int, ids binary, keys binary, cells binary"
_ENDS = (-(1 << 63) + 1, (1 << 63) - 1)


def _block(scale: float):
    def task(key, batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, keys = batch.column("id").to_numpy(), batch.column("key").to_numpy()
            for at, found in matrices(batch.column("vec")):
                cells = np.floor(np.clip(found, -1e300, 1e300) * scale)
                cells = cells.astype(np.float32) if np.abs(cells).max(initial=0) < 1 << 24 else cells
                yield batch_of(_BLOCK, [[key[0]], [found.shape[1]], [ids[at].tobytes()], [keys[at].tobytes()], [cells.tobytes()]])

    return task


def _unblock(ids, keys, cells, dim):
    ids = np.frombuffer(ids, np.int64)
    wide = np.float32 if len(cells) == 4 * len(ids) * dim else np.float64
    return ids, np.frombuffer(keys, np.int64), np.frombuffer(cells, wide).reshape(len(ids), dim).astype(np.float64)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of matrices that hold whole numbers."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if top < 1 << 53:
        return (queries @ rows.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in queries], object).reshape(queries.shape) @ np.array([[int(x) for x in r] for r in rows], object).reshape(rows.shape).T
    return np.clip(exact, *_ENDS).astype(np.int64)


def best_of(found: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
    """(query row, score, id) of each query's k best, ties to the smaller id; ``own`` marks pairs to leave out."""
    low = np.int64(-(1 << 63))
    found = np.where(own, low, found)
    if found.shape[1] > k:
        cut = np.partition(found, found.shape[1] - k, axis=1)[:, -k]
        q, c = np.nonzero((found >= cut[:, None]) & (found > low))
    else:
        q, c = np.nonzero(found > low)
    score, of = found[q, c], ids[c]
    order = np.lexsort((of, -score, q))
    q, score, of = q[order], score[order], of[order]
    first = np.searchsorted(q, q)
    top = np.arange(len(q)) - first < k
    return q[top], score[top], of[top]


_PART = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("part", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])


def _multiply(k: int):
    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q_keys, q = _unblock(row["q_ids"], row["q_keys"], row["q_cells"], row["dim"])
                ids, _, cells = _unblock(row["ids"], row["keys"], row["cells"], row["dim"])
                at, score, of = best_of(scores(q, cells), q_ids[:, None] == ids[None, :], ids, k)
                yield batch_of(_PART, [q_ids[at], q_keys[at], np.full(len(at), row["part"], np.int64), score, of])

    return task


def exact_top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best rows by integer inner product."""
    rows = df.filter(usable(vec_col) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("asks"))
    rows = rows.withColumn("key", F.xxhash64("id", "vec"))
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).collect()[0]
    shards, tiles = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(asked / TILE_ROWS))
    block = by_group(_block(scale), _BLOCK)
    spread = rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
    held = spread.groupBy("part").applyInArrow(block, _BLOCK_DDL)
    asks = rows.filter("asks").dropDuplicates(["key", "id"]).withColumn("part", F.pmod(F.col("key"), F.lit(tiles)))
    asks = asks.groupBy("part").applyInArrow(block, _BLOCK_DDL)
    # every tile goes to every shard: the smaller side is copied, the larger one stays
    asks = asks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("part"), "dim", *[F.col(c).alias(f"q_{c}") for c in ("ids", "keys", "cells")])
    out = held.join(asks, ["part", "dim"]).mapInArrow(_multiply(k), "query_id long, key long, part long, score long, vec_id long")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))), 1, k).alias("best")
    while shards > 1:
        shards = math.ceil(shards / FAN_IN)
        merged = out.groupBy("query_id", "key", F.floor(F.col("part") / FAN_IN).alias("part")).agg(best)
        out = merged.select("query_id", "key", "part", F.explode("best").alias("b")).select("query_id", "key", "part", (-F.col("b.down")).alias("score"), "b.vec_id")
    lists = out.groupBy("query_id", "key").agg(best)
    ranked = lists.select("query_id", F.posexplode("best").alias("rank", "b"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.down")).alias("score"))
