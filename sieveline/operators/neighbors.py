"""Exact cosine k-nearest-neighbour graph and the scores built on it.

Vectors are normalised, assigned to the nearest of a few pivots and packed into
groups of bounded size.  A task holds one group and has the other vectors stream past
it, keeping the k best per vector, so neither all pairs nor a whole cell is ever
materialised.  Cells that the triangle inequality rules out are not sent to a group.
That prunes clustered vectors of few dimensions; on spread-out vectors of tens of
dimensions it rules out nothing and every vector meets every other, so the comparisons
grow with the square of the rows.  What is shuffled grows with the rows: there are a few
groups for each core, and more only when these would not fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.scalars import stable_hash
from sieveline.runtime import cut_lineage

_DECIMALS = 9  # similarities are compared after rounding, so ties break by id
_GROUPS_A_CORE = 2  # each group is sent every vector that its own may be near to
_QUERIES, _CANDIDATES = 512, 2048  # vectors compared at once


def _assign(df: DataFrame, row_id: str, vec: str, pivots: np.ndarray) -> DataFrame:
    def nearest(batches):
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["v"].to_numpy()).astype(float)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(norm > 0, norm, 1.0)
            d2 = np.clip(2.0 - 2.0 * x @ pivots.T, 0, None)
            cell = d2.argmin(axis=1)
            yield pd.DataFrame({
                "id": b["id"], "x": list(x), "cell": cell.astype("int32"),
                "dist": np.sqrt(d2[np.arange(len(x)), cell]),
            })

    rows = df.select(F.col(row_id).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    id_type = df.schema[row_id].dataType.simpleString()
    return rows.mapInPandas(nearest, f"id {id_type}, x array<double>, cell int, dist double")


def _cell_targets(stats, pivots: np.ndarray, k: int) -> dict[int, list[int]]:
    """Cells that can hold one of the k nearest of some member of each cell."""
    cells = [r["cell"] for r in stats]
    radius = {r["cell"]: r["radius"] for r in stats}
    size = {r["cell"]: r["n"] for r in stats}
    out = {}
    for a in cells:
        gap = {b: float(np.linalg.norm(pivots[a] - pivots[b])) for b in cells}
        # at least k other vectors lie within this distance of every member of a
        bound, have = np.inf, 0
        for b in sorted(cells, key=lambda b: gap[b] + radius[b]):
            have += size[b] - (1 if b == a else 0)
            if have >= k:
                bound = radius[a] + gap[b] + radius[b]
                break
        out[a] = [b for b in cells if b == a or gap[b] - radius[a] - radius[b] <= bound + 1e-9]
    return out


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, which of them are there); a missing id has a filler in its place."""
    there = pc.is_valid(column).to_numpy(zero_copy_only=False)
    filler = pa.scalar(0 if pa.types.is_integer(column.type) else "", column.type)
    return pc.fill_null(column, filler).to_numpy(zero_copy_only=False), there


class _Best:
    """The k best candidates of every vector of a group, while candidates pass in ascending order of id."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, there: np.ndarray, k: int):
        self.x, self.ids, self.there, self.k = x, ids, there, k
        self.sim = np.full((len(x), k), -np.inf)
        self.dst = np.empty((len(x), k), dtype=ids.dtype)
        self.dst_there = np.zeros((len(x), k), dtype=bool)

    def meet(self, x: np.ndarray, ids: np.ndarray, there: np.ndarray) -> None:
        """Take in candidates, whose ids follow those of all before."""
        for at in range(0, len(ids), _CANDIDATES):
            tile = slice(at, at + _CANDIDATES)
            for lo in range(0, len(self.x), _QUERIES):
                self._tile(slice(lo, lo + _QUERIES), x[tile], ids[tile], there[tile])

    def _tile(self, rows: slice, x: np.ndarray, ids: np.ndarray, there: np.ndarray) -> None:
        sim = self.x[rows] @ x.T
        # an equal similarity loses to the smaller id met before; less than half a unit of rounding
        # above the worst kept one is equal
        least = self.sim[rows, -1] + 0.4 * 10.0**-_DECIMALS
        r, c = np.divmod(np.flatnonzero(sim > least[:, None]), max(1, len(ids)))
        value = np.round(sim[r, c], _DECIMALS)
        other = ~((self.ids[rows][r] == ids[c]) & self.there[rows][r] & there[c])
        other &= (value > self.sim[rows, -1][r]) & (value < np.inf)
        r, c, value = r[other], c[other], value[other]
        if not len(r):
            return
        hit = np.unique(r)
        at = hit + rows.start
        r = np.concatenate([np.repeat(hit, self.k), r])
        value = np.concatenate([self.sim[at].ravel(), value])
        dst = np.concatenate([self.dst[at].ravel(), ids[c]])
        known = np.concatenate([self.dst_there[at].ravel(), there[c]])
        order = np.lexsort((-value, r))  # stable: of equal ones the earlier
        r = r[order]
        first = order[np.arange(len(r)) - np.searchsorted(r, r) < self.k]
        self.sim[at] = value[first].reshape(-1, self.k)
        self.dst[at] = dst[first].reshape(-1, self.k)
        self.dst_there[at] = known[first].reshape(-1, self.k)

    def rows(self, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.x), _CANDIDATES):
            part = slice(lo, lo + _CANDIDATES)
            found = np.isfinite(self.sim[part])
            src = np.repeat(self.ids[part], found.sum(1))
            src_missing = ~np.repeat(self.there[part], found.sum(1))
            yield pa.RecordBatch.from_pydict({
                "src": pa.array(src, id_type, mask=src_missing),
                "dst": pa.array(self.dst[part][found], id_type, mask=~self.dst_there[part][found]),
                "similarity": pa.array(self.sim[part][found]),
            })


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def cosine_knn(df: DataFrame, row_id: str, vec: str, k: int = 5, block: int = 65_536) -> DataFrame:
    """(src, dst, rank, similarity): the k most similar other rows of every row, exact.

    Ties in the similarity (rounded to 9 places) go to the smaller id.  A task holds about
    ``block`` vectors at most, and a batch of those that stream past.
    """
    spark = df.sparkSession
    pivot_rows = df.select(F.col(vec).cast("array<double>").alias("v")).orderBy(stable_hash("pivot", row_id)).limit(64)
    pivots = np.array([r["v"] for r in pivot_rows.collect()], dtype=float)  # 64 vectors
    norms = np.linalg.norm(pivots, axis=1, keepdims=True)
    pivots = pivots / np.where(norms > 0, norms, 1.0)

    rows = cut_lineage(_assign(df, row_id, vec, pivots))
    stats = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).collect()  # <= 64
    targets = _cell_targets(stats, pivots, k)
    # every vector is sent to every group: a few groups a core, more when they would be too large
    wanted = _GROUPS_A_CORE * spark.sparkContext.defaultParallelism
    block = max(1, min(block, -(-sum(r["n"] for r in stats) // wanted)))
    # few rows per cell: merge small cells into shared groups, cut large ones by hash
    groups_of, n_groups, fill = {}, 0, block + 1
    for r in sorted(stats, key=lambda r: r["cell"]):
        if r["n"] <= block:
            if fill + r["n"] > block:
                n_groups, fill = n_groups + 1, 0
            groups_of[r["cell"]] = [n_groups - 1]
            fill += r["n"]
        else:
            parts = -(-r["n"] // block)
            groups_of[r["cell"]] = list(range(n_groups, n_groups + parts))
            n_groups, fill = n_groups + parts, block + 1
    met_by = {c: sorted({g for a, cells in targets.items() if c in cells for g in groups_of[a]}) for c in groups_of}
    # a group of several cells compares with all that any of them needs
    cell_groups = spark.createDataFrame(
        [(c, gs, len(gs), met_by[c]) for c, gs in groups_of.items()],
        "cell int, groups array<int>, parts int, met_by array<int>",
    )
    slot = (F.pmod(stable_hash("block", "id"), F.col("parts")) + 1).cast("int")
    placed = rows.join(F.broadcast(cell_groups), "cell")  # at most 64 rows
    own = F.array(F.struct(F.element_at("groups", slot).alias("g"), F.lit(0).alias("side")))
    sent = F.concat(own, F.transform("met_by", lambda g: F.struct(g.alias("g"), F.lit(1).alias("side"))))
    parted = placed.select("id", "x", F.explode(sent).alias("_to")).select("_to.g", "_to.side", "id", "x")
    # a partition for each group: first its own vectors, then the others in order of their ids
    parted = parted.repartitionById(max(1, n_groups), "g").sortWithinPartitions("side", F.col("id").asc_nulls_last())

    def best(batches):
        mine, held = [], None
        for b in batches:
            side = b.column("side").to_numpy()
            n_own = int(np.searchsorted(side, 1))
            own, others = b.slice(0, n_own), b.slice(n_own)
            if n_own:
                mine.append((_matrix(own), *_ids(own.column("id"))))
            if others.num_rows:
                if held is None:
                    held = _Best(*(np.concatenate(parts) for parts in zip(*mine, strict=True)), k) if mine else False
                if held:
                    held.meet(_matrix(others), *_ids(others.column("id")))
        if held:
            yield from held.rows(b.schema.field("id").type)

    id_type = rows.schema["id"].dataType.simpleString()
    local = parted.mapInArrow(best, f"src {id_type}, dst {id_type}, similarity double")
    order = F.struct((-F.col("similarity")).alias("s"), F.col("dst"))
    # k candidates of each row reach this point
    best_k = local.groupBy("src").agg(F.slice(F.sort_array(F.collect_list(order)), 1, k).alias("_l"))
    return best_k.select("src", F.posexplode("_l").alias("_p", "_e")).select(
        "src", F.col("_e.dst").alias("dst"), (F.col("_p") + 1).cast("int").alias("rank"),
        (-F.col("_e.s")).alias("similarity"),
    )


def affinity(knn: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    """Symmetric weighted edges (src, dst, w): the larger of the two directions.

    A row is its own nearest neighbour, so it has an edge of weight 1 to itself.
    """
    both = knn.select("src", "dst", F.col("similarity").alias("w")).unionByName(
        knn.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("similarity").alias("w"))
    )
    own = ids.select(F.col(row_id).alias("src"), F.col(row_id).alias("dst"), F.lit(1.0).alias("w"))
    return both.groupBy("src", "dst").agg(F.max("w").alias("w")).unionByName(own)


def inverse_laplacian(df: DataFrame, row_id: str, vec: str, k: int = 5) -> DataFrame:
    """Inverse Laplacian score per vector component on the cosine kNN graph.

    Score 1 - L'/D' with D' = f'Df - (f'D1)^2/sum(D), L' = f'Wf - (f'D1)^2/sum(D);
    the result is its inverse.
    """
    edges = cut_lineage(affinity(cosine_knn(df, row_id, vec, k), df, row_id))
    degree = edges.groupBy("src").agg(F.sum("w").alias("deg"))
    vecs = df.select(F.col(row_id).alias("id"), F.col(vec).cast("array<double>").alias("x"))
    d_side = (
        vecs.join(degree, F.col("id") == F.col("src"))
        .select("deg", F.posexplode("x").alias("j", "x"))
        .groupBy("j")
        .agg(F.sum(F.col("x") * F.col("x") * F.col("deg")).alias("fdf"),
             F.sum(F.col("x") * F.col("deg")).alias("fd"), F.sum("deg").alias("dd"))
    )
    pair = F.arrays_zip(F.col("x"), F.col("y"))
    w_side = (
        edges.join(vecs, F.col("src") == F.col("id")).drop("id")
        .join(vecs.select(F.col("id"), F.col("x").alias("y")), F.col("dst") == F.col("id"))
        .select("w", F.posexplode(pair).alias("j", "_p"))
        .groupBy("j")
        .agg(F.sum(F.col("w") * F.col("_p.x") * F.col("_p.y")).alias("fwf"))
    )
    centre = F.col("fd") * F.col("fd") / F.col("dd")
    d_prime, l_prime = F.col("fdf") - centre, F.col("fwf") - centre
    # a constant component has no spread; the denominator is then a large constant
    d_prime = F.when(d_prime < 1e-12, F.lit(10000.0)).otherwise(d_prime)
    return d_side.join(w_side, "j").select(
        F.concat(F.lit("f"), F.col("j").cast("string")).alias("feature"),
        (F.lit(1.0) / (F.lit(1.0) - l_prime / d_prime)).alias("score"),
    )
