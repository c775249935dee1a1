"""Embedding near-dedup by lattice hashing.

Unit vectors are projected to eight dimensions, in several tables with their own random
projection and shift, and decoded to the nearest point of the E8 lattice. A vector lies in
its own cell and probes the nearest neighbouring cells; two vectors meet in a table when one
lies in a cell that the other lies in or probes. Pairs that meet are verified by their cosine
in double precision. The link is counted in the first table and one cell where the pair meets,
which both vectors tell by themselves, so no pair is written out and none counts twice.

Equal vectors are one node with a multiplicity. Cells that hold one node are dropped before
any vector moves. A cell with more than ``TILE`` nodes is dealt into pairs of tiles, so its
work spreads over tasks whatever its size; a tile pair returns counts and a forest of links.

Vectors link within a group only (equal, non-null ``group_col``, and equal length). Null and
zero vectors, and those with null or non-finite components, link with nothing. An empty table
gives an empty result; rows that repeat an id and vector are vectors of their own.

Default tables, probes and scale find over 0.999 of the pairs with cosine 0.98 or more in
64-dimensional test data; the README has the figures.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.arrays import batch_of, by_group, mix
from sieveline.llm.components import connected_components
from sieveline.llm.frames import kept
from sieveline.llm.vectors import matrices, usable

TILE = 1024
_BUCKET_ROWS = 20_000


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: steps to the neighbouring cells."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            step = np.zeros(8)
            step[i], step[j] = a, b
            out.append(step)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: round, and on an odd sum turn the worst coordinate."""
    near = np.round(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point: the better one of the D8 point and the point of D8 shifted by a half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def _cell(points: np.ndarray) -> np.ndarray:
    out = np.zeros(points.shape[:-1], np.uint64)
    for i in range(8):
        out = mix(out + (2 * points[..., i]).astype(np.int64).view(np.uint64) + np.uint64(i + 1))
    return out.view(np.int64)


def unit(found: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest component first, so that nothing overflows."""
    top = np.abs(found).max(axis=1, keepdims=True, initial=0)
    found = found / np.where(top > 0, top, 1)
    length = np.sqrt((found * found).sum(1, keepdims=True))
    return found / np.where(length > 0, length, 1)


def codes(units: np.ndarray, tables: int, probes: int, scale: float, seed: int, roots: np.ndarray):
    """Cells: own (rows, tables) and probed (rows, tables, probes)."""
    n, dim = units.shape
    own, probed = np.empty((n, tables), np.int64), np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        draw = np.random.default_rng([seed, t, dim])
        turned = units @ (draw.standard_normal((dim, 8)) * (scale / math.sqrt(8))) + draw.random(8) * 2
        home = nearest_e8(turned)
        own[:, t] = _cell(home)
        if probes:
            near = np.argsort(-((turned - home) @ roots.T), axis=1, kind="stable")[:, :probes]
            probed[:, t] = _cell(home[:, None, :] + roots[near])
    return own, probed


_CODES = pa.schema([("node", pa.int64()), ("cell", pa.int64()), ("tab", pa.int32()), ("home", pa.bool_())])


def _emit(setup):
    encode = partial(codes, **setup, roots=_roots())

    def task(batches):
        for batch in batches:
            node, group = batch.column("node").to_numpy(), batch.column("group_key").to_numpy()
            for at, found in matrices(batch.column("vec")):
                own, probed = encode(unit(found))
                tables = own.shape[1]
                # one number for group, length, table and cell
                salt = mix((group[at].view(np.uint64)[:, None] + np.uint64(found.shape[1])) * np.uint64(2 * tables + 1) + np.arange(tables, dtype=np.uint64)[None, :])
                every = np.concatenate([own[:, :, None], probed], 2).view(np.uint64)
                keys = mix(every ^ salt[:, :, None]).view(np.int64)
                wide = keys.shape[2]
                home = np.zeros(keys.shape, bool)
                home[:, :, 0] = True
                tab = np.broadcast_to(np.arange(tables, dtype=np.int32)[None, :, None], keys.shape)
                yield batch_of(_CODES, [np.repeat(node[at], tables * wide), keys.ravel(), tab.ravel(), home.ravel()])

    return task


def _meet(own, probed, i, j, t):
    both = own[i, t] == own[j, t]
    i_in_j = (probed[j, t] == own[i, t][:, None]).any(1)
    j_in_i = (probed[i, t] == own[j, t][:, None]).any(1)
    return both, i_in_j, j_in_i


def local_roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that every index reaches over the links (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _counted(own, probed, home, tab, i, j):
    """Of the linked pairs (i, j), those that count in this cell of table ``tab``."""
    here, i_in_j, j_in_i = _meet(own, probed, i, j, tab)
    # the cell that counts: the shared one, else the first vector's, else the second's
    use = np.where(here, home[i] & home[j], np.where(i_in_j, home[i] & ~home[j], j_in_i & home[j] & ~home[i]))
    i, j = i[use], j[use]
    for t in range(tab):
        x, y, z = _meet(own, probed, i, j, t)
        new = ~(x | y | z)
        i, j = i[new], j[new]
    return i, j


def linked_pairs(units, group, own, probed, home, tab, left, right, cosine):
    """Pairs between the members ``left`` and ``right`` (the same ones: each pair once) that count in this cell.

    Members are numbered by node, so a pair's first vector is the same one in every cell.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, (1 << 21) // max(1, len(right)))
    for begin in range(0, len(left), step):
        rows = left[begin : begin + step]
        a, b = np.nonzero((units[rows] @ units[right].T >= cosine) & (group[rows][:, None] == group[right][None, :]))
        i, j = rows[a], right[b]
        i, j = (i[i < j], j[i < j]) if left is right else (np.minimum(i, j), np.maximum(i, j))
        out.append(_counted(own, probed, home, tab, i, j))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _compare(setup, cosine: float):
    encode = partial(codes, **setup, roots=_roots())

    def task(key, batches):
        table = pa.Table.from_batches(batches)
        pair = np.stack([table.column(c).to_numpy() for c in ("cell", "low", "high")], 1)
        node, tab, mult, group, tile = (table.column(c).to_numpy() for c in ("node", "tab", "mult", "group_key", "tile"))
        home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        for at, found in matrices(table.column("vec")):
            # a vector occurs in many cells of the bucket: encode it once; order by node so that
            # "first" and "second" of a pair mean the same in every cell
            names, first, of = np.unique(node[at], return_index=True, return_inverse=True)
            units = unit(found[first])
            own, probed = encode(units)
            order = np.lexsort((of, pair[at, 2], pair[at, 1], pair[at, 0]))
            rows, cut = at[order], pair[at][order]
            change = np.concatenate([[0], np.flatnonzero((cut[1:] != cut[:-1]).any(1)) + 1, [len(cut)]])
            links = np.zeros(len(names), np.int64)
            ends = []
            for low, high in zip(change[:-1], change[1:], strict=True):
                if high - low < 2:
                    continue
                mine, who = rows[low:high], of[order[low:high]]
                members, unique_at = np.unique(who, return_index=True)
                mine = mine[unique_at]
                in_home = np.zeros(len(names), bool)
                in_home[members] = home[mine]
                if not home[mine].any():
                    continue
                if pair[mine[0], 1] == pair[mine[0], 2]:
                    left = right = members
                else:
                    left, right = members[tile[mine] == pair[mine[0], 1]], members[tile[mine] == pair[mine[0], 2]]
                groups = np.zeros(len(names), np.int64)
                groups[members] = group[mine]
                weight = np.zeros(len(names), np.int64)
                weight[members] = mult[mine]
                i, j = linked_pairs(units, groups, own, probed, in_home, int(tab[mine[0]]), left, right, cosine)
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                ends.append((i, j))
            i, j = (np.concatenate(x) for x in zip(*ends, strict=True)) if ends else (np.zeros(0, int), np.zeros(0, int))
            if len(i):
                root = local_roots(i, j, len(names))
                some = np.flatnonzero(links)
                yield batch_of(_LINKS, [names[some], links[some], names[root[some]]])

    return task


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label", cosine: float = 0.98, tables: int = 6, probes: int = 4, scale: float = 3.0, seed: int = 7) -> DataFrame:
    """(``id_col``, n_links, component_id, kept) for every row of ``df``."""
    setup = {"tables": tables, "probes": probes, "scale": scale, "seed": seed}
    vec = F.col(vec_col).cast("array<double>")
    takes = usable(vec_col) & F.col(group_col).isNotNull() & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.lit(0), group_col).alias("group_key"), F.col(vec_col).alias("vec"), F.coalesce(takes, F.lit(False)).alias("takes"))
    rows = rows.withColumn("node", F.when(F.col("takes"), F.xxhash64("group_key", "vec")))
    nodes = rows.filter("takes").groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("mult"), F.first("group_key").alias("group_key"), F.first("vec").alias("vec"))
    nodes = kept(nodes)
    codes_of = nodes.select("node", "group_key", "vec").mapInArrow(_emit(setup), "node long, cell long, tab int, home boolean")
    cells = codes_of.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).filter("n > 1 and homes > 0")
    cells = cells.select("cell", F.ceil(F.col("n") / TILE).alias("tiles"))
    members = codes_of.join(cells, "cell").withColumn("tile", F.pmod(F.xxhash64("node", "cell"), F.col("tiles")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    members = members.select("node", "cell", "tab", "home", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    members = kept(members)
    buckets = max(1, math.ceil(members.count() / _BUCKET_ROWS))
    members = members.join(nodes.select("node", "mult", "group_key", "vec"), "node").withColumn("bucket", F.pmod(F.xxhash64("cell", "low", "high"), F.lit(buckets)))
    found = kept(members.groupBy("bucket").applyInArrow(by_group(_compare(setup, cosine), _LINKS), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("node", "first_id", "mult").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(ids, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    linked = rows.filter("takes").select("id", "node").join(named, "node").select("id", "n_links", "component_id")
    alone = rows.filter(~F.col("takes")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
