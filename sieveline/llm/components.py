"""Connected components of an edge table, by rounds of joins on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.frames import kept


def _nearest(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, or itself if that is smaller."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    Alternating stars: in a round every node hands its larger neighbours, then its smaller
    ones, to the smallest node it knows. Every component ends as a star around its root
    after a number of rounds that grows with the logarithm of its longest path. Edges stay
    on the cluster; each round is written to the shared folder. Minima are taken before the
    shuffle, and a hot root's rows meet it in a join that Spark can split.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    pairs = kept(pairs.distinct())
    before = _state(pairs)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        near = _nearest(large)
        small = large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = kept(small.unionByName(near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        after = _state(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def union_find(a: list, b: list) -> list[tuple]:
    """(node, smallest node of its component) of a task's own edges."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in list(root)]
