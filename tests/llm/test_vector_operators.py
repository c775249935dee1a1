"""Operators on vectors against brute force, over awkward rows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm import lattice, topk
from sieveline.llm.components import connected_components, union_find

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
    T.StructField("node", T.StringType()),
    T.StructField("rank", T.IntegerType()),
])


def rows() -> list[tuple]:
    draw = np.random.default_rng(8)
    out = []
    centers = draw.normal(size=(8, 16))
    for i in range(240):
        v = centers[i % 8] + draw.normal(size=16) * (0.04 if i % 3 else 0.3)
        out.append((i, v.astype(np.float32).tolist(), [None, 0, 1, 1][i % 4] if i % 40 == 0 else i % 8 % 3))
    out += [(300, out[5][1], out[5][2]), (301, [2 * x for x in out[5][1]], out[5][2]), (302, out[5][1], 77)]  # copies
    out.append(out[9])  # a repeated row
    out += [(310, None, 1), (311, [], 1), (312, [0.0] * 16, 1), (313, [1.0] * 15 + [None], 1), (314, [float("nan")] * 16, 1), (315, [float("inf")] * 16, 1), (316, [1.0, 2.0], 1), (317, [1.0, 2.0], 1), (318, [1e30] * 16, 1), (350, [1e30] * 16, 1), (None, out[5][1], out[5][2]), (50, [0.5] * 16, 2)]
    return [(*r, "x", 1) for r in out]


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4).checkpoint()


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_top_k(vectors):
    given = [(r[0], [int(np.floor(256 * float(x))) for x in np.array(r[1], np.float32).tolist()]) for r in rows() if usable(r[1]) and r[0] is not None]
    want = Counter()
    queries = {(i, tuple(q)) for i, q in given if i % 50 == 0}
    for i, q in queries:
        found = sorted((-max(min(sum(a * b for a, b in zip(q, v, strict=True)), (1 << 63) - 1), -(1 << 63) + 1), j) for j, v in given if j != i and len(v) == len(q))
        want.update((i, n + 1, j, -s) for n, (s, j) in enumerate(found[:5]))
    for sizes in ((1024, 8192, 64), (2, 7, 3)):
        topk.TILE_ROWS, topk.SHARD_ROWS, topk.FAN_IN = sizes
        out = topk.exact_top_k(vectors, F.col("vec_id") % 50 == 0, k=5).collect()
        assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == want


def test_partial_selection_breaks_ties_by_id():
    found = np.array([[3, 5, 5, 5, 1], [2, 2, 2, 2, 2]])
    q, s, i = topk.best_of(found, np.zeros((2, 5), bool), np.array([9, 8, 2, 4, 1]), 2)
    assert list(zip(q.tolist(), s.tolist(), i.tolist(), strict=True)) == [(0, 5, 2), (0, 5, 4), (1, 2, 1), (1, 2, 2)]


def brute_links(given, cosine=0.98):
    """(positions that take part, linked pairs)."""
    ok = [i for i, r in enumerate(given) if usable(r[1]) and r[2] is not None and any(r[1])]
    pairs = []
    for n, i in enumerate(ok):
        for j in ok[n + 1 :]:
            if given[i][2] == given[j][2] and len(given[i][1]) == len(given[j][1]):
                a, b = (np.array(given[k][1], np.float32).astype(np.float64) for k in (i, j))
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    pairs.append((i, j))
    return ok, pairs


def test_links_and_components(vectors):
    given = rows()
    _, pairs = brute_links(given)
    links = Counter(x for p in pairs for x in p)
    roots = dict(union_find([i for i, _ in pairs], [j for _, j in pairs]))
    smallest: dict = {}
    for i, r in enumerate(given):
        if r[0] is not None:
            root = roots.get(i, i)
            smallest[root] = min(smallest.get(root, r[0]), r[0])
    want = Counter()
    for i, r in enumerate(given):
        c = smallest.get(roots.get(i, i))
        want[r[0], links[i], c, r[0] is not None and r[0] == c] += 1
    for tile in (1024, 5):  # small tiles deal every cell into tile pairs
        lattice.TILE = tile
        out = lattice.near_duplicates(vectors).collect()
        assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == want


def test_recall_against_brute_force(spark):
    """Clusters whose members lie around a cosine of 0.98 of each other, in 64 dimensions."""
    draw = np.random.default_rng(12)
    centers = draw.normal(size=(150, 64))
    x = centers[draw.integers(0, 150, 3000)] + draw.normal(size=(3000, 64)) * draw.choice([0.05, 0.1, 0.14, 0.2], (3000, 1))
    x = np.concatenate([x, draw.normal(size=(2000, 64)), np.repeat(centers[:1], 300, 0) * draw.uniform(0.5, 2, (300, 1))])
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.astype(np.float32).tolist())], SCHEMA.names[:3]).selectExpr("vec_id", "cast(embedding as array<float>) embedding", "label").repartition(4)
    given = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    x = lattice.unit(np.array([g[1] for g in given]))
    want = {given[i][0]: int(n) for i, n in enumerate((x @ x.T >= 0.98).sum(1) - 1)}
    got = {r.vec_id: r.n_links for r in lattice.near_duplicates(df).collect()}
    assert all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_lattice_points_are_nearest():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(300, 8)) * 2
    near = lattice.nearest_e8(x)
    assert (((2 * near) % 2).std(axis=1) == 0).all() and (near.sum(1) % 2 == 0).all()
    roots = lattice._roots()
    assert len({tuple(r) for r in roots}) == 240 and ((roots**2).sum(1) == 2).all()
    own = ((x - near) ** 2).sum(1)
    other = ((x[:, None, :] - near[:, None, :] - roots[None]) ** 2).sum(2).min(1)
    assert (own <= other + 1e-9).all() and (own <= 1 + 1e-9).all()


def test_components(spark):
    draw = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 120, (70, 2))] + [(200 + i, 201 + i) for i in range(60)] + [(400, 500 + i) for i in range(50)] + [(7, 7)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    want = dict(union_find([a for a, _ in pairs], [b for _, b in pairs]))
    assert {n: r for n, r in want.items() if n in got} == got
    assert all(n == r for n, r in want.items() if n not in got)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lattice.near_duplicates(none).collect() == []
    assert topk.exact_top_k(none, F.lit(True)).collect() == []
