"""Whitening against dense eigenvectors over the same integers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import types as T

from sieveline.llm import whitening
from sieveline.llm.queries import QUERIES

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("n", T.StringType()),
    T.StructField("component", T.IntegerType()),
    T.StructField("x", T.IntegerType()),
])


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def rows(d=24, n=400) -> list[tuple]:
    draw = np.random.default_rng(4)
    spread = np.linspace(3, 0.2, d)
    out = [(i, (draw.normal(size=d) * spread + 0.5).astype(np.float32).tolist()) for i in range(n)]
    out += [(5, out[9][1]), (None, out[9][1]), out[3], out[3]]  # copies, a repeated id, an id that is missing
    out += [(1000 + i, out[7][1]) for i in range(200)]
    out += [(700, None), (701, []), (702, [1.0] * (d - 1) + [None]), (703, [float("nan")] * d), (704, [float("inf")] * d), (705, [1.0, 2.0])]
    return [(*r, "old", 1, 2) for r in out]


def expected(vectors: list[tuple], k: int = 4, scale: float = 256.0):
    """(id, x) of rows that take part, and n, sums, eigenvalues, vectors and trace of their fit list."""
    given = [(i, [int(np.floor(scale * float(c))) for c in np.array(v, np.float32)]) for i, v in vectors]
    fit = np.array(sorted({tuple(x) for _, x in given}), dtype=np.int64)
    c = fit - fit.mean(0)
    values, turn = np.linalg.eigh(c.T @ c / len(fit))
    return given, len(fit), fit.sum(0), values[::-1][:k], turn[:, ::-1][:, :k], float(values.sum())


def compare(got, vectors, k=4, near=1e-8):
    given, n, sums, values, turn, trace = expected(vectors, k)
    by_place = {}
    for r in got:
        by_place.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert len(got) == len(given) * len(values)
    signs = None
    for i, x in given:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        mine = by_place[i, deviation]
        want = (np.array(x) - sums / n) @ turn / np.sqrt(values)
        have = np.array([mine[j + 1][0].whitened for j in range(len(values))])
        if signs is None and (abs(want) > 0.05).all():
            signs = np.sign(want * have)
    for i, x in given:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        want = (np.array(x) - sums / n) @ turn / np.sqrt(values) * signs
        for j in range(len(values)):
            for r in by_place[i, deviation][j + 1]:
                assert r.n == n and abs(r.whitened - want[j]) < near * (1 + abs(want[j]))
                assert abs(r.explained / (values[j] / trace) - 1) < 1e-10 and 0 <= r.identity_error < 1e-9


def usable(v):
    return v is not None and len(v) == 24 and all(c is not None and np.isfinite(c) for c in v)


def test_awkward_rows(spark, monkeypatch):
    want = [r[:2] for r in rows() if usable(r[1])]
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    compare(whitening.whiten(df).collect(), want)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    compare(whitening.whiten(df, degree=5, guard=3).collect(), want)


def test_query(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    compare(QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.01").collect(), [tuple(r) for r in given])


def test_directions_without_variance(spark):
    one = spark.createDataFrame([(1, [0.5, 1.0, 2.0]), (2, [0.5, 1.0, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(one).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == [(v, c, 1, 0, None, 0.0, 0.0) for v in (1, 2) for c in (1, 2, 3)]
    line = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<float>")
    got = sorted(whitening.whiten(line).collect())
    assert [abs(round(r.whitened * 5**0.5)) for r in got if r.component == 1] == [3, 1, 1, 3]
    assert all(r.whitened is None and r.explained == 0 for r in got if r.component == 2)


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [1e30 * (i % 2), float(i), 2.0**40 * i]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 18 and all(r.deviation is None and r.n == 6 for r in got)
    near = spark.createDataFrame([(i, [2.0**20 * i, 1.0 * i * i]) for i in range(8)], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(near).collect()}
    x = np.array([[(1 << 28) * i, 256 * i * i] for i in range(8)], dtype=object)
    for i in range(8):
        want = sum((8 * int(a) - int(s)) ** 2 for a, s in zip(x[i], x.sum(0), strict=True))
        assert got[i, 1].deviation == (want if want < 1 << 63 else None)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    out = whitening.whiten(none)
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")).collect() == []


def test_filter_finds_close_eigenvalues():
    draw = np.random.default_rng(0)
    turn = np.linalg.qr(draw.normal(size=(60, 60)))[0]
    values = np.concatenate([[5.0, 4.999, 4.0, 4.0], np.linspace(3.98, 0, 56)])
    v = turn * values @ turn.T
    passes = []
    found, vectors, residual = whitening.leading_eigenpairs(lambda q: passes.append(1) or v @ q, 60, 4)
    assert np.allclose(found, values[:4], atol=1e-12) and residual < 1e-12
    assert np.linalg.norm(v @ vectors - vectors * found) < 1e-11 and len(passes) < 120
