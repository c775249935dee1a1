"""Whitening of vectors along their leading principal directions.

Vectors become integers, x = floor(scale * c). Mean and covariance V are taken over the
distinct x (the fit list, divisor n), so copies don't weigh more. The leading eigenvectors
come from Chebyshev-filtered subspace iteration: a block Q of more columns than wanted goes
through a polynomial in V whose recurrence needs one distributed pass Xᵀ(X Q) over centred
rows for each degree; the polynomial is small on the interval between 0 and the block's
smallest Ritz value and grows fast above it. After each filter: QR, one more pass for VQ (also
the next filter's first), Rayleigh-Ritz. It ends when the wanted pairs' residuals are certified
to be rounding-sized beside the largest eigenvalue, or when they stop to fall at that level.
No d x d matrix is formed, and only d x block matrices reach the driver.

Rows whose vector is null, empty or holds null or non-finite entries take no part, and
neither do vectors of another length than the most frequent one (the longest of several).
Other rows each get their result: repeated rows, repeated and null ids too. Results are
numbered from 1 by falling eigenvalue. A direction without variance (one distinct vector,
constant dimensions) has ``whitened`` null and ``explained`` 0. With fewer dimensions than
wanted there is a row for each dimension. ``deviation`` is exact and null where it exceeds 64
bits; entries beyond 64 bits are held at the largest number. Equal eigenvalues leave the
choice of a basis open; it depends on the fit list alone. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.arrays import by_group
from sieveline.llm.frames import named, stored
from sieveline.llm.vectors import usable

#: Distinct vectors in one row of the fit list's table, and bytes of them that a task should read.
BLOCK_ROWS, TASK_BYTES = 2048, 64 << 20
#: Polynomial degree between two Rayleigh-Ritz steps, and columns beside the wanted ones.
DEGREE, GUARD = 12, 20
#: Residuals are certified below this share of the largest eigenvalue, or below the second one
#: where rounding lets them fall no further.
RESIDUAL, ROUNDING = 2e-14, 1e-12
_SAFE = 1 << 62


def _integers(vec, scale: float):
    return F.transform(vec.cast("array<double>"), lambda c: F.floor(c * scale).cast("long"))


def _blocks(d: int):
    """Distinct vectors (arrays of longs) gathered into binary blocks of the narrowest type."""
    schema = pa.schema([("bits", pa.int32()), ("block", pa.binary())])

    def task(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for at in range(0, len(x), BLOCK_ROWS):
                part = x[at : at + BLOCK_ROWS]
                bits = next(b for b in (16, 32, 64) if -(1 << (b - 1)) <= part.min() and part.max() < 1 << (b - 1))
                yield pa.RecordBatch.from_arrays([pa.array([bits], pa.int32()), pa.array([part.astype(f"<i{bits // 8}").tobytes()], pa.binary())], schema=schema)

    return task


def _rows_of(batch, d: int):
    for bits, raw in zip(batch.column("bits").to_pylist(), batch.column("block"), strict=True):
        yield np.frombuffer(raw.as_buffer(), f"<i{bits // 8}").reshape(-1, d).astype(np.int64)


class _Center:
    """x - S/n without rounding x or S first: (n x - S) / n in integers where they fit."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, as 64-bit integers or, where they might not fit, as Python's."""
        top = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
        if top * self.n + max(map(abs, self.sums)) < _SAFE:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n


_SUM = pa.schema([("grp", pa.int32()), ("v", pa.binary())])


def _add(key, batches):
    total = None
    for batch in batches:
        for raw in batch.column("v"):
            v = np.frombuffer(raw.as_buffer(), np.float64)
            total = v if total is None else total + v
    yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=_SUM)


def _tasks(df: DataFrame) -> int:
    return df._jdf.rdd().getNumPartitions()


def _summed(blocks: DataFrame, kernel, shape: tuple[int, ...], d: int) -> np.ndarray:
    """The sum of ``kernel(rows)`` over all blocks: inside tasks, in groups of tasks, then of groups."""
    tasks = _tasks(blocks)
    fan = max(8, math.isqrt(tasks))

    def partial(batches):
        total = np.zeros(shape)
        for batch in batches:
            for x in _rows_of(batch, d):
                total += kernel(x)
        group = TaskContext.get().partitionId() // fan
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=_SUM)

    parts = blocks.mapInArrow(partial, "grp int, v binary")
    if tasks > fan:
        parts = parts.groupBy("grp").applyInArrow(by_group(_add, _SUM), "grp int, v binary")
    rows = sorted((r["grp"], bytes(r["v"])) for r in parts.collect())  # one row a group of tasks
    return sum((np.frombuffer(v, np.float64).reshape(shape) for _, v in rows), np.zeros(shape))


def _filtered(apply, q, first, low, high, top, degree):
    """A Chebyshev polynomial of V, scaled to 1 at ``top``, times ``q``; ``first`` is V q."""
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = rate = half / (top - middle)
    before, now = q, (first - middle * q) * (rate / half)
    for _ in range(degree - 1):
        after = 1 / (2 / rate - sigma)
        before, now = now, 2 * after / half * (apply(now) - middle * now) - sigma * after * before
        sigma = after
    return now


def leading_eigenpairs(apply, d: int, k: int, degree: int = DEGREE, guard: int = GUARD, rounds: int = 60, seed: int = 7):
    """(eigenvalues, unit eigenvectors as columns, residual) of the symmetric operator ``apply``.

    ``residual`` is the largest |V q - e q| of the ``k`` leading pairs as a share of the largest e.
    """
    width = min(d, k + guard)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    image = apply(q)
    worst, best = np.inf, None
    for _ in range(rounds):
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        scale = abs(values[0])
        residual = float(np.linalg.norm(image[:, :k] - q[:, :k] * values[:k], axis=0).max()) / scale if scale else 0.0
        settled = residual >= worst / 2
        if residual < worst:
            worst, best = residual, (values[:k].copy(), q[:, :k].copy())
        if worst <= RESIDUAL or worst < ROUNDING and settled:
            return *best, worst
        if width == d:  # the block spans the space: only rounding is left to iterate on
            q = np.linalg.qr(q)[0]
        else:
            low, high = 0.0, max(float(values[-1]), 1e-12 * scale)
            top = max(float(values[0]), high * (1 + 1e-6))
            q = np.linalg.qr(_filtered(apply, q, image, low, high, top, degree))[0]
        image = apply(q)
    raise ArithmeticError(f"no certified eigenvectors after {rounds} rounds: residual {worst:.1e}")


_OUT = pa.schema([("component", pa.int32()), ("deviation", pa.int64()), ("whitened", pa.float64())])


def _project(center: _Center, d: int, vectors: np.ndarray, values: np.ndarray):
    k = len(values)
    scale = np.array([1 / math.sqrt(e) if e > 0 else np.nan for e in values])

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            whole = center.scaled(x)
            if whole.dtype == object or d * float(np.abs(whole).max()) ** 2 >= _SAFE:
                exact = (whole.astype(object) ** 2).sum(1)
                deviation = pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())
            else:
                deviation = pa.array((whole * whole).sum(1))
            white = (whole.astype(np.float64) / center.n) @ vectors * scale
            at = pa.array(np.repeat(np.arange(len(x)), k))
            numbers = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)))
            columns = [batch.column("id").take(at), numbers, deviation.take(at), pa.array(white.ravel(), from_pandas=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *_OUT.names])

    return task


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4, scale: float = 256.0, degree: int = DEGREE, guard: int = GUARD) -> DataFrame:
    """(``id_col``, component, n, deviation, whitened, explained, identity_error) for every usable row and component.

    ``n`` is the size of the fit list, ``deviation`` the sum over dimensions of (n x - S)²,
    ``explained`` the eigenvalue's share of the trace, ``identity_error`` the largest absolute
    entry of the whitened fit list's covariance minus the identity.
    """
    spark = df.sparkSession
    result = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    id_type = df.schema[id_col].dataType.simpleString()
    vectors = df.select(named(id_col).alias("id"), named(vec_col).alias("vec"))
    rows = vectors.filter(usable("vec") & (F.size("vec") > 0)).select("id", _integers(F.col("vec"), scale).alias("x"))
    rows = stored(rows, "integers")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    if lengths is None or components < 1:
        return spark.createDataFrame([], f"`{id_col.replace('`', '``')}` {id_type}, {result}")
    d = lengths["d"]
    rows = rows.filter(F.size("x") == d)
    distinct = rows.select("x").distinct()
    blocks = stored(distinct.mapInArrow(_blocks(d), "bits int, block binary"), "fit")
    size = blocks.agg(F.sum(F.octet_length("block"))).head()[0]
    blocks = blocks.coalesce(max(min(spark.sparkContext.defaultParallelism, -(-size // (1 << 20))), -(-size // TASK_BYTES)))

    moments = _exact_sums(blocks, d)
    n, center = moments[0], _Center(moments[0], moments[1])

    def product(q):
        return _summed(blocks, lambda x: (c := center(x)).T @ (c @ q), q.shape, d) / n

    trace = float(_summed(blocks, lambda x: np.array([(center(x) ** 2).sum()]), (1,), d)[0]) / n
    k = min(components, d)
    if trace > 0:
        values, found, _ = leading_eigenpairs(product, d, k, degree, guard)
        values = np.where(values > 1e-13 * trace, values, 0.0)
    else:
        values, found = np.zeros(k), np.eye(d)[:, :k]
    seen = int((values > 0).sum())
    error = 0.0
    if seen:
        turn = found[:, :seen] / np.sqrt(values[:seen])
        moment = _summed(blocks, lambda x: (z := center(x) @ turn).T @ z, (seen, seen), d) / n
        mean = _summed(blocks, lambda x: (center(x) @ turn).sum(0), (seen,), d) / n
        error = float(np.abs(moment - np.outer(mean, mean) - np.eye(seen)).max())
    out = rows.mapInArrow(_project(center, d, found, values), f"id {id_type}, component int, deviation long, whitened double")
    share = F.element_at(F.array(*[F.lit(float(e / trace) if trace > 0 else 0.0) for e in values]), F.col("component"))
    return out.select(F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def _exact_sums(blocks: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and each dimension's sum, as exact integers of any size."""
    schema = pa.schema([("dim", pa.int32()), ("s", pa.decimal128(38, 0))])

    def partial(batches):
        total, n = [0] * d, 0
        for batch in batches:
            for x in _rows_of(batch, d):
                n += len(x)
                wide = x.size and max(abs(int(x.min())), abs(int(x.max()))) * len(x) >= _SAFE
                total = [a + int(b) for a, b in zip(total, (x.astype(object) if wide else x).sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([n, *total], pa.decimal128(38, 0))], schema=schema)

    sums = blocks.mapInArrow(partial, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s"))
    found = {r["dim"]: int(r["s"]) for r in sums.collect()}  # a row for each dimension
    return found[-1], [found[i] for i in range(d)]
