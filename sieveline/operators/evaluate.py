"""Model metrics as aggregates, each grouped by any columns (split, model, seed).

Ranking metrics are computed from running totals per distinct score
(``ordering.cumulative``), so tied scores share their rank and no group is
sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.ordering import cumulative
from sieveline.runtime import spread

#: Scores of a series in one group, about.
_GROUP = 1 << 19
#: Scores that a task gathers before it sorts them and sends them on.
_GATHER = 1 << 21
#: One of so many sorted scores is shown to the sketch of bucket edges.
_STRIDE = 256
_MOST_BUCKETS = 1024


def _score_totals(df: DataFrame, label: str, score: str, by: list[str], series: int | None = None) -> DataFrame:
    pos = (F.col(label) > 0.5).cast("bigint")
    narrow = spread(df.select(*by, F.col(score).cast("double").alias("_s"), F.col(label).cast("double").alias(label)))
    return cumulative(narrow, by, "_s", {"pos": pos, "neg": 1 - pos}, series=series, settle=True)


def _auroc_sum():
    return F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / F.lit(2.0)))


def _auprc_sum():
    tp = F.col("total_pos") - F.col("before_pos")
    n = tp + F.col("total_neg") - F.col("before_neg")
    return F.sum(F.col("pos") * tp / n)


def auroc(df: DataFrame, label: str, score: str, by: list[str] = (), series: int | None = None) -> DataFrame:
    """Area under the ROC curve; a tied pair counts one half.  ``series``: the most groups there can be, if known."""
    by = list(by)
    pairs = F.max("total_pos").cast("double") * F.max("total_neg")
    return _score_totals(df, label, score, by, series).groupBy(*by).agg(
        (_auroc_sum() / F.when(pairs > 0, pairs)).alias("auroc")
    )


def _gathered(batches, scores, most: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Sorted scores and whether each is of a positive row, by series, of some batches at a time."""
    held: dict[int, list] = {}
    size = 0

    def sort():
        for g, parts in held.items():
            v, up = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(v)
            yield g, (v[order], up[order])

    for b in batches:
        if not b.num_rows:
            continue
        for g, up, v in scores(b):
            there = ~np.isnan(v)
            if there.any():
                held.setdefault(int(g), []).append((v[there], up[there]))
                size += len(v)
        if size >= most:
            yield dict(sort())
            held, size = {}, 0
    if held:
        yield dict(sort())


def _tied(v: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted values once each, with their counts added up."""
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    return v[starts], *[np.add.reduceat(c.astype(np.int64), starts) for c in counts]


def auroc_of_series(
    df: DataFrame, scores: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray]]],
    probe: DataFrame | None = None, like: Callable[[int], int] = int, longest: int | None = None,
) -> dict[int, float | None]:
    """Series → area under the ROC curve (None: one class only) of many score series of the same rows.

    ``scores(batch)`` yields (series, is positive, score) arrays for an Arrow batch, so scores are
    made where they are sorted.  A task sends each series' sorted distinct scores and their
    counts to range buckets in blocks; a group merges one bucket of one series and returns three
    numbers.  One pass sketches where the buckets of long series end, which only decides where the
    work runs, and one sends the blocks.  The sketch may look at a part ``probe`` of the rows
    and at the series ``like(g)`` instead of g; it is left out if a series has at most ``longest``
    scores and that is one group.  A tied pair counts one half; NaN takes no part.
    """
    group, most, stride = _GROUP, _GATHER, _STRIDE  # plain values for the tasks

    def sketch(batches):
        at = np.random.default_rng(TaskContext.get().partitionId())
        for piece in _gathered(batches, scores, most):
            drawn = [v[int(at.integers(stride)) :: stride] for v, _ in piece.values()]
            yield pa.RecordBatch.from_pydict({
                "g": pa.array(list(piece), pa.int32()), "n": pa.array([len(v) for v, _ in piece.values()], pa.int64()),
                "v": pa.array(drawn, pa.list_(pa.float64())),
            })

    looks = (df if probe is None else probe).mapInArrow(sketch, "g int, n long, v array<double>")
    looks = looks.select("g", "n", F.posexplode_outer("v").alias("i", "v"))
    probs = [i / _MOST_BUCKETS for i in range(1, _MOST_BUCKETS)]
    known = looks.groupBy("g").agg(
        F.sum(F.when(F.coalesce("i", F.lit(0)) == 0, F.col("n"))).alias("n"),
        F.percentile_approx("v", probs, 4 * _MOST_BUCKETS).alias("e"),
    )
    edges = {}
    short = longest is not None and longest <= group
    for r in [] if short else known.filter(F.col("n") > group).collect():  # one row for each long series
        buckets = min(_MOST_BUCKETS, -(-r["n"] // group))
        if r["e"]:
            edges[r["g"]] = np.unique([r["e"][_MOST_BUCKETS * i // buckets - 1] for i in range(1, buckets)])

    def blocks(batches):
        for piece in _gathered(batches, scores, most):
            rows = []
            for g, (v, up) in piece.items():
                v, pos, neg = _tied(v, up, ~up)
                cuts = np.searchsorted(v, edges.get(like(g), np.zeros(0)), side="right")
                for b, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(v)], strict=True)):
                    if lo < hi:
                        rows.append((g, b, v[lo:hi].tobytes(), pos[lo:hi].astype("i4").tobytes(), neg[lo:hi].astype("i4").tobytes()))
            g, b, v, pos, neg = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({
                "g": pa.array(g, pa.int32()), "b": pa.array(b, pa.int32()), "v": pa.array(v, pa.binary()),
                "pos": pa.array(pos, pa.binary()), "neg": pa.array(neg, pa.binary()),
            })

    def merge(table: pa.Table) -> pa.Table:
        whole = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[c]])
        v, pos, neg = whole("v", "f8"), whole("pos", "i4"), whole("neg", "i4")
        order = np.argsort(v, kind="stable")
        _, pos, neg = _tied(v[order], pos[order], neg[order])
        twice = int(np.sum(pos * (2 * (np.cumsum(neg) - neg) + neg)))
        return pa.table({
            "g": pa.array([table["g"][0].as_py()], pa.int32()), "b": pa.array([table["b"][0].as_py()], pa.int32()),
            "pos": pa.array([int(pos.sum())], pa.int64()), "neg": pa.array([int(neg.sum())], pa.int64()),
            "twice": pa.array([twice], pa.int64()),
        })

    sent = df.mapInArrow(blocks, "g int, b int, v binary, pos binary, neg binary")
    sums = sent.groupBy("g", "b").applyInArrow(merge, "g int, b int, pos long, neg long, twice long")
    parts: dict[int, list] = {}
    for r in sorted(sums.collect(), key=lambda r: (r["g"], r["b"])):  # a row for each series and bucket
        parts.setdefault(r["g"], []).append((r["pos"], r["neg"], r["twice"]))
    out = {}
    for g, each in parts.items():
        below = pairs = 0
        for pos, neg, twice in each:
            pairs += twice + 2 * pos * below
            below += neg
        total = sum(p[0] for p in each) * below
        out[g] = pairs / (2.0 * total) if total else None
    return out


def average_precision(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """Sum of (R_k - R_{k-1}) * P_k over distinct thresholds."""
    by = list(by)
    total = F.max("total_pos")
    return _score_totals(df, label, score, by).groupBy(*by).agg(
        (_auprc_sum() / F.when(total > 0, total)).alias("auprc")
    )


def balanced_accuracy(label: str, prob: str, cut: float = 0.5):
    y, hit = F.col(label) > 0.5, (F.col(prob) >= cut) == (F.col(label) > 0.5)
    recall = lambda cls: F.avg(F.when(cls, hit.cast("double")))
    return (recall(y) + recall(~y)) / F.lit(2.0)


def log_loss(label: str, prob: str, eps: float = 1e-15):
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    return F.avg(-(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p)))


def mse(label: str, pred: str):
    e = F.col(pred) - F.col(label)
    return F.avg(e * e)


def mae(label: str, pred: str):
    return F.avg(F.abs(F.col(pred) - F.col(label)))


def calibration_error(df: DataFrame, label: str, prob: str, by: list[str] = (), bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    by = list(by)
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1))
    per_bin = df.groupBy(*by, b.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(F.col(label).cast("double")).alias("_y"), F.avg(prob).alias("_p")
    )
    return per_bin.groupBy(*by).agg(
        (F.sum(F.col("_n") * F.abs(F.col("_y") - F.col("_p"))) / F.sum("_n")).alias("ece")
    )


def evaluate(df: DataFrame, label: str, prob: str, task: str = "classification", by: list[str] = ()) -> DataFrame:
    """All metrics of the task as (by, metric, value)."""
    by = list(by)
    keys = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    if task == "regression":
        wide = base.groupBy(*keys).agg(mse(label, prob).alias("mse"), mae(label, prob).alias("mae"))
        names = ["mse", "mae"]
    else:
        totals = _score_totals(base, label, prob, keys)
        pairs = F.max("total_pos").cast("double") * F.max("total_neg")
        ranked = totals.groupBy(*keys).agg(
            (_auroc_sum() / F.when(pairs > 0, pairs)).alias("auroc"),
            (_auprc_sum() / F.when(F.max("total_pos") > 0, F.max("total_pos"))).alias("auprc"),
        )
        simple = base.groupBy(*keys).agg(
            balanced_accuracy(label, prob).alias("b_acc"), log_loss(label, prob).alias("loss")
        )
        wide = ranked.join(simple, keys).join(calibration_error(base, label, prob, keys), keys)
        names = ["auroc", "auprc", "b_acc", "ece", "loss"]
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    return wide.select(*by, F.explode(entries).alias("_e")).select(*by, "_e.*")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n / (K * n_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0))  # one row per class
    return counts.select(
        label, "n",
        (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n").cast("double"))).alias("weight"),
    )
