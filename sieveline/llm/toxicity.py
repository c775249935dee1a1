"""Toxicity: significant maximal-scoring segments of token log-odds.

0. Of labelled rows that share a class and the whole sequence of their tokens (by a 64-bit
   hash), one teaches. Else the rare words of a text with a thousand copies would look like
   evidence. Near copies differ in a token and teach each.
1. The teaching rows count, for every token and every stem (first 3 to 6 bytes of a token), the
   toxic and the clean texts that hold it. Tokens are runs of letters, A-Z folded. Tokens
   and stems share ``2**bits`` hashed slots, so counts and model have a fixed size whatever
   the vocabulary.
2. A slot's score is its log-odds between the classes under Dirichlet priors in proportion
   to the slot's share of all texts, taken at the ends of both rates' error bars that speak
   against it (zero where the bars overlap). A token has the largest score of its own slot
   and its stems', less a constant drift that makes the expected score negative.
3. A linear scan (Ruzzo and Tompa) finds every maximal-scoring segment of each text.
4. Extreme-value calibration: ``lambda`` solves sum(p * exp(lambda * score)) = 1 over clean
   tokens and ``K`` is fitted to clean training texts, so a segment of score S in a text of
   m tokens has the expectation E = K * m * exp(-lambda * S). A text's evidence is
   ln(1 + its smallest 1/E); a logistic curve fitted on the training rows turns it into a
   score from 0 to 1. Passages with E up to ``significant`` are returned.

Null and empty texts have no token and evidence 0. Rows with a null label or id don't teach.
Several labels for an id teach each; repeated rows get equal scores. Without labelled rows of
both classes every score is the share of toxic labels. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.arrays import batch_of, by_group, mix, packed, slices, unpacked, word_hashes, words
from sieveline.llm.frames import kept, named, schema_of, with_results

_SLICES = 64


def _not_letters() -> np.ndarray:
    table = np.ones(256, bool)
    table[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
    return table


_BREAKS = _not_letters()


#: Bytes of a token that make a stem.
_STEMS = (3, 4, 5, 6)


def _token_slots(data, offsets, bits):
    """For tokens, then for each length of stem: a slot for every token of the texts."""
    starts, ends, before = words(data, offsets, _BREAKS)
    spans = [ends, *(np.minimum(ends, starts + n) for n in _STEMS)]
    return [(word_hashes(data, starts, e, fold=True) >> np.uint64(64 - bits)).astype(np.int64) for e in spans], before


_SIGNS = pa.schema([("id", pa.int64()), ("sign", pa.int64())])


def _sign(batches):
    """A hash of each text's sequence of tokens."""
    for rows, data, offsets in slices(batches, "text"):
        starts, ends, before = words(data, offsets, _BREAKS)
        place = np.arange(len(starts)) - np.repeat(before[:-1], np.diff(before))
        hashes = mix(word_hashes(data, starts, ends, fold=True) + mix(place.astype(np.uint64)))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes, dtype=np.uint64)])
        yield batch_of(_SIGNS, [rows.column("id"), (sums[before[1:]] - sums[before[:-1]]).view(np.int64)])


def teaching(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, toxic) of the labelled rows that teach: all but copies within a class; ``texts``: id, text."""
    signs = texts.mapInArrow(_sign, "id long, sign long").join(labels, "id")
    return signs.groupBy("sign", "toxic").agg(F.min("id").alias("id")).select("id", "toxic").distinct()


_COUNTS = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])


def _count(bits: int):
    def task(batches):
        counts, any_row = np.zeros((2, 1 << bits), np.int64), False
        totals = np.zeros(2, np.int64)
        for rows, data, offsets in slices(batches, "text"):
            slots, before = _token_slots(data, offsets, bits)
            of = np.repeat(np.arange(rows.num_rows), np.diff(before)) << bits
            once = np.unique(np.concatenate([np.unique(of | s) for s in slots]))
            toxic = rows.column("toxic").to_numpy().astype(bool)
            for c in (0, 1):
                counts[c] += np.bincount(once[toxic[once >> bits] == c] & ((1 << bits) - 1), minlength=1 << bits)
                totals[c] += int((toxic == c).sum())
            any_row = True
        if any_row:
            parts = np.split(counts, _SLICES, axis=1)
            yield batch_of(_COUNTS, [[*range(_SLICES), -1], [*(packed(p) for p in parts), packed(totals)]])

    return task


def _add(key, batches):
    total = 0
    for batch in batches:
        for blob in batch.column("counts").to_pylist():
            total = total + unpacked(blob, np.int64)
    yield batch_of(_COUNTS, [[key[0]], [packed(total)]])


def token_counts(rows: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts by class (clean, toxic) that hold each slot, and texts by class; ``rows``: text, toxic."""
    parts = rows.mapInArrow(_count(bits), "slice int, counts binary").groupBy("slice").applyInArrow(by_group(_add, _COUNTS), "slice int, counts binary")
    found = {r["slice"]: unpacked(r["counts"], np.int64) for r in parts.collect()}
    if not found:
        return np.zeros((2, 1 << bits), np.int64), np.zeros(2, np.int64)
    return np.concatenate([found[i].reshape(2, -1) for i in range(_SLICES)], 1), found[-1]


def slot_scores(counts: np.ndarray, texts: np.ndarray, prior: float, errors: float) -> np.ndarray:
    """Log-odds of each slot under Dirichlet priors, from the cautious ends of both rates."""
    share = counts.sum(0) / max(1, texts.sum())
    mass = counts + prior * share
    room = errors * np.sqrt(mass + 1)
    size = (texts + prior)[:, None]
    low, high = np.maximum(mass - room, 0) / size, (mass + room) / size
    with np.errstate(divide="ignore"):
        toxic, clean = np.log(low[1]) - np.log(high[0]), np.log(high[1]) - np.log(low[0])
    return np.where(toxic > 0, toxic, np.where(clean < 0, clean, 0.0))


def decay(scores: np.ndarray, weight: np.ndarray) -> float:
    """The positive solution of sum(p * exp(lambda * score)) = 1, or 1 where there is none."""
    p = weight / max(1e-300, weight.sum())
    if (scores * p).sum() >= 0 or not ((scores > 0) & (p > 0)).any():
        return 1.0
    low, high = 0.0, 1.0
    grown = lambda x: float((p * np.exp(np.minimum(700, x * scores))).sum())
    while grown(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if grown(mid) < 1 else (low, mid)
    return high


def maximal_segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal-scoring segment (start, end, score), by one scan over the positive runs."""
    up = values > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]]).astype(np.int8)))
    if not len(edge):
        return []
    sums = np.concatenate([[0.0], np.cumsum(values)])
    found: list[list] = []  # start, end, sum before, sum at end
    for begin, end in edge.reshape(-1, 2).tolist():
        now = [begin, end, sums[begin], sums[end]]
        while True:
            at = len(found) - 1
            while at >= 0 and found[at][2] >= now[2]:
                at -= 1
            if at < 0 or found[at][3] >= now[3]:
                found.append(now)
                break
            now = [found[at][0], now[1], found[at][2], now[3]]
            del found[at:]
    return [(a, b, float(r - low)) for a, b, low, r in found]


_RAW_DDL = "tokens long, best double, passages array<struct<first:int,last:int,score:double>>"
_PASSAGES = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))


def _scan(shared, bits: int):
    def task(batches):
        table = shared.value
        for rows, data, offsets in slices(batches, "text"):
            slots, before = _token_slots(data, offsets, bits)
            values = np.maximum.reduce([table[s] for s in slots])
            hits = np.searchsorted(np.flatnonzero(values > 0), before)
            best, passages = np.zeros(rows.num_rows), [[] for _ in range(rows.num_rows)]
            for r in np.flatnonzero(np.diff(hits)):
                found = maximal_segments(values[before[r] : before[r + 1]])
                best[r] = max(s for _, _, s in found)
                passages[r] = [{"first": a, "last": b - 1, "score": s} for a, b, s in found]
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), rows.column("id"), pa.array(np.diff(before)), pa.array(best), pa.array(passages, _PASSAGES)],
                names=["row", "id", "tokens", "best", "passages"],
            )

    return task


def _logistic(cells: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope of a slightly ridged logistic curve over (evidence, clean, toxic) cells."""
    x = np.array([c[0] for c in cells])
    clean, toxic = np.array([c[1] for c in cells], float), np.array([c[2] for c in cells], float)
    a = b = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))
        n = clean + toxic
        g = np.array([(toxic - n * p).sum(), ((toxic - n * p) * x).sum() - 0.01 * b])
        w = n * p * (1 - p)
        h = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = 20, prior: float = 20.0, errors: float = 2.5, drift: float = 0.2, significant: float = 0.05) -> DataFrame:
    """``df`` with ``score``, ``predicted`` and ``passages``; ``labels`` (``id_col``, ``label_col``) teach.

    A passage gives the first and last token, its score and its expectation E in clean text.
    These three replace columns of the same name.
    """
    spark = df.sparkSession
    labels = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    teach = kept(teaching(texts, labels))
    counts, n = token_counts(texts.join(teach, "id").select("text", "toxic"), bits)
    table = slot_scores(counts, n, prior, errors) - drift
    lam = decay(table, counts[0].astype(float))
    shared = spark.sparkContext.broadcast(table)
    rows = df.select(F.struct(*[named(c) for c in df.columns if c != text_col]).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    raw = kept(rows.mapInArrow(_scan(shared, bits), schema_of(rows, ["row", "id"], _RAW_DDL)))
    taught = raw.select("id", "tokens", "best").join(labels, "id")
    size = F.greatest(F.col("tokens"), F.lit(1))
    sums = taught.filter("toxic = 0").agg(F.count("*"), F.sum(size * F.exp(-lam * F.col("best")))).collect()[0]
    k = sums[0] / sums[1] if sums[0] else 1.0
    evidence = F.log1p(F.exp(F.least(F.lit(700.0), lam * F.col("best") - F.log(size * F.lit(k)))))
    evidence = F.when(F.col("best") > 0, evidence).otherwise(F.lit(0.0))
    cells = taught.groupBy(F.round(F.least(evidence, F.lit(50.0)), 2).alias("x")).agg(F.count_if(F.col("toxic") == 0).alias("c"), F.count_if(F.col("toxic") == 1).alias("t")).collect()
    if n[0] and n[1]:
        a, b = _logistic([(r["x"], r["c"], r["t"]) for r in cells])
    else:
        share = float(n[1] / n.sum()) if n.sum() else 0.0
        a, b = math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.least(evidence, F.lit(50.0)))))
    expected = lambda p: F.lit(k) * size * F.exp(-lam * p["score"])
    passages = F.filter(F.transform("passages", lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), p["score"].alias("score"), expected(p).alias("expected"))), lambda p: p["expected"] <= significant)
    out = raw.select("row", score.alias("score"), passages.alias("passages")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return with_results(out, "row", ["score", "predicted", "passages"])
