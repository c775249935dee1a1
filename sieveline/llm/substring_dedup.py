"""Substring dedup: a count-min prefilter, then exact grouping of what it lets through.

A word is removed when a window of ``window`` words that covers it also starts anywhere
else, in the same text or another. Windows are judged on the input.

1. Each partition counts, in a sparse sketch, the *anchors* of its windows. The anchor of
   a window is its smallest word gram (leftmost on ties), about half a window long. Equal
   windows at different places have equal anchors at different places, so the count of
   its anchor never underestimates a window's count, and there are about ten times fewer
   anchors than windows. The sketch slices are added on the executors.
2. A second pass hashes the windows whose anchor is estimated at two or more in every row
   of the sketch and groups them exactly by 128 bits. A window that repeats within a chunk
   of texts is known at once and is sent once, so a window that fills a third of the table
   reaches its group once for each chunk.
3. Repeated windows go back to their chunk, become word spans of rows, and are cut out.

The sketch has a fixed largest size. Beyond it more windows pass to the exact step; the
result is the same. Texts that are null, empty or shorter than a window keep every word.
Rows that repeat id and text repeat each other's windows and get the same spans. An empty
table gives an empty result. ``df`` is read three times and must give the same rows each
time, as a table does. Words are the parts between spaces and U+0009 to U+000D.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.arrays import batch_of, by_group, packed, runs, slices, unpacked, window_hashes, word_hashes, words
from sieveline.llm.frames import named, row_key, schema_of, with_results

#: Largest sketch row: 2**28 bits, 32 MB for each of the two rows once merged.
MAX_SKETCH_BITS = 28
#: Words of text that a second-pass chunk holds.
CHUNK_WORDS = 4 << 20
#: Bytes of text behind one group of windows.
BUCKET_BYTES = 12 << 20
_SHARD_BITS = 5
_ROW_STEPS = (np.uint64(1), np.uint64(0x9FB21C651E98DF25))


def _anchors(hashes, before, window):
    """Valid windows' first words, each one's anchor word, and the gram hash at every word."""
    gram = (window + 1) // 2
    grams = window_hashes(hashes, gram)
    starts = np.arange(max(0, len(hashes) - window + 1))
    if not len(starts):
        return starts, starts, grams
    text_end = np.repeat(before[1:], np.diff(before))
    starts = starts[starts + window <= text_end[: len(starts)]]
    # leftmost smallest of window - gram + 1 grams, by doubling
    best, span, wide = np.arange(len(grams)), 1, window - gram + 1
    while span < wide:
        step = min(span, wide - span)
        left, right = best[:-step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        span += step
    return starts, best[starts], grams


def _slots(keys, bits):
    return [(keys * step) >> np.uint64(64 - bits) for step in _ROW_STEPS]


def _sketch(bits: int, window: int):
    """Partition sketches: counts (one, or two and more) of the slots in use, by slot range."""

    def emit(keys):
        for r, slots in enumerate(_slots(np.concatenate(keys), bits)):
            slots = np.sort(slots)
            at = runs(slots)
            many = np.diff(at) > 1
            slots = slots[at[:-1]]
            cut = np.searchsorted(slots, np.arange(0, (1 << _SHARD_BITS) + 1, dtype=np.uint64) << np.uint64(bits - _SHARD_BITS))
            low = (slots & np.uint64((1 << (bits - _SHARD_BITS)) - 1)).astype(np.uint32)
            for shard in np.flatnonzero(np.diff(cut)):
                part = slice(cut[shard], cut[shard + 1])
                yield r, int(shard), packed(np.diff(low[part], prepend=np.uint32(0))), packed(many[part])

    def task(batches):
        keys, held = [], 0
        for rows, data, offsets in slices(batches, "text"):
            starts, ends, before = words(data, offsets)
            _, anchors, grams = _anchors(word_hashes(data, starts, ends), before, window)
            if len(anchors):
                keys.append(grams[anchors[runs(anchors)[:-1]]])
                held += len(keys[-1])
            if held > 4 << 20:
                yield batch_of(_SKETCH, zip(*emit(keys), strict=True))
                keys, held = [], 0
        if held:
            yield batch_of(_SKETCH, zip(*emit(keys), strict=True))

    return task


_SKETCH = pa.schema([("line", pa.int32()), ("shard", pa.int32()), ("slots", pa.binary()), ("many", pa.binary())])
_SKETCH_DDL = "line int, shard int, slots binary, many binary"


def _merge(bits: int):
    def add(key, batches):
        counts = np.zeros(1 << (bits - _SHARD_BITS), np.uint8)
        for batch in batches:
            for slots, many in zip(batch.column("slots").to_pylist(), batch.column("many").to_pylist(), strict=True):
                at = np.cumsum(unpacked(slots, np.uint32), dtype=np.int64)
                counts[at] = np.minimum(2, counts[at] + 1 + unpacked(many, np.uint8))
        yield batch_of(_MERGED, [[key[0]], [key[1]], [np.packbits(counts > 1, bitorder="little").tobytes()]])

    return add


_MERGED = pa.schema([("line", pa.int32()), ("shard", pa.int32()), ("bitmap", pa.binary())])
_MERGED_DDL = "line int, shard int, bitmap binary"


def _merged_sketch(texts: DataFrame, bits: int, window: int):
    """Two bitmaps: may the anchors of this slot occur twice?"""
    parts = texts.select("text").mapInArrow(_sketch(bits, window), _SKETCH_DDL)
    shards = 1 << _SHARD_BITS
    out = [np.zeros(1 << (bits - 3), np.uint8) for _ in _ROW_STEPS]
    wide = 1 << (bits - _SHARD_BITS - 3)
    for row in parts.groupBy("line", "shard").applyInArrow(by_group(_merge(bits), _MERGED), _MERGED_DDL).collect():
        out[row.line][row.shard * wide : (row.shard + 1) * wide] = np.frombuffer(row.bitmap, np.uint8)
    assert shards * wide == len(out[0])
    return out


#: kind 0: a chunk's rows (a: keys, b: words before each). kind 1: windows known to repeat
#: (a: positions). kind 2: windows to compare (a, b: their hashes, c: positions).
_TRAFFIC = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_TRAFFIC_DDL = "bucket int, chunk long, kind int, a binary, b binary, c binary"


def _candidates(sketch, bits: int, window: int, buckets: int):
    def maybe(keys):
        found = np.ones(len(keys), bool)
        for bitmap, slots in zip(sketch.value, _slots(keys, bits), strict=True):
            found &= (bitmap[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found

    def emit(chunk, rows, first, second, position, base):
        if not rows or not sum(map(len, position)):
            return
        home = (chunk >> 32) % buckets
        yield home, chunk, 0, packed(np.concatenate([r for r, _ in rows])), packed(np.concatenate([[0], *[b for _, b in rows]])), b""
        h1, h2, at = np.concatenate(first), np.concatenate(second), np.concatenate(position)
        order = np.lexsort((h2, h1))
        h1, h2, at = h1[order], h2[order], at[order]
        same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        begin = np.concatenate([[True], ~same])
        known = ~begin
        known[:-1] |= same
        if known.any():
            yield home, chunk, 1, packed(at[known]), b"", b""
        # one of each window goes to its group, marked when it is known already
        multi = known[begin].astype(np.uint32) << np.uint32(31)
        h1, h2, at = h1[begin], h2[begin], at[begin] | multi
        goes = (h1 >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        cut = runs(goes)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield int(goes[a]), chunk, 2, h1[a:b].tobytes(), h2[a:b].tobytes(), at[a:b].tobytes()

    def task(batches):
        number, base = TaskContext.get().partitionId() << 32, 0
        rows, first, second, position = [], [], [], []
        for batch, data, offsets in slices(batches, "text"):
            starts, ends, before = words(data, offsets)
            hashes = word_hashes(data, starts, ends)
            begins, anchors, grams = _anchors(hashes, before, window)
            at = runs(anchors)
            hit = np.repeat(maybe(grams[anchors[at[:-1]]]), np.diff(at))
            rows.append((batch.column("key").to_numpy(), before[1:] + base))
            begins = begins[hit]
            first.append(window_hashes(hashes, window)[begins])
            second.append(window_hashes(hashes, window, second=True)[begins])
            position.append((begins + base).astype(np.uint32))
            base += len(starts)
            if base >= CHUNK_WORDS:
                made = list(emit(number, rows, first, second, position, base))
                if made:
                    yield batch_of(_TRAFFIC, zip(*made, strict=True))
                number, base = number + 1, 0
                rows, first, second, position = [], [], [], []
        made = list(emit(number, rows, first, second, position, base))
        if made:
            yield batch_of(_TRAFFIC, zip(*made, strict=True))

    return task


def _group(key, batches):
    """Windows that more than one chunk sent, back to their chunks; the rest passes through."""
    sent, chunks = [], []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        other = batch.filter(pa.array(kind != 2))
        if other.num_rows:
            yield other
        for row in batch.filter(pa.array(kind == 2)).to_pylist():
            sent.append((np.frombuffer(row["a"], np.uint64), np.frombuffer(row["b"], np.uint64), np.frombuffer(row["c"], np.uint32)))
            chunks.append(row["chunk"])
    if not sent:
        return
    h1, h2, at = (np.concatenate(x) for x in zip(*sent, strict=True))
    of = np.repeat(np.arange(len(sent)), [len(x[0]) for x in sent])
    order = np.lexsort((h2, h1))
    same = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    found = np.zeros(len(order), bool)
    found[order] = twice
    found &= at < np.uint32(1 << 31)  # the others are known in their chunk
    made = [(key[0], c, 1, packed(at[x]), b"", b"") for i, c in enumerate(chunks) if len(x := np.flatnonzero(found & (of == i)))]
    if made:
        yield batch_of(_TRAFFIC, zip(*made, strict=True))


_SPANS = pa.schema([("key", pa.int64()), ("spans", pa.binary())])


def _spans(window: int):
    """A chunk's repeated windows as word ranges of its rows."""

    def task(key, batches):
        keys = before = None
        positions = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    keys, before = unpacked(row["a"], np.int64), unpacked(row["b"], np.int64)
                else:
                    positions.append(unpacked(row["a"], np.uint32).astype(np.int64))
        if not positions:
            return
        at = np.unique(np.concatenate(positions))
        row = np.searchsorted(before, at, "right") - 1
        begin = np.concatenate([[True], (at[1:] > at[:-1] + window) | (row[1:] != row[:-1])])
        low = at[begin]
        high = at[np.concatenate([begin[1:], [True]])] + window
        row = row[begin]
        cut = runs(row)
        made = [(keys[row[i]], np.stack([low[i:j], high[i:j]], 1) - before[row[i]]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        yield batch_of(_SPANS, ([k for k, _ in made], [s.astype(np.int64).tobytes() for _, s in made]))

    return task


def _cut(batches):
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            found = (text or b"").split()
            n = len(found)
            if spans:
                left, end = [], 0
                for low, high in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
                    left += found[end:low]
                    end = high
                found = left + found[end:]
            out.append((n, n - len(found), None if text is None else b" ".join(found).decode("utf-8", "replace")))
        total, gone, kept = zip(*out, strict=True) if out else ((), (), ())
        rest = [batch.column(c) for c in batch.schema.names if c not in ("text", "spans")]
        names = [c for c in batch.schema.names if c not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
            names=[*names, "n_words", "n_removed", "kept_text"],
        )


def sketch_bits(text_bytes: int) -> int:
    """A slot for 16 bytes of text, some four for an anchor."""
    return min(MAX_SKETCH_BITS, max(16, math.ceil(math.log2(max(1, text_bytes) / 16))))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, bits: int | None = None) -> DataFrame:
    """(key, spans) of the rows with repeated windows; spans: word ranges, pairs of 64-bit numbers."""
    if window < 2:
        raise ValueError("window must be at least 2")
    spark = df.sparkSession
    texts = df.select(row_key(id_col, text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    size = df.agg(F.coalesce(F.sum(F.octet_length(named(text_col))), F.lit(0))).head()[0]
    bits = bits or sketch_bits(size)
    buckets = max(32, math.ceil(size / BUCKET_BYTES))
    sketch = spark.sparkContext.broadcast(_merged_sketch(texts, bits, window))
    traffic = texts.mapInArrow(_candidates(sketch, bits, window, buckets), _TRAFFIC_DDL)
    grouped = traffic.groupBy("bucket").applyInArrow(by_group(_group, _TRAFFIC), _TRAFFIC_DDL)
    spans = grouped.groupBy("chunk").applyInArrow(by_group(_spans(window), _SPANS), "key long, spans binary")
    return spans.groupBy("key").agg(F.max("spans").alias("spans"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, bits: int | None = None) -> DataFrame:
    """``df`` with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space).

    ``kept_text`` is null where the text is null. These three replace columns of the same name.
    """
    spans = repeated_spans(df, id_col, text_col, window, bits)
    rows = df.select(row_key(id_col, text_col).alias("key"), F.struct(*[named(c) for c in df.columns if c != text_col]).alias("row"), named(text_col).cast("binary").alias("text"))
    joined = rows.join(spans, "key", "left").select("row", "text", "spans")
    out = joined.mapInArrow(_cut, schema_of(joined, ["row"], "n_words long, n_removed long, kept_text string"))
    return with_results(out, "row", ["n_words", "n_removed", "kept_text"])


def kept_hash() -> F.Column:
    return F.sha2(F.coalesce(F.col("kept_text"), F.lit("")).cast("binary"), 256)


def brute_force(texts: list[str | None], window: int) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, sha256 of the kept words) of every text, by a plain count; for tests."""
    split = [(t or "").encode().split() for t in texts]
    counts: dict = {}
    for w in split:
        for i in range(len(w) - window + 1):
            counts[tuple(w[i : i + window])] = counts.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out
