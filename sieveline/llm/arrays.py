"""Words of UTF-8 texts as numpy arrays, inside Arrow tasks.

A batch's texts lie one after the other in one buffer. Words, their hashes and the hashes
of word windows are computed over slices of that buffer, so no text becomes a Python
string, no word an object, and memory is bounded by the slice (or by one text, if longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Bytes of text that are worked on at once.
SLICE_BYTES = 4 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers of the two polynomial hashes, and the first one's inverse modulo 2**64.
_BASE = 0xD1342543DE82EF95
_BASE2 = 0xAF251AF3B0F025B5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _byte_table(fold: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if fold:
        codes[65:91] += np.uint64(32)
    return mix((codes + np.uint64(1)) * _STEP)


def _spaces() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


#: The bytes that separate words: space and U+0009 to U+000D.
SPACES = _spaces()
_CASED, _FOLDED = _byte_table(False), _byte_table(True)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.binary()) if pa.types.is_string(column.type) else column, b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for consecutive rows with at most ``limit`` bytes, or one row."""
    for batch in batches:
        data, offsets = flat(batch.column(text))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
            yield batch.slice(begin, end - begin), data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
            begin = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES):
    """Start and end of every word, and for each text the number of words before it."""
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    inverse = pow(base, -1, 1 << 64)
    up = np.full(n + 1, base, np.uint64)
    down = np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_KEPT: dict = {}


def _kept_powers(base: int, n: int):
    have = _KEPT.get(base)
    if have is None or len(have[0]) <= n:
        have = _KEPT[base] = _powers(base, max(n, 1 << 20))
    return have


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; with ``fold``, A-Z count as a-z."""
    table = _FOLDED if fold else _CASED
    out = np.empty(len(starts), np.uint64)
    begin = 0
    while begin < len(starts):
        low = starts[begin]
        end = max(begin + 1, int(np.searchsorted(ends, low + (1 << 20), "right")))
        high = ends[end - 1]
        up, down = _kept_powers(_BASE, int(high - low))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * up[: high - low], dtype=np.uint64, out=sums[1:])
        s, e = starts[begin:end] - low, ends[begin:end] - low
        out[begin:end] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _STEP
        begin = end
    return mix(out)


def window_hashes(hashes: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes; ``second`` gives an independent one."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    base, step = (_BASE2, 1 << 18) if second else (_BASE, 1 << 18)
    up, down = _kept_powers(base, step + size)
    for begin in range(0, n, step):
        end = min(n, begin + step)
        part = hashes[begin : end + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], dtype=np.uint64, out=sums[1:])
        at = np.arange(end - begin)
        out[begin:end] = (sums[at + size] - sums[at]) * down[at]
    return mix(out + np.uint64(size))


def packed(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unpacked(blob, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def packed_by_byte(array: np.ndarray) -> bytes:
    """Like :func:`packed`, all first bytes of the numbers, then all second ones, ...: small numbers shrink more."""
    flat_ = np.ascontiguousarray(array).reshape(-1)
    return packed(flat_.view(np.uint8).reshape(len(flat_), flat_.itemsize).T)


def unpacked_by_byte(blob, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(unpacked(blob, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array starts, and its length at the end."""
    if not len(ordered):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]])


def batch_of(schema: pa.Schema, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def by_group(fn, schema: pa.Schema):
    """A function for ``applyInArrow`` from one that takes (key values, batches) and yields batches."""

    def task(key, table):
        return pa.Table.from_batches(fn(tuple(k.as_py() for k in key), table.to_batches()), schema)

    return task
