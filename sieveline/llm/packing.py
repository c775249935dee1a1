"""Best-fit packing of token sequences by bin completion.

Lengths are small integers, so the packing is solved on their histogram (at most
``capacity`` rows, whatever the input) and then dealt out: every piece has a rank among the
pieces of its length, and ranks map to places of the solved patterns. Ranks come from
counts of (length, salt) groups, so one length may hold any share of the rows.

Branch and bound: the largest remaining length is completed by undominated fillings of the
rest of its sequence, all of them in turn, least waste first, made as the search asks for them
from the sums that the remaining lengths can reach. A filling is used as often as its lengths
last, on the way back once less. A branch is left when its waste shows that it can't beat the
incumbent. Incumbents are the best-fit-decreasing packing and then every better one found.
The search ends with the fewest sequences, when a lower bound is met or nothing is left to
try, or after ``steps`` fillings, dominated ones included, with the incumbent.

Null and empty texts are one end token. Repeated rows are packed each for itself. An empty
table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.arrays import batch_of, slices
from sieveline.llm.frames import fresh, kept, named, schema_of
from sieveline.llm.tokens import ByteBpe

#: Parts of the pieces of one length: at least so many, and one for so many pieces.
_SALTS, _SALT_ROWS = 256, 100_000
#: Deepest levels of the search that hold their fillings; each takes up to a megabyte.
_LEVELS = 32


def _pieces(capacity: int, end_id: int, vocabulary, ranks, keep_ids: bool):
    fields = [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema([*fields, *([("ids", pa.list_(pa.int32()))] if keep_ids else [])])

    def task(batches):
        bpe = ByteBpe(vocabulary, ranks)
        for rows, _, _ in slices(batches, "text"):
            out = []
            for doc, text in zip(rows.column("id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                ids = np.append(bpe.encode(text or b""), np.uint32(end_id)).astype("<u4")
                end = len(ids) % capacity or min(capacity, len(ids))
                start = number = 0
                while start < len(ids):
                    part = ids[start:end]
                    out.append((doc, number, start, end - start, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if keep_ids else [])))
                    start, end, number = end, end + capacity, number + 1
            if out:
                yield batch_of(schema, zip(*out, strict=True))

    return task


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None, ranks: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(``id_col``, piece, start, length, ids_crc32[, ids]): each text's ids and ``end_id``, cut to ``capacity``.

    Only longer texts are cut; the first piece takes what whole sequences leave over.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    ddl = "id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return rows.mapInArrow(_pieces(capacity, end_id, vocabulary, ranks, keep_ids), ddl).withColumnRenamed("id", id_col)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs (sum bound, and the bound by lengths above half)."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    best = -(-int((sizes * n).sum()) // capacity)
    for low in range(capacity // 2 + 1):
        large = sizes > capacity - low
        half = (sizes * 2 > capacity) & ~large
        small = (sizes >= low) & (sizes * 2 <= capacity)
        room = int((n[half] * (capacity - sizes[half])).sum())
        more = int((n[small] * sizes[small]).sum()) - room
        best = max(best, int(n[large].sum() + n[half].sum()) + max(0, -(-more // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, times): each length goes where it leaves least room, largest first."""
    open_bins: dict[int, list] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            rooms = [r for r in open_bins if r >= size]
            if not rooms:
                fit = capacity // size
                for pattern, times in (((size,) * fit, left // fit), ((size,) * (left % fit), int(left % fit > 0))):
                    if times:
                        open_bins.setdefault(capacity - sum(pattern), []).append((pattern, times))
                break
            room = min(rooms)
            pattern, times = open_bins[room].pop()
            fit = room // size  # further ones go to the same, now tightest, sequence
            use = min(times, left // fit) if left >= fit else 0
            if use:
                new, took = (*pattern, *(size,) * fit), use
            else:
                new, took, fit, use = (*pattern, *(size,) * left), 1, left, 1
            if times > took:
                open_bins[room].append((pattern, times - took))
            if not open_bins[room]:
                del open_bins[room]
            open_bins.setdefault(capacity - sum(new), []).append((new, took))
            left -= use * fit
    return [x for group in open_bins.values() for x in group]


def _sums(sizes: list[int], counts: dict[int, int], gap: int) -> list[int]:
    """For each number of smallest ``sizes``: bit t is set if lengths among them can add up to t."""
    within = (1 << (gap + 1)) - 1
    out, now = [1], 1
    most = 1 | within & -(1 << sizes[0]) if sizes else 1  # nothing lies between 0 and the smallest
    for i, size in enumerate(sizes):
        if now == most:
            out.extend([now] * (len(sizes) - i))
            break
        n, step = min(counts[size], gap // size), 1
        while n > 0:
            use = min(step, n)
            now |= now << (size * use) & within
            n, step = n - use, step * 2
        out.append(now)
    return out


def _exact(sizes: list[int], counts: dict[int, int], sums: list[int], total: int):
    """Every multiset of ``sizes`` that adds up to ``total``, longest lengths first."""

    def options(number, rest, chosen):
        for i in range(bisect.bisect_right(sizes, rest, 0, number), 0, -1):
            if not sums[i] >> rest & 1:
                return
            size = sizes[i - 1]
            for n in range(min(counts[size], rest // size), 0, -1):
                if sums[i - 1] >> (rest - n * size) & 1:
                    yield i - 1, rest - n * size, (*chosen, *(size,) * n)

    if not total:
        yield ()
        return
    stack = [options(len(sizes), total, ())]
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
        elif step[1]:
            stack.append(options(*step))
        else:
            yield step[2]


def _dominated(chosen: tuple[int, ...], free: int, waste: int) -> bool:
    """Can an unused length (a bit of ``free``) join, or take the place of some lengths, within the room?"""
    one = many = 0
    for size in chosen:
        many |= many << size | one << size
        one |= 1 << size
    low, high = many | 1, one << 1 if waste else 0  # a single length is replaced by a longer one only
    for reach, width in ((low, waste + 1), (high, waste)):
        step = 1
        while step < width:
            grow = min(step, width - step)
            reach |= reach << grow
            step += grow
        if width and reach & free & ~1:
            return True
    return False


def _fillings(sizes: list[int], counts: dict[int, int], gap: int, have: int | None = None):
    """Fillings of ``gap``, as they are asked for, least waste first; None for each dominated one. ``sizes`` ascends.

    ``have`` holds the sizes as bits. ``counts`` must be the same whenever the next one is
    asked for. A filling is dominated when an unused length fits beside it, or in the place of one or
    several of its lengths, since a packing never gets worse by such an exchange.
    """
    sizes = sizes[: bisect.bisect_right(sizes, gap)]
    sums = _sums(sizes, counts, gap)
    left = (sum(1 << s for s in sizes) if have is None else have) & ((1 << (gap + 1)) - 1)
    for total in range(gap, -1, -1):
        if not sums[-1] >> total & 1:
            continue
        for chosen in _exact(sizes, counts, sums, total):
            free = left
            for size in set(chosen):
                if chosen.count(size) == counts[size]:
                    free &= ~(1 << size)
            yield None if _dominated(chosen, free, gap - total) else chosen


def _key(pattern: tuple[int, ...], capacity: int):
    """Order of fillings around one length: by waste, then longest lengths first."""
    return capacity - sum(pattern), [-s for s in pattern]


def bin_completion(counts: dict[int, int], capacity: int, steps: int = 20_000) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, times) that hold every length of ``counts`` in few sequences.

    The fewest, unless ``steps`` fillings were looked at before that was certain.
    """
    counts = {s: n for s, n in counts.items() if n > 0}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    best = best_fit_decreasing(counts, capacity)
    fewest = sum(t for _, t in best)
    bound = lower_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    left, sizes = dict(counts), sorted(counts)
    path: list[list] = []  # pattern, times
    waste = used = tries = 0
    have = sum(1 << s for s in sizes)

    def take(pattern, times):
        nonlocal waste, used, have
        for s in set(pattern):
            before = left[s]
            left[s] = before - times * pattern.count(s)
            if before and not left[s]:
                sizes.pop(bisect.bisect_left(sizes, s))
                have ^= 1 << s
            elif not before and left[s]:
                bisect.insort(sizes, s)
                have ^= 1 << s
        waste, used = waste + times * (capacity - sum(pattern)), used + times

    def options(tried):
        """Fillings around the longest length left, after ``tried``; equal longest ones take them in order."""
        large = sizes[-1]
        after = _key(path[-1][0], capacity) if path and path[-1][0][0] == large else None
        if tried is not None:
            after = max(after or (-1, []), _key(tried, capacity))
        alone = not left[large]  # asked for while the one that the fillings lie beside is taken out
        for filling in _fillings(sizes[:-1] if alone else sizes, left, capacity - large, have ^ (1 << large) if alone else have):
            pattern = None if filling is None else (large, *filling)
            yield pattern if pattern and (after is None or _key(pattern, capacity) > after) else None

    # a level's fillings and the last one it used; only the deepest levels keep their
    # generators, others are made anew when the search comes back to them
    stack: list[list] = [[options(None), None]] if fewest > bound else []
    while stack and tries < steps and fewest > bound:
        if len(path) == len(stack):  # back from below: use the last filling once less, or another one
            pattern, times = path[-1]
            take(pattern, -times)
            path[-1][1] = times = times - 1
            if not times:
                path.pop()
        else:
            if stack[-1][0] is None:
                stack[-1][0] = options(stack[-1][1])
            large = sizes[-1]
            left[large] -= 1  # the one that the fillings lie beside
            pattern = next(stack[-1][0], ())
            left[large] += 1
            tries += 1
            if pattern is None:
                continue
            # wastes grow, so when one filling can't beat the incumbent no later one can
            if not pattern or waste + capacity - sum(pattern) > (fewest - 1) * capacity - total:
                stack.pop()
                continue
            stack[-1][1] = pattern
            room = (fewest - 1) * capacity - total - waste
            times = min(left[s] // pattern.count(s) for s in set(pattern))
            if sum(pattern) < capacity:
                times = min(times, room // (capacity - sum(pattern)))
            path.append([pattern, times])
        if not times:
            continue
        take(pattern, times)
        if sizes and used + 1 < fewest:
            if len(stack) >= _LEVELS:
                stack[-_LEVELS][0] = None
            stack.append([options(None), None])
        elif not sizes and used < fewest:
            fewest, best = used, [tuple(p) for p in path]
    return best


def _places(patterns):
    """For each length: ranks where a run of places starts, and its sequence, repeats and offset."""
    table: dict[int, list] = {}
    ranks: dict[int, int] = {}
    base = 0
    for pattern, times in patterns:
        offset = 0
        for size in sorted(set(pattern), reverse=True):
            n = pattern.count(size)
            table.setdefault(size, []).append((ranks.get(size, 0), base, times, offset))
            ranks[size] = ranks.get(size, 0) + times * n
            offset += n * size
        base += times
    return {s: np.array(rows, np.int64) for s, rows in table.items()}


def _deal(places, ranks: str):
    def task(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column(ranks).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                rows = places.value[int(size)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                local = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + local % row[:, 2]
                offset[at] = row[:, 3] + local // row[:, 2] * size
            names = [n for n in batch.schema.names if n != ranks]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return task


def pack(pieces: DataFrame, order_by: list[str], capacity: int = 2048, steps: int = 20_000) -> DataFrame:
    """``pieces`` (with ``length``) and each one's ``sequence_id`` and ``offset``, gapless from 0.

    ``order_by`` names columns that tell pieces apart; pieces of one length are dealt in their order.
    """
    spark = pieces.sparkSession
    salt, number, before, rank = (fresh(pieces, n) for n in ("salt", "number", "before", "rank"))
    keys = [named(c) for c in order_by]
    rows = kept(pieces)
    salts = max(_SALTS, -(-rows.count() // _SALT_ROWS))
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    groups = kept(rows.groupBy("length", salt).agg(F.count("*").alias(number)))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum(number).alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(bin_completion(counts, capacity, steps)))
    earlier = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", salt, F.coalesce(F.sum(number).over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy("length", salt).orderBy(*keys)
    ranked = rows.withColumn(number, F.row_number().over(inside)).join(groups, ["length", salt])
    ranked = ranked.select(*[named(c) for c in pieces.columns if c not in ("sequence_id", "offset")], (F.col(before) + F.col(number) - 1).alias(rank))
    return ranked.mapInArrow(_deal(places, rank), schema_of(ranked, ranked.columns[:-1], "sequence_id long, offset long"))
