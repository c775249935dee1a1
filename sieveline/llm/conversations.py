"""Repair of conversations whose turns are missing, blank, doubled, cut short or out of turn.

A conversation's rows, by turn, are edited at least cost so that the roles' initials read
``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (2), Delete (3; blank and duplicate rows
must go), Insert an empty user or assistant row (2); a truncated row that stays costs 1 more.
The edits are shortest paths in a lattice whose nodes are (rows consumed, state of the role
grammar: nothing yet, system, user, assistant).

The auction algorithm finds them. Every node has an integer price; a path grows from the
origin along its cheapest arc (cost plus the price at its end) and contracts by a node when
that node's price can rise to its cheapest arc. Prices start at what the remaining rows cost
whatever happens, and stay below the true distances, so when the path reaches the end the
origin's price is the distance, and every cheapest path consists of tight arcs, those whose
cost is the difference of their prices. The audit is the first in ASCII order among tight
paths, traced over tight arcs that lead to the end. Many conversations run side by side.

An auction's work grows faster than a path's length, so sequences are cut into segments of
64 rows: auctions between all states of a segment's ends give 4 x 4 cost matrices, min-plus
products of them the prices at the ends, and a last auction each segment's audit.
Conversations of more than ``LONG_ROWS`` rows or ``LONG_BYTES`` bytes never meet in one task:
their rows are ordered by a range shuffle, numbered, and cut into pieces; only matrices and
states of pieces are gathered by conversation.

Missing roles and texts count as one space (so such a row is blank, or must be reroled), a
missing conversation id is a conversation of its own, missing turns come first. Rows of equal
turn are ordered by role, then text; equal rows are interchangeable. Roles other than system,
user and assistant go by their first character. Texts of any length are kept whole. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.arrays import by_group
from sieveline.llm.frames import kept, named

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of a segment, of a piece of a long conversation, and what makes a conversation long.
SEGMENT, PIECE, LONG_ROWS, LONG_BYTES = 64, 4096, 4096, 4 << 20
#: Sequences that one run of auctions works on.
BATCH = 2048

_SPACE = " \t\n\x0b\x0c\r"
_INITIALS = "sua"
#: States: nothing yet, system, user, assistant. Where Insert and Rerole lead, and Keep of s, u, a, other.
_NEXT = np.array([2, 2, 3, 2])
_KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_ROLE = {2: "user", 3: "assistant"}
_FORCED, _CUT = 4, 8
_FAR = 1 << 40
_EDITS = "DIKR"
_CLOSED = np.array([0, _FAR, _FAR, 0])


# --- auctions ------------------------------------------------------------------


def _lattice(codes: np.ndarray, n: np.ndarray, end: np.ndarray, last: np.ndarray):
    """(cost, target) of every node's arcs: Delete, Insert, Keep, Rerole, leave.

    ``codes`` (sequences x rows) holds the initial's number, 4 for a row that must go, and 8
    more if truncated; ``n`` the rows used, ``end`` the price at the end in each state, ``last``
    whether rows may still be inserted there. Node 4 i + q is state q before row i; the end
    is one more node.
    """
    k, rows = codes.shape
    sink = 4 * (rows + 1)
    cost = np.full((k, rows + 1, 4, 5), _FAR, np.int64)
    target = np.full((k, rows + 1, 4, 5), sink, np.int32)
    at = np.arange(rows + 1)
    inside = at[None, :] < n[:, None]
    final = at[None, :] == n[:, None]
    kind = np.full((k, rows + 1), _FORCED)
    kind[:, :rows] = np.where(inside[:, :rows], codes & 7, _FORCED)
    cut = np.zeros((k, rows + 1), np.int64)
    cut[:, :rows] = (codes & _CUT > 0) * TRUNCATED
    free = inside & (kind != _FORCED)
    for q in range(4):
        cost[:, :, q, 0] = np.where(inside, DELETE, _FAR)
        target[:, :, q, 0] = np.where(inside, 4 * (at + 1) + q, sink)
        cost[:, :, q, 1] = np.where(inside | final & last[:, None], INSERT, _FAR)
        target[:, :, q, 1] = 4 * at + _NEXT[q]
        to = np.where(free, _KEPT[q][np.minimum(kind, 3)], -1)
        cost[:, :, q, 2] = np.where(to >= 0, KEEP + cut, _FAR)
        target[:, :, q, 2] = np.where(to >= 0, 4 * (at + 1) + to, sink)
        cost[:, :, q, 3] = np.where(free, REROLE + cut, _FAR)
        target[:, :, q, 3] = np.where(free, 4 * (at + 1) + _NEXT[q], sink)
        cost[:, :, q, 4] = np.where(final, end[:, [q]], _FAR)
    floor = np.where(inside, np.where(free, np.minimum(cut, DELETE), DELETE), 0)
    price = np.concatenate([np.repeat(np.cumsum(floor[:, ::-1], 1)[:, ::-1], 4, 1), np.zeros((k, 1), np.int64)], 1)
    return cost.reshape(k, sink, 5), target.reshape(k, sink, 5), price


def _backward(rows: int, through: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Nodes from which arcs of ``through`` lead to the end."""
    k = len(through)
    found = np.zeros((k, 4 * (rows + 1) + 1), bool)
    found[:, -1] = True
    each = np.arange(k)[:, None, None]
    for i in range(rows, -1, -1):
        here = slice(4 * i, 4 * i + 4)
        forward = (through[:, here] & found[each, target[:, here]])[:, :, [0, 2, 3, 4]].any(2)
        found[:, here] = forward
        for _ in range(3):  # inserted rows stay before row i; three lead from any state to any other
            found[:, here] |= through[:, here, 1] & found[:, 4 * i + _NEXT]
    return found


def auction(codes: np.ndarray, n: np.ndarray, end: np.ndarray, last: np.ndarray, entries):
    """(prices, cost, target): node prices that are distances to the end at ``entries`` (states before row 0).

    An entry from which the end can't be reached keeps a price of ``_FAR`` or more.
    """
    cost, target, price = _lattice(codes, n, end, last)
    rows = codes.shape[1]
    sink = 4 * (rows + 1)
    reach = _backward(rows, cost < _FAR, target)
    price[~reach] = _FAR
    stack = np.zeros((len(codes), sink + 1), np.int32)
    for entry in entries:
        active = np.flatnonzero(reach[:, entry])
        node = np.full(len(codes), entry, np.int32)
        depth = np.zeros(len(codes), np.int32)
        while len(active):
            at = node[active]
            to = target[active, at]
            offers = cost[active, at] + price[active[:, None], to]
            choice = offers.argmin(1)
            best = offers[np.arange(len(active)), choice]
            rises = price[active, at] < best
            up = active[rises]  # raise the price, contract the path
            price[up, node[up]] = best[rises]
            up = up[depth[up] > 0]
            depth[up] -= 1
            node[up] = stack[up, depth[up]]
            on = active[~rises]  # extend the path along the cheapest arc
            stack[on, depth[on]] = node[on]
            depth[on] += 1
            node[on] = to[~rises, choice[~rises]]
            active = active[node[active] != sink]
    return price, cost, target


def _trace(codes, price, cost, target, entry: np.ndarray):
    """(audits, states at the end) of the first tight paths in ASCII order from ``entry`` on."""
    k, rows = codes.shape
    each = np.arange(k)
    tight = (cost + price[each[:, None, None], target] == price[:, :-1, None]) & (cost < _FAR)
    good = _backward(rows, tight, target)
    usable = tight & good[each[:, None, None], target]
    node, sink = entry.astype(np.int64), 4 * (rows + 1)
    out, state = np.zeros((k, 4 * rows + 8), np.uint8), np.full(k, -1)
    length = np.zeros(k, np.int64)
    active = np.flatnonzero(good[each, node])
    letters = np.frombuffer(_EDITS.encode(), np.uint8)
    while len(active):
        arc = usable[active, node[active]].argmax(1)
        leaves = arc == 4
        state[active[leaves]] = node[active[leaves]] % 4
        active, arc = active[~leaves], arc[~leaves]
        out[active, length[active]] = letters[arc]
        length[active] += 1
        node[active] = target[active, node[active], arc]
    return [out[i, : length[i]].tobytes() for i in range(k)], state


def _padded(sequences: list[np.ndarray]):
    n = np.array([len(s) for s in sequences], np.int64)
    codes = np.full((len(n), max(1, n.max(initial=0))), _FORCED, np.int8)
    for i, s in enumerate(sequences):
        codes[i, : len(s)] = s
    return codes, n


def _batches(sequences: list[np.ndarray]):
    order = np.argsort([len(s) for s in sequences], kind="stable")
    for at in range(0, len(order), BATCH):
        yield order[at : at + BATCH]


def _segments(sequence: np.ndarray) -> list[np.ndarray]:
    return [sequence[i : i + SEGMENT] for i in range(0, max(1, len(sequence)), SEGMENT)]


def _matrices(segments: list[np.ndarray]) -> np.ndarray:
    """Least cost from each state before a segment to each state behind it; nothing is inserted at its end."""
    out = np.full((len(segments), 4, 4), _FAR, np.int64)
    for batch in _batches(segments):
        codes, n = _padded([segments[i] for i in batch])
        for q in range(4):
            end = np.full((len(n), 4), _FAR, np.int64)
            end[:, q] = 0
            price, _, _ = auction(codes, n, end, np.zeros(len(n), bool), range(4))
            out[batch, :, q] = np.minimum(price[:, :4], _FAR)
    return out


def _through(matrix: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Prices before a stretch, or its costs to several ends, from those behind it."""
    return np.minimum((matrix[:, :, None] + end[None, :, :]).min(1), _FAR)


def piece_matrix(sequence: np.ndarray) -> np.ndarray:
    total = None
    for m in _matrices(_segments(sequence))[::-1]:
        total = m if total is None else _through(m, total)
    return total


def solve(sequences: list[np.ndarray], ends: np.ndarray, last: np.ndarray, entries) -> list[dict[int, tuple[int, int, bytes]]]:
    """For each sequence: entry state -> (cost, state at the end, audit), where the end can be reached."""
    parts = [_segments(s) for s in sequences]
    flat = [p for ps in parts for p in ps]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, np.int64)
    final = place == np.array([len(p) for p in parts], np.int64)[owner] - 1 if parts else np.zeros(0, bool)
    behind = np.full((len(flat), 4), _FAR, np.int64)
    behind[final] = ends
    closes = np.zeros(len(flat), bool)
    closes[final] = last
    inner = np.flatnonzero(~final)
    if len(inner):
        matrix = dict(zip(inner.tolist(), _matrices([flat[i] for i in inner]), strict=True))
        tails = np.flatnonzero(final & (place > 0))
        codes, n = _padded([flat[i] for i in tails])
        before, _, _ = auction(codes, n, behind[tails], closes[tails], range(4))
        before = dict(zip(tails.tolist(), np.minimum(before[:, :4], _FAR), strict=True))
        for i in inner[::-1].tolist():
            behind[i] = before[i + 1]
            before[i] = _through(matrix[i], behind[i][:, None])[:, 0]
    steps: list = [None] * len(flat)
    for batch in _batches(flat):
        codes, n = _padded([flat[i] for i in batch])
        low = behind[batch].min(1)
        low = np.where(low < _FAR, low, 0)
        end = np.where(behind[batch] < _FAR, behind[batch] - low[:, None], _FAR)
        inside = place[batch] > 0
        wanted = range(4) if inside.any() else entries
        price, cost, target = auction(codes, n, end, closes[batch], wanted)
        for j in batch:
            steps[j] = {}
        for q in wanted:
            audits, states = _trace(codes, price, cost, target, np.full(len(n), q))
            for j, audit, state, far, base in zip(batch, audits, states.tolist(), price[:, q].tolist(), low.tolist(), strict=True):
                if state >= 0:
                    steps[j][q] = (far + base, state, audit)
    out, at = [], 0
    for ps in parts:
        found = {}
        for entry in entries:
            state, audit = entry, []
            for i in range(at, at + len(ps)):
                if state not in steps[i]:
                    break
                _, state, text = steps[i][state]
                audit.append(text)
            else:
                found[entry] = (steps[at][entry][0], state, b"".join(audit))
        out.append(found)
        at += len(ps)
    return out


def applied(audit: bytes, codes: np.ndarray, entry: int = 0) -> list[tuple[str, int | None, str | None]]:
    """(edit, row consumed or None, new role or None) of each step."""
    state, row, out = entry, 0, []
    for edit in audit.decode():
        role = None
        if edit in "IR":
            state = int(_NEXT[state])
            role = _ROLE[state]
        elif edit == "K":
            state = int(_KEPT[state, codes[row] & 7])
        out.append((edit, None if edit == "I" else row, role))
        row += edit != "I"
    return out


def _illegal(initials: np.ndarray) -> int:
    """Adjacent pairs of initials that are not su, ua or au."""
    pair = initials[:-1] * 4 + initials[1:]
    return int((~np.isin(pair, [1, 6, 9])).sum())


# --- rows ----------------------------------------------------------------------


def damage(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: int = 20) -> DataFrame:
    """``df`` with faults, drawn by crc32 of ``id:turn`` modulo ``every`` (a missing one counts as one space).

    0 drops the row, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it, 4
    makes its role user; missing roles and texts become one space.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(named(id_col).cast("string"), space), F.coalesce(named(turn_col).cast("string"), space))
    draw = F.crc32(key.cast("binary")) % every
    role, text = F.coalesce(named(role_col), space), F.coalesce(named(text_col), space)
    row = F.struct(
        named(id_col).alias("conv"), named(turn_col).alias("turn"),
        F.when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
    )
    rows = df.select(F.explode(F.when(draw == 0, F.array()).when(draw == 3, F.array(row, row)).otherwise(F.array(row))).alias("row"))
    return rows.select(*[F.col("row").getField(a).alias(b) for a, b in (("conv", id_col), ("turn", turn_col), ("role", role_col), ("text", text_col))])


def _code(role: Column, text: Column) -> tuple[Column, Column]:
    """(initial's number + 8 if truncated, whether blank)."""
    tail = F.rtrim(text, F.lit(_SPACE))
    first = F.substring(role, 1, 1)
    initial = F.lit(3)
    for number, letter in enumerate(_INITIALS):
        initial = F.when(first == letter, number).otherwise(initial)
    blank = tail == ""
    cut = ~blank & ~F.substring(tail, -1, 1).isin(".", "!", "?")
    return (initial + F.when(cut, _CUT).otherwise(0)).cast("int"), blank


_FOUND = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_EDITED = "array<struct<edit string, role string, text string>>"


def _repair_whole(batches):
    """Conversations with all their rows in one cell: faults, auctions, edited rows."""
    fields = [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")]
    struct = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column("rows")
        bounds = cells.offsets.to_numpy() - cells.offsets[0].as_py()
        flat = cells.flatten()
        role, text = flat.field("role"), flat.field("text")
        code = flat.field("code").to_numpy(zero_copy_only=False).astype(np.int8)
        blank = flat.field("blank").to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        again = pd.DataFrame({"of": of, "role": role.to_pandas(), "text": text.to_pandas()}).duplicated().to_numpy()
        initials, cut = code & 7, code & _CUT > 0
        codes = np.where(blank | again, _FORCED, code).astype(np.int8)
        spans = list(pairwise(bounds.tolist()))
        # equal sequences of codes have equal edits
        distinct: dict[bytes, int] = {}
        which = [distinct.setdefault(codes[a:b].tobytes(), len(distinct)) for a, b in spans]
        sequences = [np.frombuffer(c, np.int8) for c in distinct]
        ends = np.tile(_CLOSED, (len(sequences), 1))
        solved = [s[0] for s in solve(sequences, ends, np.ones(len(sequences), bool), [0])]
        plans = [applied(s[2], c) for s, c in zip(solved, sequences, strict=True)]
        counted = np.stack([blank, again & ~blank, cut & ~again & ~blank]).astype(np.int64)
        sums = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(counted, 1)], 1)
        counts = sums[:, bounds[1:]] - sums[:, bounds[:-1]]
        edit, take, new, sizes = [], [], [], [0]
        for (a, _), w in zip(spans, which, strict=True):
            for e, row, other in plans[w]:
                if e != "D":
                    edit.append(e)
                    take.append(None if row is None else a + row)
                    new.append(other)
            sizes.append(len(edit))
        take = pa.array(take, pa.int64())
        roles = pc.coalesce(pa.array(new, pa.string()), role.take(take))
        texts = pc.fill_null(text.take(take), "")
        rows = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(edit, pa.string()), roles, texts], fields=list(struct)))
        illegal = pa.array([_illegal(initials[a:b]) for a, b in spans], pa.int64())
        cost = pa.array([solved[w][0] for w in which], pa.int64())
        audit = pa.array([solved[w][2].decode() for w in which])
        columns = [batch.column("conv"), batch.column("gaps"), *map(pa.array, counts), illegal, cost, audit, rows]
        yield pa.RecordBatch.from_arrays(columns, names=["conv", "gaps", *[f[0] for f in fields], "audit", "rows"])


def _gaps(low: Column, high: Column, distinct: Column) -> Column:
    wide = "decimal(20,0)"
    gap = high.cast(wide) - low.cast(wide) + 1 - distinct
    return F.coalesce(gap, F.lit(0)).cast("long")


def _lines(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.concat(r.getField("role"), F.lit(":"), r.getField("text"))), "\n")


# --- long conversations: pieces ----------------------------------------------------


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (key, turn, role, text) with code, blank, again and the row's ``piece`` and ``pos`` by a range shuffle."""
    code, blank = _code(F.col("role"), F.col("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("nth")]
    rows = rows.withColumn("nth", F.monotonically_increasing_id())  # lets equal rows lie in several ranges
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("nth")
    rows = rows.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    rows = kept(rows.withColumn("code", code).withColumn("blank", blank))
    first = rows.groupBy("key", "digest").agg(F.min("place").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    rows = rows.join(first.select("key", "digest", "first"), ["key", "digest"], "left")
    rows = rows.withColumn("again", F.coalesce(F.col("place") > F.col("first"), F.lit(False)))
    parts = rows.groupBy("key", "part").agg(F.min("place").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("key", "part", "low", F.coalesce(before, F.lit(0)).alias("before"))
    rows = rows.join(parts, ["key", "part"]).withColumn("nth", F.col("place") - F.col("low") + F.col("before"))
    return kept(rows.select("key", "turn", "role", "text", "code", "blank", "again", F.floor(F.col("nth") / PIECE).cast("long").alias("piece"), (F.col("nth") % PIECE).cast("int").alias("pos")))


def _codes_of(batch):
    for cell in batch.column("cells").to_pylist():
        yield np.array([c["code"] for c in cell], np.int8), np.array([c["initial"] for c in cell], np.int64)


def _ends_of(batch):
    return np.array(batch.column("end").to_pylist(), np.int64).reshape(-1, 4)


_MATRIX = pa.schema([("key", pa.int64()), ("piece", pa.int64()), ("matrix", pa.list_(pa.int64())), ("first", pa.int32()), ("final", pa.int32()), ("illegal", pa.int64())])


def _piece_matrices(batches):
    for batch in batches:
        for key, piece, (codes, initials) in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), _codes_of(batch), strict=True):
            row = [key, piece, piece_matrix(codes).ravel(), int(initials[0]), int(initials[-1]), _illegal(initials)]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _MATRIX, strict=True)], schema=_MATRIX)


_END = pa.schema([("key", pa.int64()), ("piece", pa.int64()), ("end", pa.list_(pa.int64()))])


def _prices_behind(key, batches):
    """Each piece's prices behind it; the last one closes the conversation and may insert there."""
    rows = sorted((r["piece"], r["matrix"]) for b in batches for r in b.to_pylist())
    end, out = _CLOSED, []
    for n, (piece, matrix) in enumerate(reversed(rows)):
        out.append((key[0], piece, end.tolist()))
        if not n:  # rows may be inserted behind the last piece
            for _ in range(3):
                end = np.minimum(end, end[_NEXT] + INSERT)
        end = _through(np.array(matrix).reshape(4, 4), end[:, None])[:, 0]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _END, strict=True)], schema=_END)


_EXIT = pa.schema([("key", pa.int64()), ("piece", pa.int64()), ("exits", pa.list_(pa.int32()))])


def _solved(batch, entries):
    codes = [c for c, _ in _codes_of(batch)]
    return codes, solve(codes, _ends_of(batch), np.array(batch.column("closes").to_pylist(), bool), entries)


def _exits(batches):
    for batch in batches:
        if batch.num_rows:
            _, found = _solved(batch, range(4))
            states = [[f[q][1] if q in f else -1 for q in range(4)] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("piece"), pa.array(states, _EXIT.field("exits").type)], schema=_EXIT)


_ENTRY = pa.schema([("key", pa.int64()), ("piece", pa.int64()), ("entry", pa.int32())])


def _entries(key, batches):
    state, out = 0, []
    for piece, exits in sorted((r["piece"], r["exits"]) for b in batches for r in b.to_pylist()):
        out.append((key[0], piece, state))
        state = exits[state]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ENTRY, strict=True)], schema=_ENTRY)


_STEP = pa.schema([("key", pa.int64()), ("piece", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("pos", pa.int32()), ("new", pa.string())])


def _steps(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, found = _solved(batch, range(4))
        for key, piece, entry, c, f in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), batch.column("entry").to_pylist(), codes, found, strict=True):
            plan = applied(f[entry][2], c, entry)
            edit, pos, new = zip(*plan, strict=True)
            n = len(plan)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([key] * n, [piece] * n, range(n), edit, pos, new), _STEP, strict=True)], schema=_STEP)


def _hashes(batches):
    """sha256 of each key's lines, which come in order; a key may span any number of batches."""
    schema = pa.schema([("key", pa.int64()), ("sha256", pa.string())])
    key, state = None, None
    for batch in batches:
        for k, line in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if state is None or k != key:
                if state is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], schema=schema)
                key, state = k, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(line.encode())
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], schema=schema)


def _repair_long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, edited rows) by ``key`` for conversations too long for one task."""
    rows = _numbered(rows)
    gone = F.col("blank") | F.col("again")
    cell = F.struct("pos", F.when(gone, _FORCED).otherwise(F.col("code")).alias("code"), F.col("code").bitwiseAND(7).alias("initial"))
    pieces = kept(rows.groupBy("key", "piece").agg(F.sort_array(F.collect_list(cell)).alias("cells")))  # PIECE small numbers each
    matrices = kept(pieces.mapInArrow(_piece_matrices, "key long, piece long, matrix array<long>, first int, final int, illegal long"))
    ends = matrices.select("key", "piece", "matrix").groupBy("key").applyInArrow(by_group(_prices_behind, _END), "key long, piece long, end array<long>")
    number = matrices.groupBy("key").agg(F.max("piece").alias("top"))
    ready = pieces.join(ends, ["key", "piece"]).join(number, "key").withColumn("closes", F.col("piece") == F.col("top")).drop("top")
    ready = kept(ready)
    exits = ready.mapInArrow(_exits, "key long, piece long, exits array<int>")
    entries = exits.groupBy("key").applyInArrow(by_group(_entries, _ENTRY), "key long, piece long, entry int")
    steps = kept(ready.join(entries, ["key", "piece"]).mapInArrow(_steps, "key long, piece long, step int, edit string, pos int, new string"))

    given = rows.select("key", "piece", "pos", "role", "text", F.col("code").bitwiseAND(_CUT).alias("cut"))
    edited = steps.join(given, ["key", "piece", "pos"], "left")
    price = F.when(F.col("edit") == "D", DELETE).when(F.col("edit") == "I", INSERT).when(F.col("edit") == "R", REROLE).otherwise(KEEP)
    price = price + F.when(F.col("edit").isin("K", "R") & (F.col("cut") > 0), TRUNCATED).otherwise(0)
    edited = kept(edited.select("key", "piece", "step", "edit", price.cast("long").alias("price"), F.coalesce("new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    stay = edited.filter("edit <> 'D'").drop("price")
    lines = stay.select("key", "piece", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    hashed = lines.repartition("key").sortWithinPartitions("key", "piece", "step").select("key", "line").mapInArrow(_hashes, "key long, sha256 string")
    letters = edited.groupBy("key", "piece").agg(F.sort_array(F.collect_list(F.struct("step", "edit"))).alias("e"), F.sum("price").alias("cost"))
    letters = letters.select("key", "piece", "cost", F.array_join(F.transform("e", lambda x: x.getField("edit")), "").alias("audit"))
    audits = letters.groupBy("key").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "audit"))), lambda x: x.getField("audit")), "").alias("audit"))
    pair = F.concat(F.lag("final").over(Window.partitionBy("key").orderBy("piece")), F.lit(","), F.col("first"))
    between = matrices.withColumn("pair", pair).groupBy("key").agg(F.sum(F.col("illegal") + F.when(F.col("pair").isNotNull() & ~F.col("pair").isin("0,1", "1,2", "2,1"), 1).otherwise(0)).alias("illegal"))
    turns = rows.groupBy("key").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("d"))
    counts = rows.groupBy("key").agg(F.count_if("blank").alias("blank"), F.count_if(F.col("again") & ~F.col("blank")).alias("duplicate"), F.count_if(~gone & (F.col("code") >= _CUT)).alias("truncated"))
    report = counts.join(turns, "key").join(between, "key").join(audits, "key").join(hashed, "key", "left")
    report = report.select("key", _gaps(F.col("low"), F.col("high"), F.col("d")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    place = F.row_number().over(Window.partitionBy("key", "piece").orderBy("step")) - 1
    sizes = stay.groupBy("key", "piece").count()
    ahead = F.sum("count").over(Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("key", "piece", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    out = stay.withColumn("place", place).join(sizes, ["key", "piece"])
    return report, out.select("key", (F.col("place") + F.col("ahead")).cast("long").alias("place"), "edit", "role", "text")


def repair(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, rows) of the cheapest edits of every conversation of ``df``.

    report: ``id_col``, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256
    (of the edited rows as ``role:text``, joined by newlines). rows: ``id_col``, place, edit
    (K, R or I), role, text.
    """
    space = F.lit(" ")
    rows = df.select(named(id_col).alias("conv"), named(turn_col).cast("long").alias("turn"), F.coalesce(named(role_col).cast("string"), space).alias("role"), F.coalesce(named(text_col).cast("string"), space).alias("text"))
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    long = kept(sizes.filter((F.col("n") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)).select("conv", F.monotonically_increasing_id().alias("key")))
    some = not long.isEmpty()
    short = rows
    if some:
        short = rows.alias("r").join(long.alias("l"), F.col("r.conv").eqNullSafe(F.col("l.conv")), "left_anti")
    code, blank = _code(F.col("role"), F.col("text"))
    cell = F.struct("turn", "role", "text", code.alias("code"), blank.alias("blank"))
    cells = short.groupBy("conv").agg(F.sort_array(F.collect_list(cell)).alias("rows"))
    turns = F.array_distinct(F.filter(F.transform("rows", lambda r: r.getField("turn")), lambda t: t.isNotNull()))
    cells = cells.select("conv", "rows", _gaps(F.array_min(turns), F.array_max(turns), F.size(turns)).alias("gaps"))
    kind = rows.schema["conv"].dataType.simpleString()
    found = kept(cells.mapInArrow(_repair_whole, f"conv {kind}, gaps long, {_FOUND}, rows {_EDITED}"))
    report = found.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(_lines(F.col("rows")), 256).alias("repaired_sha256"))
    edited = found.select("conv", F.posexplode("rows").alias("place", "row")).select("conv", F.col("place").cast("long").alias("place"), "row.*")
    if some:
        mine = rows.alias("r").join(long.alias("l"), F.col("r.conv").eqNullSafe(F.col("l.conv"))).select("l.key", "r.turn", "r.role", "r.text")
        long_report, long_rows = _repair_long(mine)
        report = report.unionByName(long_report.join(long, "key").drop("key"))
        edited = edited.unionByName(long_rows.join(long, "key").drop("key"))
    return report.withColumnRenamed("conv", id_col), edited.withColumnRenamed("conv", id_col)
