"""Language-model scoring with a hierarchical Pitman-Yor model.

A token is drawn from the restaurant of its context, the previous token. Each context has a
restaurant of its own, told apart by 64-bit hashes; all of them have the unigram restaurant
as parent, and that one a uniform base over the known tokens and one for all unknown ones.
In a restaurant, a token's customers sit at tables (Chinese restaurant seating); each table
is a customer of the parent. Seating is sampled by Gibbs: every sweep draws each token's
tables anew, given the totals of its restaurant and the parent's predictive probability
after the sweep before. Customers are seated one by one, later in blocks of an eighth of
those seated. A text's score is the log10 of its tokens' predictive probabilities, averaged
over the kept sweeps.

How it is spread: chunks of texts merge their tokens into (token, context) pairs. A pair goes
once a chunk, with its customers, to a block; the chunk keeps which texts hold it. A block
holds all pairs of its tokens, but a token that would fill more than ``1 / SPLIT`` of a block
(by a sample) is spread by context over as many blocks as it needs; so neither tokens nor
contexts nor pairs of any frequency meet in one task. Every sweep sends each block's tables
by context to groups of contexts, which add them up and answer with the restaurants' totals.
The spread tokens' few partial sums are added for the driver, which seats them at the root.
In the end blocks answer chunks with a score a pair (in 32 bits). Blocks are written once to
the shared folder; sweeps read only the columns of the seating and repeat the draws so far.

Tokens: A-Z folded words between spaces and U+0009 to U+000D, then one end. Null and empty
texts are one end. Rows that repeat an id are scored each. Words are told apart by 64-bit
hashes. Rows whose ``learn`` is null don't teach. An empty table gives an empty result;
without teaching rows every token has the one unknown token's probability, 1.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.arrays import batch_of, by_group, runs, slices, word_hashes, words
from sieveline.llm.arrays import packed_by_byte as packed
from sieveline.llm.arrays import unpacked_by_byte as unpacked
from sieveline.llm.frames import stored

CHUNK_TOKENS, CHUNK_TEXTS = 1 << 20, 1 << 16
#: Bytes of text for a block, texts a block in the sample for frequent tokens, parts of a block.
BLOCK_BYTES, SAMPLE, SPLIT = 8 << 20, 40, 4
_END, _START = np.uint64(0x5EED0E4D5EED0E4D), np.uint64(0x57A7257A7257A725)
_HALF = np.uint64(32)

#: kind 0, a chunk's texts: ids, tokens, learns, has an id; pairs of each token sent to each block in
#: turn; then (pair, text) entries: pairs, texts, counts. kind 1, a chunk's pairs for a block: tokens,
#: pairs of each, contexts, customers. kind 2, a block: pairs of each token, contexts, customers;
#: spread tokens' places and numbers; groups' cuts in the contexts, their hashes; chunks and
#: how many pairs each sent, these pairs. Contexts of a block's pairs and all (pair, text) and chunks'
#: pairs are steps from the one before.
_COLUMNS = ["a", "b", "c", "d", "e", "f", "g", "h", "i"]
_ROWS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), *[(x, pa.binary()) for x in _COLUMNS]])
_ROWS_DDL = "bucket int, chunk long, kind int, " + ", ".join(f"{x} binary" for x in _COLUMNS)


def _row(bucket, chunk, kind, *blobs):
    return (bucket, chunk, kind, *blobs, *[b""] * (len(_COLUMNS) - len(blobs)))


def _tokens(data, offsets):
    """Token hashes of the texts, each text's end included, and tokens before each text."""
    starts, ends, before = words(data, offsets)
    n = np.diff(before)
    out = np.empty(len(starts) + len(n), np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(starts)) + row] = word_hashes(data, starts, ends, fold=True)
    first = before + np.arange(len(before))
    out[first[1:] - 1] = _END
    return out, first


def _scaled(hashes: np.ndarray, parts) -> np.ndarray:
    """A number below ``parts`` for each hash, in the hashes' order."""
    return ((hashes >> _HALF) * np.asarray(parts, np.uint64) >> _HALF).astype(np.int64)


def _counted(batches):
    """Tokens and how often they occur; null: all of them."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])
    for _, data, offsets in slices(batches, "text"):
        tokens, count = np.unique(_tokens(data, offsets)[0], return_counts=True)
        yield batch_of(schema, [[None, *tokens.view(np.int64).tolist()], [int(count.sum()), *count.tolist()]])


def _frequent(rows: DataFrame, texts: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that fill a large part of a block, in order, and over how many blocks each is spread."""
    some = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(max(1, texts // (SAMPLE * buckets)))) == 0)
    counts = some.mapInArrow(_counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    # no more tokens than these can have such a share; the null row is the largest
    found = {r["token"]: r["n"] for r in counts.orderBy(F.desc("n")).limit(SPLIT * buckets + 1).collect()}
    total = found.pop(None, 0)
    parts = {np.uint64(t % (1 << 64)): SPLIT * buckets * n / total for t, n in found.items()}
    names = np.array(sorted(t for t, n in parts.items() if n > 1), np.uint64)
    return names, np.array([min(buckets, math.ceil(parts[t]) + 1) for t in names], np.int64)


def _places(names: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the spread tokens stand in ``names``, and their numbers; both in order."""
    _, at, number = np.intersect1d(names, frequent, assume_unique=True, return_indices=True)
    return at, number


def _chunks(buckets: int, frequent: np.ndarray, spread: np.ndarray):
    def emit(chunk, ids, named, learns, sizes, tokens):
        learns, sizes = np.concatenate(learns), np.concatenate(sizes)
        tokens.append(np.array([_START]))
        tokens[:] = [np.concatenate(tokens)]
        names, of = np.unique(tokens.pop(), return_inverse=True)
        context = np.concatenate([of[-1:], of[:-2]])
        context[np.cumsum(sizes)[:-1]] = of[-1]
        pair = of[:-1].astype(np.uint64) << _HALF
        pair |= context.astype(np.uint64)
        del of, context
        pair, of = np.unique(pair, return_inverse=True)
        token, context = (pair >> _HALF).astype(np.int64), pair.astype(np.uint32)
        width = np.ones(len(names), np.int64)
        at, number = _places(names, frequent)
        width[at] = spread[number]
        home = (_scaled(names, buckets)[token] + _scaled(names[context], width[token])) % buckets
        order = np.argsort(home, kind="stable")
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        token, context = token[order], names[context[order]]
        key = rank[of] << np.uint64(16)
        del of, rank
        key |= np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
        key.sort()
        at = runs(key)
        key, count = key[at[:-1]], np.diff(at).astype(np.uint32)
        rank, text = (key >> np.uint64(16)).astype(np.int64), key.astype(np.uint16)
        customers = np.bincount(rank, weights=count * learns[text], minlength=len(pair)).astype(np.int64)
        cut = np.searchsorted(home[order], np.arange(buckets + 1))
        every = []
        for b in np.flatnonzero(np.diff(cut)):
            s = slice(cut[b], cut[b + 1])
            at = runs(token[s])
            each = np.diff(at).astype(np.uint32)
            every.append(each)
            yield _row(int(b), chunk, 1, packed(names[token[s][at[:-1]]]), packed(each), packed(context[s]), packed(customers[s]))
        blobs = [np.concatenate(ids), sizes, learns.astype(np.uint8), np.concatenate(named).astype(np.uint8), np.concatenate(every), np.diff(rank, prepend=0).astype(np.uint32), text, count]
        # a group of its own, so that no block's task holds it
        yield _row(-1 - ((chunk >> 32) * 8191 + chunk % (1 << 32)) % (1 << 30), chunk, 0, *map(packed, blobs))

    def task(batches):
        number, held, rows, kept = TaskContext.get().partitionId() << 32, 0, 0, [[] for _ in range(5)]
        for batch, data, offsets in slices(batches, "text"):
            tokens, first = _tokens(data, offsets)
            if rows and (held + len(tokens) > CHUNK_TOKENS or rows + batch.num_rows > CHUNK_TEXTS):
                yield batch_of(_ROWS, zip(*emit(number, *kept), strict=True))
                number, held, rows, kept = number + 1, 0, 0, [[] for _ in range(5)]
            ids = batch.column("id")
            found = (ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), batch.column("learn").to_numpy(zero_copy_only=False).astype(bool), np.diff(first), tokens)
            for x, y in zip(kept, found, strict=True):
                x.append(y)
            held, rows = held + len(tokens), rows + batch.num_rows
        if rows:
            yield batch_of(_ROWS, zip(*emit(number, *kept), strict=True))

    return task


def _gather(groups: int, frequent: np.ndarray):
    """A block's pairs from all chunks in one row, and who asks for which; rows of texts pass through."""

    def task(group, batches):
        sent = []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            texts = batch.filter(pa.array(kind == 0))
            if texts.num_rows:
                yield texts
            for r in batch.filter(pa.array(kind == 1)).to_pylist():
                sent.append((r["chunk"], unpacked(r["a"], np.uint64), unpacked(r["b"], np.uint32), unpacked(r["c"], np.uint64), unpacked(r["d"], np.int64)))
        if not sent:
            return
        sent.sort(key=lambda s: s[0])
        chunks, found, each, contexts, learned = map(list, zip(*sent, strict=True))
        sent.clear()
        entries = np.array([len(c) for c in contexts], np.int64)
        first = np.cumsum(entries) - entries
        contexts, of = np.unique(np.concatenate(contexts), return_inverse=True)
        names = np.unique(np.concatenate(found))
        key = np.concatenate([np.repeat(np.searchsorted(names, n).astype(np.uint32), e) for n, e in zip(found, each, strict=True)]).astype(np.uint64) << _HALF
        key |= of.astype(np.uint64)
        del of, found
        every, of = np.unique(key, return_inverse=True)
        del key
        customers = np.bincount(of, weights=np.concatenate(learned), minlength=len(every)).astype(np.int64)
        each = np.bincount((every >> _HALF).astype(np.int64), minlength=len(names)).astype(np.uint32)
        steps = np.diff(of, prepend=0)
        steps[first] = of[first]
        del of, learned
        cuts = np.searchsorted(_scaled(contexts, groups), np.arange(groups + 1))
        blobs = [each, np.diff(every.astype(np.uint32), prepend=np.uint32(0)), customers, *_places(names, frequent), cuts, contexts, np.stack([chunks, entries]).astype(np.int64), steps.astype(np.uint32)]
        yield batch_of(_ROWS, [[x] for x in _row(group[0], chunks[0], 2, *map(packed, blobs))])

    return task


def _blocks(rows: DataFrame, buckets: int, groups: int, frequent: np.ndarray, spread: np.ndarray) -> DataFrame:
    """The texts of chunks and the blocks; ``rows``: id, learn, text."""
    sent = rows.mapInArrow(_chunks(buckets, frequent, spread), _ROWS_DDL)
    return stored(sent.groupBy("bucket").applyInArrow(by_group(_gather(groups, frequent), _ROWS), _ROWS_DDL), "pitman-yor")


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, draw) -> np.ndarray:
    """Tables that each token's customers open; ``weight``: strength and discounted tables times the parent's probability."""
    tables = np.minimum(customers, 1)
    at = np.flatnonzero(customers > 1)
    seated, t = np.ones(len(at), np.int64), np.ones(len(at), np.int64)
    while len(at):
        block = np.minimum(np.maximum(1, seated // 8), customers[at] - seated)
        w = weight[at]
        t += draw.binomial(block, w / (w + np.maximum(seated - discount * t, 1e-9)))
        seated += block
        done = seated >= customers[at]
        tables[at[done]] = t[done]
        at, seated, t = at[~done], seated[~done], t[~done]
    return tables


def _share(singles: int, doubles: int) -> float:
    """A discount from the numbers of tokens with one and with two customers."""
    return min(0.95, max(0.05, singles / (singles + 2 * doubles))) if singles else 0.5


def _seatings(model: dict, bucket: int, each, context, customers, spread=None):
    """(tables of each (token, context), customers and tables of each token at the root) of every sweep so far, then the next.

    ``spread``: places of the tokens that have customers in other blocks too; the model's ``spread`` has
    all their customers and tables at the root after each sweep. Those yielded are the block's.
    """
    token = np.repeat(np.arange(len(each)), each)
    uniform = 1 / (model["vocabulary"] + 1)
    tables = np.minimum(customers, 1)
    root = np.bincount(token, weights=tables, minlength=len(each)).astype(np.int64)
    root_tables = np.minimum(root, 1)
    yield token, tables, root, root_tables
    for sweep, (restaurant, top, top_tables) in enumerate(model["states"]):
        draw = np.random.default_rng([model["seed"], bucket, sweep])
        if spread is not None:
            root[spread], root_tables[spread] = model["spread"][sweep]
        p = _root(model, root, root_tables, top, top_tables, uniform)
        tables = seat(customers, (model["strength"] + model["discount"] * restaurant[context]) * p[token], model["discount"], draw)
        root = np.bincount(token, weights=tables, minlength=len(each)).astype(np.int64)
        root_tables = _root_seats(model, root, top_tables, draw)
        yield token, tables, root, root_tables


def _root_seats(model, root, top_tables, draw):
    """Tables at the root."""
    room = (model["strength"] + model["root_discount"] * top_tables) / (model["vocabulary"] + 1)
    return seat(root, np.full(len(root), room), model["root_discount"], draw)


def _root(model, root, root_tables, top, top_tables, uniform):
    """The unigram restaurant's predictive probability of each token."""
    d, s = model["root_discount"], model["strength"]
    return (np.maximum(root - d * root_tables, 0) + (s + d * top_tables) * uniform) / (s + top)


#: Between blocks and groups of contexts. A block's: tables, in the first sweep customers and hashes,
#: of the group's contexts. A group's: to each block, tables and customers of the restaurants; bucket -1, what
#: it must know: blocks, contexts of each, these contexts. Group -1: spread tokens' numbers,
#: customers at the root, customers; counts.
_TOLD = pa.schema([("group", pa.int32()), ("bucket", pa.int32()), ("sweep", pa.int32()), *[(x, pa.binary()) for x in "abcd"]])
_TOLD_DDL = "group int, bucket int, sweep int, a binary, b binary, c binary, d binary"


def _with_answers(table: DataFrame, columns: str, told: list[DataFrame]) -> DataFrame:
    """The blocks' rows (sweep -1) and all answers to them."""
    blocks = table.filter("kind = 2").select("bucket", F.lit(-1).alias("group"), F.lit(-1).alias("sweep"), *columns)
    answers = [t.filter("bucket >= 0").select("bucket", "group", "sweep", "a", "b") for t in told]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [blocks, *answers])


def _local(model: dict, batches):
    """A block's row, its places of spread tokens, its contexts' customers, and the model with its restaurants' tables."""
    rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["sweep"], r["group"]))
    parts = [[r for r in rows[1:] if r["sweep"] == i] for i in range(len(model["states"]))]
    states = [(np.concatenate([unpacked(r["a"], np.int64) for r in p]), *state[2:]) for p, state in zip(parts, model["states"], strict=True)]
    total = np.concatenate([unpacked(r["b"], np.int64) for r in parts[0]]) if parts else None
    number = unpacked(rows[0]["e"], np.int64)
    return rows[0], unpacked(rows[0]["d"], np.int64), total, {**model, "states": states, "spread": [(s[0][number], s[1][number]) for s in model["states"]]}


def _pairs(r: dict):
    """A block's pairs of each token, their contexts and customers."""
    return unpacked(r["a"], np.uint32), np.cumsum(unpacked(r["b"], np.uint32), dtype=np.uint32), unpacked(r["c"], np.int64)


def _totals(shared):
    """A block's tables after the next sweep, to the groups of its contexts, and its counts."""

    def task(key, batches):
        r, at, _, model = _local(shared.value, batches)
        each, context, customers = _pairs(r)
        for token, tables, root, root_tables in _seatings(model, r["bucket"], each, context, customers, at):  # noqa: B007
            pass
        sweep, cuts = len(model["states"]), unpacked(r["f"], np.int64)
        hashes = None if sweep else unpacked(r["g"], np.uint64)
        sums = [np.bincount(context, weights=w, minlength=cuts[-1]).astype(np.int64) for w in (tables, customers)]
        out = []
        for g in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[g], cuts[g + 1])
            out.append((int(g), r["bucket"], sweep, packed(sums[0][s]), b"" if sweep else packed(sums[1][s]), b"" if sweep else packed(hashes[s]), b""))
        parts = root[at], np.bincount(token, weights=customers, minlength=len(each)).astype(np.int64)[at]
        alone = np.ones(len(each), bool)
        alone[at] = False
        root, root_tables = root[alone], root_tables[alone]
        counts = np.array([customers.sum(), (root > 0).sum(), root.sum(), root_tables.sum(), (customers == 1).sum(), (customers == 2).sum(), (root == 1).sum(), (root == 2).sum()], np.int64)
        out.append((-1, r["bucket"], sweep, r["e"], packed(parts[0]), packed(parts[1]), packed(counts)))
        yield batch_of(_TOLD, zip(*out, strict=True))

    return task


def _add(spread: int):
    """A group's totals, answered to every block that has the contexts; group -1: one row for the driver."""

    def task(key, batches):
        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["bucket"])
        if key[0] < 0:
            sums, counts = np.zeros((2, spread), np.int64), np.zeros(8, np.int64)
            for r in rows:
                number = unpacked(r["a"], np.int64)
                sums[0, number] += unpacked(r["b"], np.int64)
                sums[1, number] += unpacked(r["c"], np.int64)
                counts += unpacked(r["d"], np.int64)
            yield batch_of(_TOLD, [[x] for x in (-1, -1, rows[0]["sweep"], packed(sums), packed(counts), b"", b"")])
            return
        known = rows.pop(0) if rows[0]["bucket"] < 0 else None
        sweep, tables = rows[0]["sweep"], [unpacked(r["a"], np.int64) for r in rows]
        cut = np.cumsum([0, *map(len, tables)])
        out = []
        if known:
            steps = unpacked(known["c"], np.int64)
            of = np.concatenate([np.cumsum(steps[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)])
        else:
            _, of = np.unique(np.concatenate([unpacked(r["c"], np.uint64) for r in rows]), return_inverse=True)
            steps = np.diff(of, prepend=0)
            steps[cut[:-1]] = of[cut[:-1]]
            out.append((key[0], -1, sweep, b"", b"", packed(steps.astype(np.int64)), b""))
        sums = np.bincount(of, weights=np.concatenate(tables)).astype(np.int64)
        total = None if known else np.bincount(of, weights=np.concatenate([unpacked(r["b"], np.int64) for r in rows])).astype(np.int64)
        for r, a, b in zip(rows, cut[:-1], cut[1:], strict=True):
            out.append((key[0], r["bucket"], sweep, packed(sums[of[a:b]]), b"" if known else packed(total[of[a:b]]), b"", b""))
        yield batch_of(_TOLD, zip(*out, strict=True))

    return task


def _sweep(table: DataFrame, told: list[DataFrame], model: dict, spread: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The next sweep's answers; customers of the spread tokens at the root and in all; counts without them."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    rows = _with_answers(table, "abcdef" if told else "abcdefg", told)
    parts = rows.groupBy("bucket").applyInArrow(by_group(_totals(shared), _TOLD), _TOLD_DDL)
    if told:
        parts = parts.unionByName(told[0].filter("bucket < 0 and group >= 0"))
    out = stored(parts.groupBy("group").applyInArrow(by_group(_add(spread), _TOLD), _TOLD_DDL), "pitman-yor-totals")
    for r in out.filter("group < 0").collect():
        return out, unpacked(r["a"], np.int64).reshape(2, -1), unpacked(r["b"], np.int64)
    return out, np.zeros((2, spread), np.int64), np.zeros(8, np.int64)


def _score(shared, keep: int):
    """Scores of the pairs that chunks sent, and customers of their tokens."""

    def task(key, batches):
        r, at, total, model = _local(shared.value, batches)
        each, context, customers = _pairs(r)
        uniform = 1 / (model["vocabulary"] + 1)
        p, used = np.zeros(len(context)), 0
        for sweep, (token, tables, root, root_tables) in enumerate(_seatings({**model, "states": model["states"][:-1]}, r["bucket"], each, context, customers, at)):
            if sweep < len(model["states"]) - keep:
                continue
            restaurant, top, top_tables = model["states"][sweep]
            # the generator replaces these two itself when it goes on
            root[at], root_tables[at] = model["spread"][sweep]
            parent = _root(model, root, root_tables, top, top_tables, uniform)[token]
            own = np.maximum(customers - model["discount"] * tables, 0)
            p += (own + (model["strength"] + model["discount"] * restaurant[context]) * parent) / (model["strength"] + total[context])
            used += 1
        score = np.log10(p / used).astype(np.float32)
        count = np.bincount(token, weights=customers, minlength=len(each)).astype(np.int64)
        count[at] = model["frequent"][unpacked(r["e"], np.int64)]
        (chunks, entries), steps = unpacked(r["h"], np.int64).reshape(2, -1), unpacked(r["i"], np.uint32)
        end = np.cumsum(entries)
        for chunk, a, b in zip(chunks.tolist(), (end - entries).tolist(), end.tolist(), strict=True):
            pair = np.cumsum(steps[a:b], dtype=np.int64)
            yield batch_of(_ROWS, [[x] for x in _row(r["bucket"], chunk, 1, packed(score[pair]), packed(count[token[pair][runs(token[pair])[:-1]]]))])

    return task


_SCORES = pa.schema([("id", pa.int64()), ("learned", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _join(tokens: int, vocabulary: int):
    """A chunk's texts with the scores of the pairs it sent."""

    def task(key, batches):
        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["kind"], r["bucket"]))
        ids, sizes, learns = unpacked(rows[0]["a"], np.int64), unpacked(rows[0]["b"], np.int64), unpacked(rows[0]["c"], np.uint8)
        ids = pa.array(ids, mask=unpacked(rows[0]["d"], np.uint8) == 0)
        score = np.concatenate([unpacked(r["a"], np.float32) for r in rows[1:]]).astype(np.float64)
        count = np.repeat(np.concatenate([unpacked(r["b"], np.int64) for r in rows[1:]]), unpacked(rows[0]["e"], np.uint32))
        base = np.log10((count + 1) / (tokens + vocabulary + 1))
        pair = np.cumsum(unpacked(rows[0]["f"], np.uint32), dtype=np.int64)
        text, times = unpacked(rows[0]["g"], np.uint16), unpacked(rows[0]["h"], np.uint32)
        known, base, score = (np.bincount(text, weights=times * v[pair], minlength=len(sizes)) for v in (count > 0, base, score))
        yield batch_of(_SCORES, [ids, learns.astype(bool), sizes, known.astype(np.int64), base, score])

    return task


def score_texts(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", sweeps: int = 3, keep: int = 2, strength: float = 1.0, seed: int = 11) -> DataFrame:
    """(``id_col``, learned, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    ``base_score`` is the add-one unigram model's log10 probability. ``keep`` of the ``sweeps``
    are averaged.
    """
    if not 1 <= keep <= sweeps + 1:
        raise ValueError("keep must lie between 1 and sweeps + 1")
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).cast("binary").alias("text"))
    texts, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0]
    buckets = max(48, math.ceil((size + texts) / BLOCK_BYTES))
    frequent, spread = _frequent(rows, texts, buckets)
    table = _blocks(rows, buckets, max(16, buckets // 8), frequent, spread)
    model = {"strength": strength, "seed": seed, "states": [], "vocabulary": 0, "discount": 0.5, "root_discount": 0.5}
    told: list[DataFrame] = []
    for sweep in range(sweeps + 1):
        answers, (root, customers), n = _sweep(table, told, model, len(frequent))
        told.append(answers)
        if not sweep:
            model |= {"frequent": customers, "tokens": int(n[0]), "vocabulary": int(n[1] + (root > 0).sum())}
            model |= {"discount": _share(n[4], n[5]), "root_discount": _share(n[6] + (root == 1).sum(), n[7] + (root == 2).sum())}
            tables = np.minimum(root, 1)
        else:
            tables = _root_seats(model, root, model["states"][-1][3], np.random.default_rng([seed, buckets, sweep]))
        model["states"] = [*model["states"], (root, tables, int(n[2] + root.sum()), int(n[3] + tables.sum()))]
    shared = spark.sparkContext.broadcast(model)
    sums = _with_answers(table, "abcdehi", told).groupBy("bucket").applyInArrow(by_group(_score(shared, keep), _ROWS), _ROWS_DDL)
    sums = sums.unionByName(table.filter("kind = 0"))
    out = sums.groupBy("chunk").applyInArrow(by_group(_join(model["tokens"], model["vocabulary"]), _SCORES), "id long, learned boolean, n_tokens long, n_known long, base_score double, score double")
    out = out.withColumn("train_tokens", F.lit(model["tokens"]).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    return out.select(F.col("id").alias(id_col), "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
