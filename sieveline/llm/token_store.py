"""Token ids in binary files of patched frame-of-reference blocks, written and read back.

The ids of all documents, each followed by an end id, form one stream in ascending document
id order. A file holds a stretch of it that starts and ends between documents, as blocks of
128 ids: a block subtracts its minimum, packs the low bits of what is left at one width and
lists the outliers' positions and high bits. The width is the bit length of one of the
``PERCENTILES`` of the block's values, the one that makes the block smallest. Documents'
lengths are blocks of the same kind; an index of block starts serves reads of any stretch
(:func:`token_slice`) without decoding the rest.

A file is: 10 numbers (``HEADER``, signed 64 bits, little endian), id blocks, length blocks,
document ids (64 bits each, then one byte each that is 1 for a missing id), starts of the id
blocks and of the length blocks (64 bits each), and a newline. A block is: minimum (32 bits),
width, number of outliers (8 bits each), two zero bytes, the packed words, the outliers'
positions (8 bits each) and their high bits (32 bits each).

Null and empty texts hold the end id alone. Missing ids come first. Rows that repeat an id
follow one another, ordered by their token ids within a writing task; equal rows stay
separate. A text of any length is whole in one file; files close beyond ``file_ids`` ids. An empty table gives no
file and reads as no rows. Other columns of the table are not stored.
"""

from __future__ import annotations

import bisect
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.arrays import batch_of, slices
from sieveline.llm.frames import kept, named, stored
from sieveline.llm.tokens import ByteBpe

BLOCK, LANES = 128, 4
#: Bytes of text behind one writing task.
PART_BYTES = 64 << 20
PERCENTILES = (50, 75, 90, 95, 98, 100)
HEADER = ("magic", "part", "number", "docs", "ids", "id_blocks", "length_blocks", "lengths_at", "docs_at", "index_at")
MAGIC = int.from_bytes(b"PFORTOK1", "little")
_STEPS = BLOCK // LANES


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) numbers below 2**width as (blocks, width * 4) words, four interleaved lanes."""
    n = len(values)
    v = values.reshape(n, _STEPS, LANES).transpose(1, 0, 2).copy()
    words = np.zeros((width, n, LANES), np.uint32)
    for i in range(_STEPS if width else 0):
        word, shift = divmod(i * width, 32)
        words[word] |= v[i] << np.uint32(shift)
        if shift + width > 32:
            words[word + 1] |= v[i] >> np.uint32(32 - shift)
    return words.transpose(1, 0, 2).reshape(n, width * LANES)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    words = words.reshape(n, width, LANES).transpose(1, 0, 2).copy()
    out = np.zeros((_STEPS, n, LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(_STEPS if width else 0):
        word, shift = divmod(i * width, 32)
        low = words[word] >> np.uint32(shift)
        if shift + width > 32:
            low |= words[word + 1] << np.uint32(32 - shift)
        out[i] = low & mask
    return out.transpose(1, 0, 2).reshape(n, BLOCK)


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def encode_blocks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, start of every block) of 32-bit ``values``; the last block is filled up with its last value."""
    n = -(-len(values) // BLOCK)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    full = np.concatenate([values, np.repeat(values[-1:], n * BLOCK - len(values))]).astype(np.uint32).reshape(n, BLOCK)
    low = full.min(1)
    delta = full - low[:, None]
    ranks = [max(0, math.ceil(BLOCK * p / 100) - 1) for p in PERCENTILES]
    widths = _bit_length(np.sort(delta, axis=1)[:, ranks])
    masks = ((1 << widths) - 1).astype(np.uint32)
    beyond = np.stack([np.count_nonzero(delta > masks[:, [j]], axis=1) for j in range(len(ranks))], 1)
    at = (widths * LANES * 4 + beyond * 5).argmin(1)
    width, outliers = widths[np.arange(n), at], beyond[np.arange(n), at]
    sizes = 8 + width * LANES * 4 + outliers * 5
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.zeros((n, 8), np.uint8)
    head[:, :4] = low.astype("<u4")[:, None].view(np.uint8)
    head[:, 4], head[:, 5] = width, outliers
    out[starts[:, None] + np.arange(8)] = head
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        words = _pack(delta[rows] & np.uint32((1 << w) - 1), w).astype("<u4").view(np.uint8)
        out[(starts[rows] + 8)[:, None] + np.arange(w * LANES * 4)] = words
    block, place = np.divmod(np.flatnonzero(delta > masks[np.arange(n), at][:, None]), BLOCK)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
    base = starts[block] + 8 + width[block] * LANES * 4
    out[base + rank] = place
    high = (delta[block, place] >> width[block].astype(np.uint32)).astype("<u4")
    out[(base + outliers[block] + 4 * rank)[:, None] + np.arange(4)] = high[:, None].view(np.uint8).reshape(-1, 4)
    return out, starts


def decode_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 128 values of each block of ``data`` that begins at one of ``starts``."""
    head = data[starts[:, None] + np.arange(8)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width, outliers = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    out = np.empty((len(starts), BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        packed = data[(starts[rows] + 8)[:, None] + np.arange(w * LANES * 4)]
        out[rows] = _unpack(np.ascontiguousarray(packed).view("<u4"), w)
    block = np.repeat(np.arange(len(starts)), outliers)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
    base = starts[block] + 8 + width[block] * LANES * 4
    high = np.ascontiguousarray(data[(base + outliers[block] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    out[block, data[base + rank]] |= high << width[block].astype(np.uint32)
    return (out + low[:, None]).reshape(-1)


def encode_file(part: int, number: int, doc_ids: list, ids: list[np.ndarray]) -> bytes:
    """One file's bytes, but for the newline, from documents' ids in stream order."""
    whole = np.concatenate(ids)
    body, starts = encode_blocks(whole)
    lengths, length_starts = encode_blocks(np.array([len(x) for x in ids], np.uint32))
    missing = np.array([d is None for d in doc_ids], np.uint8)
    named_ids = np.array([0 if d is None else d for d in doc_ids], "<i8").view(np.uint8)
    at = 8 * len(HEADER)
    lengths_at, docs_at = at + len(body), at + len(body) + len(lengths)
    index_at = docs_at + 9 * len(ids)
    head = np.array([MAGIC, part, number, len(ids), len(whole), len(starts), len(length_starts), lengths_at, docs_at, index_at], "<i8")
    index = np.concatenate([starts + at, length_starts + lengths_at]).astype("<i8")
    return b"".join(x.tobytes() for x in (head, body, lengths, named_ids, missing, index))


class TokenFile:
    """Reads one file's bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        if len(data) < 8 * len(HEADER):
            raise ValueError("too short for a token file")
        head = dict(zip(HEADER, np.frombuffer(data[: 8 * len(HEADER)].tobytes(), "<i8").tolist(), strict=True))
        if head["magic"] != MAGIC:
            raise ValueError("not a token file")
        self.__dict__.update(head)

    def _index(self, first: int, n: int) -> np.ndarray:
        at = self.index_at + 8 * first
        return np.frombuffer(self.data[at : at + 8 * n].tobytes(), "<i8")

    def tokens(self, first: int = 0, n: int | None = None) -> np.ndarray:
        """``n`` ids from the ``first`` on; only the blocks that hold them are decoded."""
        end = self.ids if n is None else min(self.ids, first + n)
        if end <= first:
            return np.zeros(0, np.uint32)
        low, high = first // BLOCK, -(-end // BLOCK)
        return decode_blocks(self.data, self._index(low, high - low))[first - low * BLOCK : end - low * BLOCK]

    def lengths(self) -> np.ndarray:
        return decode_blocks(self.data, self._index(self.id_blocks, self.length_blocks))[: self.docs].astype(np.int64)

    def doc_ids(self) -> pa.Array:
        at = self.docs_at
        values = np.frombuffer(self.data[at : at + 8 * self.docs].tobytes(), "<i8")
        return pa.array(values, pa.int64(), mask=self.data[at + 8 * self.docs : at + 9 * self.docs] != 0)


_ENCODED = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary())])


def _encode(vocabulary, ranks, end_id, bounds: list[int], before: int):
    """``bounds`` divides ids into parts; ``before`` parts hold the rows without an id."""

    def part(doc, turn):
        if doc is None:
            return turn % max(1, before)
        low, high = bisect.bisect_left(bounds, doc), bisect.bisect_right(bounds, doc)
        return before + low + turn % (high - low + 1)  # an id that is several bounds has that many parts

    def task(batches):
        bpe = ByteBpe(vocabulary, ranks)
        turn = 0
        for rows, _, _ in slices(batches, "text"):
            out = []
            for doc, text in zip(rows.column("id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                ids = np.append(bpe.encode(text or b""), np.uint32(end_id))
                wide = bool(ids.max() > 0xFFFF)
                out.append((part(doc, turn), doc, wide, ids.astype("<u4" if wide else "<u2").tobytes()))
                turn += 1
            if out:
                yield batch_of(_ENCODED, zip(*out, strict=True))

    return task


def _files(file_ids: int):
    schema = pa.schema([("value", pa.binary())])

    def task(batches):
        part, number = TaskContext.get().partitionId(), 0
        docs, ids, n = [], [], 0
        for batch in batches:
            columns = zip(batch.column("id").to_pylist(), batch.column("wide").to_pylist(), batch.column("ids"), strict=True)
            for doc, wide, raw in columns:
                one = np.frombuffer(raw.as_buffer(), "<u4" if wide else "<u2").astype(np.uint32)
                if n and n + len(one) > file_ids:
                    yield batch_of(schema, [[encode_file(part, number, docs, ids)]])
                    docs, ids, n, number = [], [], 0, number + 1
                docs.append(doc)
                ids.append(one)
                n += len(one)
        if docs:
            yield batch_of(schema, [[encode_file(part, number, docs, ids)]])

    return task


def write_token_store(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, file_ids: int = 4 << 20, vocabulary: str | None = None, ranks: str | None = None) -> None:
    """Write ``df``'s texts as token files under ``path``, in ascending ``id_col`` order.

    Each text is encoded once, where it is read; its ids, not its bytes, are dealt into ranges
    of document ids. The ranges' bounds are approximate quantiles; an id that fills several
    ranges is dealt over them in turn.
    """
    rows = df.select(named(id_col).cast("long").alias("id"), named(text_col).cast("binary").alias("text"))
    texts, missing, size = rows.agg(F.count("*"), F.count_if(F.col("id").isNull()), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0]
    width = max(1, min(texts, df.sparkSession.sparkContext.defaultParallelism), -(-size // PART_BYTES))
    before = -(-width * missing // max(1, texts))
    width = max(1, width - before)
    bounds = []
    if texts > missing and width > 1:
        shares = [i / width for i in range(1, width)]
        bounds = rows.agg(F.percentile_approx("id", shares, max(10_000, 20 * width))).collect()[0][0]
    encoded = rows.mapInArrow(_encode(vocabulary, ranks, end_id, bounds, before), "part int, id long, wide boolean, ids binary")
    ordered = encoded.repartitionById(width + before, "part").sortWithinPartitions(F.col("id").asc_nulls_first(), "ids")
    files = ordered.select("id", "wide", "ids").mapInArrow(_files(file_ids), "value binary")
    # the text writer puts bytes down as they are and ends each record, here each file, with a newline
    files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


_DOCS = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _documents(keep_ids: bool):
    schema = pa.schema([*_DOCS, pa.field("ids", pa.list_(pa.int32()))]) if keep_ids else _DOCS

    def task(batches):
        for batch in batches:
            for content in batch.column("content"):
                data = np.frombuffer(content.as_buffer(), np.uint8)
                if not len(data):
                    continue  # a writer without rows leaves an empty file
                file = TokenFile(data)
                ids, lengths = file.tokens().astype("<u4"), file.lengths()
                ends = np.cumsum(lengths)
                raw, cuts = memoryview(ids.tobytes()), (4 * np.concatenate([[0], ends])).tolist()
                checks = [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                same = np.ones(file.docs, np.int64)
                columns = [pa.array(same * file.part), pa.array(same * file.number), file.doc_ids(), pa.array(ends - lengths), pa.array(lengths), pa.array(checks, pa.int64())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return task


_SPANS = pa.schema([("path", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("ids", pa.int64())])


def _headers(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = np.frombuffer(content.as_buffer(), np.uint8)
            if len(data):
                file = TokenFile(data)
                yield batch_of(_SPANS, [[path], [file.part], [file.number], [file.ids]])


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _with_starts(spans: DataFrame) -> DataFrame:
    """(part, number, ids) of files and the ids before each: inside its part, then the parts' totals."""
    spark = spans.sparkSession
    table, before = [], 0
    for r in spans.groupBy("part").agg(F.sum("ids").alias("n")).orderBy("part").collect():  # one row a writing task
        table.append((r["part"], before))
        before += r["n"]
    parts = F.broadcast(spark.createDataFrame(table, "part long, before long"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    local = spans.withColumn("local", F.coalesce(F.sum("ids").over(inside), F.lit(0)))
    return local.join(parts, "part").withColumn("file_start", F.col("before") + F.col("local")).drop("before", "local")


def read_token_store(spark: SparkSession, path: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(``id_col``, start, n_tokens, ids_crc32[, ids]) of every document, read from the files under ``path``."""
    ddl = "part long, number long, id long, inside long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    docs = _contents(spark, path).select("content").mapInArrow(_documents(keep_ids), ddl)
    docs = stored(docs, "documents") if keep_ids else kept(docs)
    files = _with_starts(docs.groupBy("part", "number").agg(F.sum("n_tokens").alias("ids"))).select("part", "number", "file_start")
    out = docs.join(files, ["part", "number"])
    return out.select(F.col("id").alias(id_col), (F.col("file_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def token_slice(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """(start, ids): the stream's ``n`` ids from ``start`` on, a row for each file that holds some.

    Headers say which files hold the stretch; of those, only its blocks are decoded. The
    driver gets one row for each such file.
    """
    spans = kept(_contents(spark, path).mapInArrow(_headers, "path string, part long, number long, ids long"))
    wanted = _with_starts(spans).filter((F.col("file_start") < start + n) & (F.col("file_start") + F.col("ids") > start))
    places = {r["path"]: r["file_start"] for r in wanted.collect()}
    schema = pa.schema([("start", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def cut(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                first = max(0, start - places[name])
                ids = TokenFile(np.frombuffer(content.as_buffer(), np.uint8)).tokens(first, start + n - places[name] - first)
                yield batch_of(schema, [[places[name] + first], [ids.astype(np.int64)]])

    if not places:
        return spark.createDataFrame([], "start long, ids array<long>")
    files = spark.read.format("binaryFile").load(list(places)).select("path", "content")
    return files.mapInArrow(cut, "start long, ids array<long>")
