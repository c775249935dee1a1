"""Token counts of documents in flat token files, by a separator scan.

A flat file holds 16-bit token ids (little endian) and an end-of-document id after each
document; no index tells where documents start. Files are read in blocks, each block is
searched for the separator with one vectorised comparison, and a prefix scan over the blocks
(sum of tokens, sum of separators, latest separator) joins documents that cross blocks or
files. The scan runs over ranges of blocks: each range by itself, then the ranges' totals.

Files are one stream in the order of their paths. An empty document counts 0 tokens. Tokens
after the last separator are one more document. Empty files hold nothing. A file is read as
one binary row, so writers bound its bytes (:func:`write_token_files` does, but for a single
longer text). Rows without an id and repeated rows are counted each; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.arrays import batch_of, packed, slices, unpacked
from sieveline.llm.frames import kept, named
from sieveline.llm.tokens import ByteBpe

END_OF_TEXT = 50256
BLOCK_TOKENS = 1 << 20


def _encode(vocabulary, ranks, end_id, file_bytes):
    """Files' bytes but for the last end id; a text is whole in one file."""
    schema, mark = pa.schema([("ids", pa.binary())]), end_id.to_bytes(2, "little")

    def task(batches):
        bpe = ByteBpe(vocabulary, ranks, specials_as_text=True)
        held, size = [], 0
        for rows, _, _ in slices(batches, "text"):
            for text in rows.column("text").to_pylist():
                ids = bpe.encode(text or b"")
                if len(ids) and (ids.max() > 0xFFFF or (ids == end_id).any()):
                    raise ValueError("a text's ids must fit 16 bits and differ from the end-of-document id")
                if held and size + 2 * len(ids) > file_bytes:
                    yield batch_of(schema, [[mark.join(held)]])
                    held, size = [], 0
                held.append(ids.astype("<u2").tobytes())
                size += 2 * len(ids) + 2
        if held:
            yield batch_of(schema, [[mark.join(held)]])

    return task


def write_token_files(df: DataFrame, path: str, text_col: str = "text", end_id: int = END_OF_TEXT, vocabulary: str | None = None, ranks: str | None = None, file_bytes: int = 16 << 20) -> None:
    """Write ``df``'s texts as flat token files: each partition's rows in order, null as empty.

    A file holds at most ``file_bytes``, or one longer text. Spark's text writer puts the raw
    id bytes down, a record a file, with the end-of-document id as the line separator, so any
    file system that Spark writes will do.
    """
    texts = df.select(named(text_col).cast("binary").alias("text"))
    ids = texts.mapInArrow(_encode(vocabulary, ranks, end_id, file_bytes), "ids binary")
    mark = end_id.to_bytes(2, "little").decode("latin-1")
    writer = ids.select(F.col("ids").cast("string").alias("value")).write
    writer.option("encoding", "ISO-8859-1").option("lineSep", mark).option("maxRecordsPerFile", 1).text(path)


_BLOCKS = pa.schema([("path", pa.string()), ("block", pa.int32()), ("tokens", pa.int64()), ("ends", pa.int64()), ("last", pa.int64()), ("places", pa.binary())])
_BLOCKS_DDL = "path string, block int, tokens long, ends long, last long, places binary"


def _scan(end_id: int, block_tokens: int):
    def task(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer()
                if data.size % 2:
                    raise ValueError(f"{path} holds half a token")
                ids = np.frombuffer(data, "<u2")
                rows = []
                for number, at in enumerate(range(0, len(ids), block_tokens)):
                    part = ids[at : at + block_tokens]
                    places = np.flatnonzero(part == end_id)
                    rows.append((path, number, len(part), len(places), int(places[-1]) if len(places) else -1, packed(places.astype(np.uint32))))
                if rows:
                    yield batch_of(_BLOCKS, zip(*rows, strict=True))

    return task


_DOCS = pa.schema([("path", pa.string()), ("number", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _documents(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ends = unpacked(row["places"], np.uint32).astype(np.int64) + row["before"]
            starts = np.concatenate([[row["open"]], ends[:-1] + 1]) if len(ends) else ends
            yield batch_of(_DOCS, [[row["path"]] * len(ends), row["ends_before"] + np.arange(len(ends)), starts, ends - starts])


def document_tokens(spark: SparkSession, path: str, end_id: int = END_OF_TEXT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, number, start, n_tokens) of every document of the stream.

    ``number`` counts documents from 0, ``start`` is the document's first token in the stream,
    ``path`` the file in which it ends.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    blocks = files.mapInArrow(_scan(end_id, block_tokens), _BLOCKS_DDL)
    blocks = blocks.repartitionByRange("path", "block").withColumn("part", F.spark_partition_id())
    blocks = kept(blocks)
    inside = Window.partitionBy("part").orderBy("path", "block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("local", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    blocks = blocks.withColumn("local_ends", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    after = F.when(F.col("last") >= 0, F.col("local") + F.col("last") + 1)
    blocks = blocks.withColumn("local_open", F.max(after).over(before))
    totals = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.sum("ends").alias("ends"), F.max(after).alias("open")).orderBy("part").collect()
    table, tokens, ends, start = [], 0, 0, 0
    for r in totals:  # one row for each partition of the shuffle
        table.append((r["part"], tokens, ends, start))
        start = tokens + r["open"] if r["open"] is not None else start
        tokens, ends = tokens + r["tokens"], ends + r["ends"]
    offsets = spark.createDataFrame(table, "part int, part_tokens long, part_ends long, part_open long")
    placed = blocks.join(F.broadcast(offsets), "part").select(
        "path", "places",
        (F.col("part_tokens") + F.col("local")).alias("before"),
        (F.col("part_ends") + F.col("local_ends")).alias("ends_before"),
        F.coalesce(F.col("part_tokens") + F.col("local_open"), F.col("part_open")).alias("open"),
    )
    found = placed.mapInArrow(_documents, "path string, number long, start long, n_tokens long")
    if tokens == start:
        return found
    last = blocks.agg(F.max("path").alias("path")).select("path", F.lit(ends).cast("long").alias("number"), F.lit(start).cast("long").alias("start"), F.lit(tokens - start).cast("long").alias("n_tokens"))
    return found.unionByName(last)


def corpus_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(``id_col``, file, number, start, n_tokens): write ``df``'s texts as token files and count them there.

    ``df`` must be the same rows in the same partitions when read again, as a table is. Row k
    of a partition is the k-th document of that partition's files.
    """
    spark = df.sparkSession
    write_token_files(df, path, text_col, **options)
    found = document_tokens(spark, path)
    found = found.withColumn("part", F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("int"))
    first = found.groupBy("part").agg(F.min("number").alias("base"))
    found = found.join(first, "part").withColumn("row", F.col("number") - F.col("base"))
    place = F.monotonically_increasing_id()
    rows = df.select(named(id_col).alias("id"), place.alias("place"), F.lit(True).alias("given"))
    rows = rows.select("id", "given", F.shiftrightunsigned("place", 33).cast("int").alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("row"))
    out = rows.join(found, ["part", "row"], "full")
    whole = F.col("given").isNotNull() & F.col("n_tokens").isNotNull()
    n = F.when(whole, F.col("n_tokens")).otherwise(F.raise_error(F.lit("the token files and the rows differ")).cast("long"))
    return out.select(F.col("id").alias(id_col), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "number", "start", n.alias("n_tokens"))
