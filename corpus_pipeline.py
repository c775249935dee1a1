"""A training-corpus pipeline: documents in, packed token sequences out.

Every stage takes all that its predecessor kept, written as Parquet and read again, and its
decisions take effect on the rows: unidentified texts and near copies go, repeated passages
are cut out of the texts, the mix repeats or drops texts, and what is left is packed.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import language, mixing, packing, simhash, substring_dedup
from sieveline.runtime import scratch_path


def _with_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``documents`` with the length of the present text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or for which no language has a probability of 0.25 beside junk, go."""
    return language.keep_identified(docs, learn=~language.held_out("doc_id", 4, 2), least=0.25)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints stays, the one with the smallest id."""
    return simhash.drop_near_duplicates(docs, shingle=4, bits=4)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a repeated window of 35 words go; what is left is joined by one space."""
    out = substring_dedup.remove_repeats(docs, window=35)
    return _with_text(out.withColumn("text", F.col("kept_text")), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last one of a source may be cut short."""
    return _with_text(mixing.mixed_documents(docs, weights=(5, 2, 1), cap=3), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of at most 2048 ids and each one's place in a sequence."""
    return packing.pack(packing.token_pieces(docs, capacity=2048), ["doc_id", "piece", "ids_crc32"], capacity=2048)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL expresses neither the network nor the packing; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
