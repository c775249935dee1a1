"""Result tables: partitioned writes, append-distinct, upsert, rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.runtime import scratch_path

SCORE_KEYS = ["datapred", "llm_model", "decoding", "variant"]
MASK_KEYS = ["method", "datapred", "ratio", "seed"]


def write_scores(df: DataFrame, path: str) -> None:
    df.repartition(*SCORE_KEYS).write.mode("overwrite").partitionBy(*SCORE_KEYS).parquet(path)


def write_masks(df: DataFrame, path: str) -> None:
    df.repartition(*MASK_KEYS).write.mode("overwrite").partitionBy(*MASK_KEYS).parquet(path)


def append_distinct(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows without full-row duplicates."""
    return old.unionByName(new).distinct()


def upsert(batches: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of batches where the last batch wins per key (one map-side reduced aggregate)."""
    tagged = None
    for i, b in enumerate(batches):
        part = b.withColumn("_batch", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    rest = [c for c in batches[0].columns if c not in keys]
    return (
        tagged.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "_batch").alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def rewrite(df: DataFrame, name: str, order: list[str] | None = None) -> str:
    """Write to a fresh path (never over an input that is still being read); returns it."""
    path = scratch_path(df.sparkSession, name)
    (df.orderBy(*order) if order else df).write.parquet(path)
    return path


def rejects(parsed: DataFrame, score: str = "score") -> DataFrame:
    """Completions without a usable score, with their raw text."""
    return parsed.filter(F.col(score).isNull())
