"""Scans: CSV, ARFF, survey microdata, clinical bundles, prompt texts, saved results.

All readers take an explicit schema or derive it from a header; none infers it
from the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.runtime import small_rows


def read_csv(spark: SparkSession, paths, schema, sep: str = ",") -> DataFrame:
    """CSV with a header line; several paths are stacked."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(paths)


_ATTRIBUTE = re.compile(r"""^\s*@attribute\s+('(?:[^'\\]|\\.)*'|"[^"]*"|\S+)\s+(.+?)\s*$""", re.IGNORECASE)


def arff_schema(header_lines: list[str]) -> T.StructType:
    """Attributes of an ARFF header: numbers become DOUBLE, everything else STRING."""
    fields = []
    for line in header_lines:
        m = _ATTRIBUTE.match(line)
        if m:
            kind = m.group(2).split("%")[0].strip().lower()
            numeric = kind in ("real", "numeric", "integer")
            fields.append(T.StructField(m.group(1).strip("'\""), T.DoubleType() if numeric else T.StringType()))
    return T.StructType(fields)


def read_arff(spark: SparkSession, path) -> DataFrame:
    """ARFF scan: the header lines give the schema, the rest is read as CSV lines.

    Only the ``@`` lines reach the driver.  ``?`` is a missing value and nominal
    values may be quoted with single quotes.
    """
    lines = spark.read.text(path)
    header = lines.filter(F.col("value").rlike(r"^\s*@"))
    schema = arff_schema([r["value"] for r in small_rows(header, 20_000)])
    body = lines.filter(~F.col("value").rlike(r"^\s*(@|%|$)"))
    options = {"quote": "'", "nullValue": "?", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return body.select(F.from_csv("value", ddl, options).alias("r")).select("r.*")


def read_survey(spark: SparkSession, path: str, states: list[str], year: int, horizon: str) -> DataFrame:
    """Survey microdata partitioned by (year, horizon, state): only the asked partitions are listed."""
    return spark.read.parquet(path).filter(
        F.col("state").isin(states) & (F.col("year") == year) & (F.col("horizon") == horizon)
    )


def read_series_bundle(spark: SparkSession, path: str, hours: int, bin_hours: int) -> DataFrame:
    """Cached time series (entity, concept, bin, value, mask, delta) of one (L, bin_size)."""
    return spark.read.parquet(path).filter((F.col("L") == hours) & (F.col("bin_size") == bin_hours))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Prompt texts laid out as ``<dataset>/<pred>_<kind>.txt``: (datapred, kind, text)."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.col("_metadata.file_path")
    kind = F.regexp_extract(name, r"_((?:template_rank|template_seq|template|context|examples))\.txt$", 1)
    stem = F.regexp_extract(name, r"([^/]+/[^/]+?)_(?:template_rank|template_seq|template|context|examples)\.txt$", 1)
    return files.select(F.url_decode(stem).alias("datapred"), kind.alias("kind"), F.col("value").alias("text"))


def read_scores(spark, path: str, datapred: str, llm_model: str, decoding: str, variant: str) -> DataFrame:
    """Saved scores of one variant; the keys are partition columns."""
    return spark.read.parquet(path).filter(
        (F.col("datapred") == datapred) & (F.col("llm_model") == llm_model)
        & (F.col("decoding") == decoding) & (F.col("variant") == variant)
    )


def read_mask(spark, path: str, datapred: str, method: str, ratio: float, seed: int) -> DataFrame:
    return spark.read.parquet(path).filter(
        (F.col("datapred") == datapred) & (F.col("method") == method)
        & (F.col("ratio") == ratio) & (F.col("seed") == seed)
    ).select("feature")


def read_if_exists(spark: SparkSession, path: str, schema) -> DataFrame:
    """An earlier result, or an empty table of the schema when there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def first_by_key(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value of the first row per key (in ``order``), map-side reduced."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def union_lists(*lists: DataFrame) -> DataFrame:
    """Concatenate (concept, pos, kind) lists; each list keeps its order after the previous ones."""
    out, offset = None, 0
    for part in lists:
        shifted = part.withColumn("pos", (F.col("pos") + offset).cast("int"))
        offset += part.count()
        out = shifted if out is None else out.unionByName(shifted)
    return out
