"""Small DataFrame helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.runtime import cut_lineage, shared_dir


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder: later steps read that copy."""
    return cut_lineage(df)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`kept`, as Parquet: later steps read only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def row_key(id_col: str, text_col: str) -> Column:
    """One number for a row's id and text: rows that share it are copies and get the same result."""
    return F.xxhash64(named(id_col), named(text_col).cast("binary"), named(text_col).isNull())


def named(column: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def schema_of(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    """The fields ``columns`` of ``df``, then those that ``more`` declares."""
    return T.StructType([*(df.schema[c] for c in columns), *T.StructType.fromDDL(more).fields])


def with_results(df: DataFrame, row: str, names: list[str]) -> DataFrame:
    """The fields of struct column ``row`` but for those named like a result, then the results."""
    fields = [f for f in df.schema[row].dataType.names if f not in names]
    return df.select(*[F.col(row).getField(f).alias(f) for f in fields], *names)
