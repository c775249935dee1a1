"""Registered queries: each runs a library operator over the given tables.

``query(name, sql)`` registers a callable and, where SQL can express the same
result, the DuckDB statement that must return the same rows.
"""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c) -> Column:
    """Round a double for comparison; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def r9(c) -> Column:
    """Nine places, for averages of few decimals that would sit on a six-place half."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 9) + F.lit(0.0)


def rounded9(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r9(c) for c in cols})


def load_all():
    """Import every catalog module and return (queries, oracles)."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES, ORACLES
