"""Session-level helpers: shared scratch space, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table (in rows) that is ever pulled to the driver or broadcast.
SMALL_ROWS = 100_000


class TooManyRows(ValueError):
    """A table that must be model-sized turned out to grow with the data."""


class NoSharedFolder(RuntimeError):
    """A cluster session names no folder that all executors can reach."""


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session whose driver and executors are one process (``local[*]``: unit tests,
    a laptop) gets a local folder of its own, once per session. On a cluster a missing
    setting is an error, since executors could not read each other's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if context.master.split("[")[0] != "local":
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sieveline-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def small_rows(df: DataFrame, limit: int = SMALL_ROWS) -> list:
    """Rows of a table that must be small; raises instead of flooding the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooManyRows(f"expected at most {limit} rows")
    return rows


def local_table(spark: SparkSession, rows: list[tuple], columns: dict[str, pa.DataType]) -> DataFrame:
    """A few rows of the driver as a table that is part of the plan: to read it back starts no job."""
    values = zip(*rows, strict=True) if rows else [[]] * len(columns)
    return spark.createDataFrame(pa.table({c: pa.array(v, t) for (c, t), v in zip(columns.items(), values, strict=True)}))


def small_table(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame | None:
    """``df`` as a local table with a broadcast hint, or None when it has more than ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def broadcast_if_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Broadcast ``df`` when a check shows it has at most ``limit`` rows.

    Beyond the limit the DataFrame is returned without a hint, so the join
    becomes a shuffle join and stays exact.
    """
    local = small_table(df, limit)
    return df if local is None else local


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame) -> DataFrame:
    """Use every core when an input sits in far fewer files than there are cores.

    A large table has more files than this and is returned as it is, unshuffled.
    Call it on the narrow columns an operator needs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # only the length crosses to Python; listing the names of a large table would be slow
    files = len(df._jdf.inputFiles())
    return df.repartition(cores) if 0 < files * 4 <= cores else df


#: Rows that a task reads of a table that is read many times.
_TASK_ROWS = 1 << 15


def gathered(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` persisted, and the same rows in tasks of some thousands, one for each core at least.

    For tables that many short passes read: a shuffle leaves as many partitions as its width,
    however few rows there are.  Unpersist the first when done.
    """
    held = df.persist()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-held.count() // _TASK_ROWS))
    return held, held.coalesce(tasks)


def side_by_side(spark: SparkSession, work: Callable, items: Iterable) -> list:
    """``work`` of every item, in order, each in a thread of the driver that starts its own Spark jobs."""
    items = list(items)
    if len(items) < 2:
        return [work(x) for x in items]
    with ThreadPoolExecutor(len(items)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))
