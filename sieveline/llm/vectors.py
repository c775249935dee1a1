"""Vector columns: which rows take part, and their numbers as matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """True for vectors that are neither null nor hold null or non-finite components."""
    bad = F.exists(F.col(vec).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrices(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for every vector length of an Arrow list column."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    low, lengths = ends[:-1], np.diff(ends)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = []
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out.append((at, values[low[at][:, None] + np.arange(n)[None, :]]))
    return out
