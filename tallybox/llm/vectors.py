"""What the operators on vectors share: which rows they take, and their components as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components whose integer doesn't fit a long have none; the bound is exact in double precision.
LARGEST = 2.0**62


def _finite(v: Column, scale: int) -> Column:
    """No null, infinite or NaN component, and every component times the scale fits a long."""
    return F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) * scale < LARGEST, F.lit(False)))


def usable(df: DataFrame, vector_col: str, scale: int, multiple: int = 1) -> tuple[DataFrame, int]:
    """The rows of ``df`` whose vector can be taken, and the number of its components (0: there is none).

    Null vectors, vectors with a null, NaN or infinite component and such whose integers
    would not fit a long are dropped. All vectors must have one length for sums to make
    sense: the commonest that ``multiple`` divides, of equals the greater; others are dropped.
    """
    v = F.col(vector_col)
    kept = df.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % multiple == 0) & _finite(v, scale))
    most = kept.groupBy(F.size(v).alias("size_")).agg(F.count("*").alias("n_")).orderBy(F.desc("n_"), F.desc("size_")).first()
    dims = most["size_"] if most else 0
    return kept.where(F.size(v) == dims), dims


def floors(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """(rows, dims) longs floor(scale * c) of a column of usable vectors; multiplying by a power of two is exact."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, dims)
