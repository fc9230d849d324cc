"""Whitening of embeddings by polarisation: covariances from variances of sums of dimensions.

Every component c becomes the integer x = floor(SCALE * c) + SHIFT. A first pass sums
the dimensions; the nearest integer to each mean is taken off, which leaves small exact
integers z. A second pass adds up z_i^2 for every dimension and (z_i + z_j)^2 for every
pair of dimensions, as integers. The sum of products is half the difference
(z_i + z_j)^2 - z_i^2 - z_j^2, exactly, and the known rest of each mean corrects it to the
exact centred sum, so that the covariance matrix is rounded once, when it is divided.
Its eigenvectors by falling eigenvalue are the components, each with its largest
entry (the first of equals) positive.

What comes to the driver is one number per dimension and pair of dimensions. A task adds
up in longs as long as they can't overflow and in Python's integers beyond, and hands on
one row per number, in two halves so that Spark's decimals hold any sum.

Rows: see ``vectors.usable`` for what is dropped. Repeated rows and ids each count. A
null id stays null. No usable row gives an empty table. Components without variance (of
constant or repeated vectors, or beyond the number of rows) can't be scaled to 1 and are
left out, so there may be fewer than asked for. Other columns are ignored. A deviation
beyond a long is null; ``distance`` (the deviation over n^2, as double) is always there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybox.llm.common import lean, written
from tallybox.llm.vectors import floors, usable

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows of a slice, so that a table of a slice's pairs stays in the cache.
SLICE = 1_000
#: Least share of the largest eigenvalue that counts as variance.
LEAST = 1e-12
LONG, HALF = 2**63 - 1, 2**64


def _totals(kept: DataFrame, partial: Callable[[pa.Array], np.ndarray]) -> list[int]:
    """Sums over all rows of what ``partial`` adds up over a batch: exact, a row of ``partial``'s result each in the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in it:
            for at in range(0, b.num_rows, SLICE):
                part = partial(b.column(0).slice(at, SLICE)).astype(object)
                total = part if total is None else total + part
        if total is not None:
            halves = [divmod(int(t), HALF) for t in total]
            exact = lambda k: pa.array([str(h[k]) for h in halves])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(halves)), pa.int32()), exact(0), exact(1)], ["k", "high", "low"])

    sums = kept.mapInArrow(lean(run), "k int, high string, low string")
    long = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    return [int(r["high"]) * HALF + int(r["low"]) for r in sums.groupBy("k").agg(long("high"), long("low")).orderBy("k").collect()]


def _squares(z: np.ndarray) -> np.ndarray:
    """Sums over rows of z_i^2, then of (z_i + z_j)^2 for i < j, in the order of the pairs."""
    if float(np.abs(z).max(initial=0)) ** 2 * 4 * len(z) >= LONG:
        z = z.astype(object)
    t = np.ascontiguousarray(z.T)
    pairs = [((t[i + 1 :] + t[i]) ** 2).sum(axis=1) for i in range(len(t) - 1)]
    return np.concatenate([(t**2).sum(axis=1), *pairs])


def covariance(n: int, squares: list[int], rest: list[int]) -> np.ndarray:
    """The covariance matrix from the sums of squares; rest: what the integers z of each dimension add up to."""
    d = len(rest)
    out = np.empty((d, d))
    own, pair = squares[:d], iter(squares[d:])
    for i in range(d):
        out[i, i] = (n * own[i] - rest[i] ** 2) / n**2
        for j in range(i + 1, d):
            product = (next(pair) - own[i] - own[j]) // 2
            out[i, j] = out[j, i] = (n * product - rest[i] * rest[j]) / n**2
    return out


def axes(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by fall, unit eigenvectors as columns, and shares of the trace, of at most so many components with variance."""
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:most]
    order = order[e[order] > LEAST * max(e.max(), 0.0)]
    u = u[:, order]
    u = u * np.where(np.take_along_axis(u, np.abs(u).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)
    return e[order], u, e[order] / max(np.trace(v), 1e-300)


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: id, component, n, deviation, whitened, explained, identity_error, distance.

    identity_error is measured on the written rows: their covariance, of centred values
    with the divisor n, less the identity, the largest absolute entry.
    """
    kind = df.schema[id_col].dataType.simpleString()
    kept, dims = usable(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v", SCALE)
    only = kept.select("v")
    count = lambda v: np.concatenate([[len(v)], floors(v, dims, SCALE).astype(object).sum(axis=0)])
    n, *total = (_totals(only, count) if dims else []) or [0]
    mean = [(2 * t + n) // (2 * n) for t in total]  # the nearest integer
    rest = [t - n * m for t, m in zip(total, mean, strict=True)]

    def centred(v: pa.Array) -> np.ndarray:
        """Integers less the mean's; longs unless they would not fit."""
        x, m = floors(v, dims, SCALE), np.array(mean, object)
        far = max([0, *map(abs, mean)]) >= 2**61 or int(np.abs(x).max(initial=0)) >= 2**61
        return x.astype(object) - m if far else x - m.astype(np.int64)

    cov = covariance(n, _totals(only, lambda v: _squares(centred(v))), rest) if n else np.zeros((1, 1))
    e, u, share = axes(cov, most)
    offset = np.array([r / n for r in rest])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            z = centred(b.column(1))
            w = (z.astype(float) - offset) @ u / np.sqrt(e)
            small = z.dtype != object and (float(np.abs(z).max(initial=0)) + 1) ** 2 * n * n * dims < LONG
            y = (z if small else z.astype(object)) * n - np.array(rest, np.int64 if small else object)
            far = (y**2).sum(axis=1)
            fits = far if small else [int(f) if f <= LONG else None for f in far]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(fits, pa.int64()), pa.array([int(f) / n**2 for f in far]), pa.FixedSizeListArray.from_arrays(w.ravel(), len(e)).cast(pa.list_(pa.float64()))],
                ["id", "deviation", "distance", "w"],
            )

    schema = f"id {kind}, deviation bigint, distance double, w array<double>"
    if not n or not len(e):
        rows, error = df.sparkSession.createDataFrame([], schema), 0.0
    else:
        rows = written(kept.mapInArrow(lean(run), schema), "whitened")
        middle = rows.agg(*(F.avg(F.col("w")[k]) for k in range(len(e)))).first()
        apart = [F.col("w")[k] - m for k, m in enumerate(middle)]
        got = rows.agg(*(F.avg(apart[i] * apart[j]) - float(i == j) for i in range(len(e)) for j in range(i, len(e)))).first()
        error = max(map(abs, got))
    each = F.posexplode("w").alias("component", "whitened")
    explained = F.element_at(F.array(*map(F.lit, map(float, share))) if len(share) else F.array(F.lit(0.0)), F.col("component") + 1)
    return rows.select("id", "deviation", "distance", each).select(
        F.col("id").alias(id_col), (F.col("component") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"), "distance"
    )
