"""Principal coordinates of a table of distances, by block power iteration on its rows.

The squared distances stay an edge list (a, b, value). A step multiplies the doubly centred
matrix with a block of a few columns: a join on b and a sum by a; the centring needs the row
means and the block's sums only, since the block's columns add up to zero. What comes to the
driver are sums of products of the block's columns, which orthonormalise it and give the
eigenvalues within the block (Rayleigh and Ritz).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybox.operators.work import written


def _times(block: DataFrame, m: np.ndarray) -> DataFrame:
    """Every row's columns v times a small matrix."""
    sums = [sum((F.col("v")[i] * float(m[i, j]) for i in range(m.shape[0])), F.lit(0.0)) for j in range(m.shape[1])]
    return block.select("node", F.array(*sums).alias("v"))


def _products(rows: DataFrame, left: str, n: int, right: str, k: int) -> np.ndarray:
    got = rows.agg(*(F.sum(F.col(left)[i] * F.col(right)[j]) for i in range(n) for j in range(k))).first()
    return np.array([x or 0.0 for x in got], float).reshape(n, k)


def broken_stick(parts: int) -> list[float]:
    """The mean lengths of the pieces of a stick of length 1 broken at random, longest first."""
    return [sum(1 / j for j in range(i, parts + 1)) / parts for i in range(1, parts + 1)]


def principal_coordinates(distances: DataFrame, k: int = 8, tolerance: float = 1e-9, rounds: int = 300) -> tuple[DataFrame, list[dict]]:
    """((node, axis, coordinate), values): coordinates on the axes of positive eigenvalue, and for each axis
    eigenvalue, relative_eig (over the sum of all), stick (broken over n - 1 axes) and kept.

    distances: (a, b, d) of every ordered pair; pairs of a node with itself count as 0 and may be
    absent. The axes are those of the k eigenvalues of greatest size, in falling order. kept: no
    more axes than the first whose share reaches its piece of the stick. An axis points to
    where its coordinate of greatest size is positive. Fewer than two nodes have no axes.
    """
    edges = written(distances.where("a <> b").select("a", "b", (F.col("d").cast("double") * F.col("d")).alias("w")), "distances")
    sums = edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("s"))
    n, total = sums.agg(F.count("*"), F.sum("s")).first()
    spark = distances.sparkSession
    if n < 2 or not total:
        return spark.createDataFrame([], distances.select(F.col("a").alias("node"), F.lit(1).alias("axis"), F.lit(0.0).alias("coordinate")).schema), []
    mean = written(sums.select("node", (F.col("s") / n).alias("r")), "row-means")
    trace = total / n / 2  # of the centred matrix: its diagonal is the row means less half the mean of all
    start = [F.pmod(F.xxhash64("node", F.lit(j)), F.lit(1 << 30)).cast("double") / float(1 << 29) - 1 for j in range(min(k, n - 1))]
    block = mean.select("node", F.array(*start).alias("v"))

    def upright(block: DataFrame, columns: int) -> tuple[DataFrame, int]:
        """Columns that add up to zero and are orthonormal; those that depend on others go."""
        middle = block.agg(*(F.avg(F.col("v")[j]) for j in range(columns))).first()
        flat = block.select("node", F.array(*(F.col("v")[j] - m for j, m in enumerate(middle))).alias("v"))
        e, u = np.linalg.eigh(_products(flat, "v", columns, "v", columns))
        good = e > 1e-14 * e.max()
        return written(_times(flat, u[:, good] / np.sqrt(e[good])), "block"), int(good.sum())

    block, columns = upright(written(block, "block"), len(start))
    before = None
    for _ in range(rounds):
        b = block.withColumnRenamed("node", "b")
        part = edges.join(b, "b").groupBy("a").agg(*(F.sum(F.col("w") * F.col("v")[j]).alias(f"y{j}") for j in range(columns)))
        lifted = mean.join(block, "node").agg(*(F.sum(F.col("r") * F.col("v")[j]) for j in range(columns))).first()
        y: list[Column] = [-0.5 * (F.col(f"y{j}") - lifted[j]) for j in range(columns)]
        both = written(part.withColumnRenamed("a", "node").join(block, "node").select("node", F.col("v").alias("own"), F.array(*y).alias("v")), "block")
        h = _products(both, "own", columns, "v", columns)
        e, u = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-e, kind="stable")
        e, u = e[order], u[:, order]
        left = _products(both, "v", columns, "v", columns)
        # what the block's image has outside the block: zero once its columns span eigenvectors
        rest = np.sqrt(max(0.0, np.trace(left) - np.trace(h.T @ h)) / max(np.trace(left), 1e-300))
        if rest < tolerance or before is not None and np.abs(e - before).max() <= tolerance * np.abs(e).max() and rest < 1e-7:
            break
        before = e
        block, columns = upright(both.select("node", "v"), columns)
        before = before if len(before) == columns else None
    else:
        raise RuntimeError(f"the axes did not settle in {rounds} rounds")
    good = e > 1e-10 * np.abs(e).max()
    turned = written(_times(both.select("node", F.col("own").alias("v")), u[:, good] * np.sqrt(e[good])), "coordinates")
    ends = turned.agg(*(F.struct(F.max(F.col("v")[j]), F.min(F.col("v")[j])) for j in range(int(good.sum())))).first()
    signs = np.diag([1.0 if high >= -low else -1.0 for high, low in ends])
    stick = broken_stick(n - 1)
    values = [{"axis": j + 1, "eigenvalue": float(x), "relative_eig": float(x / trace), "stick": stick[j]} for j, x in enumerate(e[good])]
    first = next((v["axis"] for v in values if v["relative_eig"] >= v["stick"]), len(values))
    for v in values:
        v["kept"] = v["axis"] <= first
    return _times(turned, signs).select("node", F.posexplode("v").alias("axis", "coordinate")).withColumn("axis", F.col("axis") + 1), values
