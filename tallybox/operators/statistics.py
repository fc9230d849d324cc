"""Quantiles, outliers, intervals and smoothers over groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallybox.functions.normal import normal_cdf, normal_quantile
from tallybox.operators.ordered import scan
from tallybox.operators.quantiles import exact_quantiles, same


SUMMARY = {"lower": 0.025, "q1": 0.25, "median": 0.5, "q3": 0.75, "upper": 0.975}


def quantile_summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and the 2.5, 25, 50, 75 and 97.5 percentiles, interpolated linearly, of groups of any size."""
    means = df.groupBy(*(F.col(c).alias(f"m_{c}") for c in by)).agg(F.avg(value).alias("mean"))
    q = exact_quantiles(df, value, tuple(SUMMARY.values()), *by)
    return q.join(means, same(by, "m_")).select(*by, "mean", *(F.col("q")[k].alias(n) for k, n in enumerate(SUMMARY)))


def replicate_quantiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The summary of bootstrap replicates: a group has as many rows as were drawn, so one buffer holds them."""
    q = F.percentile(value, F.array(*map(F.lit, SUMMARY.values()))).alias("q")
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), q).select(*by, "mean", *(F.col("q")[k].alias(n) for k, n in enumerate(SUMMARY)))


def weighted_quantiles(df: DataFrame, value: str, weight: str, probs: tuple[float, ...], *by: str) -> DataFrame:
    """Quantiles at positions (cumulative weight) / (n + 1), weights scaled to mean 1; ends are not extrapolated.

    A row answers the probabilities between the position before it and its own, the first
    row those before it too, the last row those behind it.
    """
    run = scan(df.select(*by, value, weight), list(by), [value, weight], {"run_": F.col(weight), "seen_": F.lit(1)}, {"pv_": value}, totals={"all_": F.col(weight), "n_": F.lit(1)})
    step = F.col("n_") / F.col("all_") / (F.col("n_") + 1)
    v, n = F.col(value), F.col("n_")
    placed = run.withColumn("to_", F.col("run_") * step).withColumn("from_", F.col("to_") - F.col(weight) * step)
    # a little room for what rounding takes from the positions; the first row that reaches a probability answers it
    asked = F.filter(F.array(*map(F.lit, probs)), lambda p: ((F.col("to_") >= p) | (F.col("seen_") == n)) & ((F.col("from_") < p + 1e-9) | (F.col("seen_") == 1)))
    grid = placed.withColumn("p", F.explode(asked))
    reached, share = F.col("to_") >= F.col("p"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("p") - F.col("from_"), F.col("to_") - F.col("from_"))))
    hit = F.when((F.col("seen_") == 1) | ~reached, v).otherwise(F.col("pv_") + (v - F.col("pv_")) * share)
    return grid.groupBy(*by, "p").agg(F.min_by(hit, F.struct(~reached, "seen_")).alias("value"))


def weighted_median(df: DataFrame, value: str, weight: str, *by: str) -> DataFrame:
    """The first value at which half of all weight is reached."""
    run = scan(df.select(*by, value, weight), list(by), [value, weight], {"run_": F.col(weight)}, totals={"all_": F.col(weight)})
    return run.where(F.col("run_") / F.col("all_") >= 0.5).groupBy(*by).agg(F.min(value).alias("median"))


def outlier_flag(df: DataFrame, value: str, *by: str, reach: float = 1.5) -> DataFrame:
    """``df`` with ``outlier``: beyond ``reach`` interquartile ranges of the quartiles."""
    q = exact_quantiles(df, value, (0.25, 0.75), *by).select(*by, F.col("q").alias("q_"))
    low, high = F.col("q_")[0], F.col("q_")[1]
    out = (F.col(value) < low - reach * (high - low)) | (F.col(value) > high + reach * (high - low))
    return df.join(q, list(by)).withColumn("outlier", out).drop("q_")


def weighted_outlier_flag(df: DataFrame, value: str, weight: str, *by: str, reach: float = 1.5) -> DataFrame:
    """``df`` with ``outlier`` by weighted quartiles."""
    q = weighted_quantiles(df, value, weight, (0.25, 0.75), *by).groupBy(*by).agg(F.min("value").alias("low_"), F.max("value").alias("high_"))
    room = reach * (F.col("high_") - F.col("low_"))
    return df.join(q, list(by)).withColumn("outlier", (F.col(value) < F.col("low_") - room) | (F.col(value) > F.col("high_") + room)).drop("low_", "high_")


def quantile_ranges(df: DataFrame, q: str, *by: str) -> DataFrame:
    """Half the way to the neighbours on each side, all the way to 0 and 1 at the ends; q is distinct in a group."""
    near = scan(df, list(by), [q], lags={"below_": q}, leads={"above_": q})
    left = F.when(F.col("below_").isNull(), F.col(q)).otherwise((F.col(q) - F.col("below_")) * 0.5)
    right = F.when(F.col("above_").isNull(), 1 - F.col(q)).otherwise((F.col("above_") - F.col(q)) * 0.5)
    return near.withColumn("range", left + right).drop("below_", "above_")


def distribution(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, value, n, below): how often each distinct value comes and the share of the group's rows up to it."""
    run = scan(df.groupBy(*by, value).agg(F.count("*").alias("n")), list(by), [value], {"run_": F.col("n")}, totals={"all_": F.col("n")})
    return run.select(*by, value, "n", (F.col("run_") / F.col("all_")).alias("below"))


def bca_interval(replicates: DataFrame, observed: DataFrame, *by: str, confidence: float = 0.95) -> DataFrame:
    """Bias-corrected and accelerated interval of an estimate, and the sign p-value (incorrect + 1) / (B + 1).

    replicates: (by, estimate). observed: (by, y). The bias is the share of replicates below
    their mean, the acceleration the skewness of their differences from it; the interval's ends
    are quantiles of the replicates, interpolated linearly. Null estimates don't count.
    Replicates of a group are as many as were drawn, so they fit one row.
    """
    r = replicates.where("estimate IS NOT NULL")
    n = r.groupBy(*by).agg(F.avg("estimate").alias("m"), F.count("*").alias("b"), *(F.count_if(F.signum("estimate") == k).alias(c) for k, c in ((-1, "neg"), (0, "zero"), (1, "pos"))), F.sort_array(F.collect_list("estimate")).alias("all"))
    u = F.transform("all", lambda e: F.col("m") - e)
    power = lambda k: F.aggregate(u, F.lit(0.0), lambda s, x: s + F.pow(x, F.lit(float(k))))
    below = F.size(F.filter("all", lambda e: e < F.col("m")))
    share = F.greatest(F.least(below / F.col("b"), 1 - 0.5 / F.col("b")), 0.5 / F.col("b"))
    n = n.withColumns({"z0": normal_quantile(share), "a": F.coalesce(F.try_divide(power(3), 6 * F.pow(power(2), F.lit(1.5))), F.lit(0.0))}).join(observed, list(by))

    def end(p: float) -> Column:
        z = F.col("z0") + normal_quantile(F.lit(p))
        at = normal_cdf(F.col("z0") + z / (1 - F.col("a") * z)) * (F.col("b") - 1)
        k = F.floor(at).cast("int")
        low, high = F.element_at("all", k + 1), F.element_at("all", F.least(k + 2, F.col("b").cast("int")))
        return low + (high - low) * (at - k)

    tail = (1 - confidence) / 2
    wrong = F.col("b") - F.greatest("neg", "zero", "pos")
    return n.select(*by, end(tail).alias("ymin"), "y", end(1 - tail).alias("ymax"), ((wrong + 1) / (F.col("b") + 1)).alias("pval"))


def smoothed(x: np.ndarray, y: np.ndarray, own: np.ndarray, rank: int, some: int = 64) -> np.ndarray:
    """Locally weighted straight lines at the places ``own`` of rows sorted by x; ``rank`` rows are the nearest, the row included.

    The nearest rows are a run; the run whose farther end is nearest is found by the sum of its
    ends, which rises with its start. Equal x in all of them leave the row its own value.
    """
    sums = x[: len(x) - rank + 1] + x[rank - 1 :]
    out = np.empty(len(own))
    for at in range(0, len(own), some):
        here = own[at : at + some]
        x0 = x[here]
        s = np.searchsorted(sums, 2 * x0)
        starts = np.clip(np.stack([s - 1, s]), 0, len(sums) - 1)
        h = np.maximum(x0 - x[starts], x[starts + rank - 1] - x0).min(axis=0)
        low, high = np.searchsorted(x, (x0 - h).min()), np.searchsorted(x, (x0 + h).max(), side="right")
        dx = x[low:high] - x0[:, None]
        u = np.abs(dx) / np.where(h > 0, h, 1)[:, None]
        w = np.where(u <= 1, (1 - u**3) ** 3, 0)
        sw, sx, sy, sxx, sxy = w.sum(axis=1), (w * dx).sum(axis=1), w @ y[low:high], (w * dx * dx).sum(axis=1), (w * dx) @ y[low:high]
        spread = sxx - sx * sx / sw
        slope = np.where(spread != 0, (sxy - sx * sy / sw) / np.where(spread != 0, spread, 1), 0)
        out[at : at + some] = np.where(h > 0, sy / sw - slope * sx / sw, y[here])
    return out


def local_regression(df: DataFrame, x: str, y: str, key: str, *by: str, fraction: float = 0.3, least: int = 256) -> DataFrame:
    """(by, key, smooth): locally weighted straight lines with tricube weights; the bandwidth is the distance of rank ceil(fraction * n).

    Rows are numbered in the order of x by a prefix scan and dealt to ranges of ranks; a range
    takes along as many rows beyond both its borders as a bandwidth can reach, so its lines
    are whole and no row meets all others of its group. A range has an eighth of the rows in
    reach, or ``least``; so a group of any size is many tasks. The work is, by the definition
    of the smoother, a share ``fraction`` of n for each row.
    """
    rows = df.select(*by, key, F.col(x).cast("double").alias("x_"), F.col(y).cast("double").alias("y_")).where("x_ IS NOT NULL AND y_ IS NOT NULL")
    placed = scan(rows, list(by), ["x_", key], {"i_": F.lit(1)}, totals={"n_": F.lit(1)})
    rank = F.least(F.ceil(fraction * F.col("n_")) + 1, F.col("n_"))
    placed = placed.withColumns({"i_": F.col("i_") - 1, "rank_": rank, "size_": F.greatest(F.lit(least).cast("bigint"), F.ceil(rank / 8))})
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("i_") - F.col("rank_")) / F.col("size_")))
    last = F.least(F.floor((F.col("n_") - 1) / F.col("size_")), F.floor((F.col("i_") + F.col("rank_")) / F.col("size_")))
    dealt = placed.withColumn("range_", F.explode(F.sequence(first, last)))

    def lines(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i_")
        k, size, n = part["range_"].iloc[0], part["size_"].iloc[0], part["rank_"].iloc[0]
        own = np.flatnonzero((part["i_"] >= k * size) & (part["i_"] < (k + 1) * size))
        return part.iloc[own][[*by, key]].assign(smooth=smoothed(part["x_"].to_numpy(), part["y_"].to_numpy(), own, int(n)))

    schema = StructType([*(df.schema[c] for c in (*by, key)), StructField("smooth", DoubleType())])
    return dealt.groupBy(*by, "range_").applyInPandas(lines, schema)
