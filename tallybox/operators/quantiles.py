"""Exact quantiles of groups of any size, in memory that does not grow with the group.

A quantile is a value of known rank, or lies between two. The values of a group are counted
in equal bins between its least and greatest value; only the bins that hold a wanted rank
stay, each with its own least and greatest value, and are cut again. Once a bin holds few
rows, or one value only, its rows are ranked. Each round reads the rows once, joins
them to one row per group, and shuffles counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybox.operators.work import written

BINS, FEW = 1_024, 10_000
LARGEST = 1.7976931348623157e308


def same(by: tuple[str, ...], prefix: str) -> Column:
    """Null-safe equality of the group's columns with their prefixed copies."""
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def ranked(df: DataFrame, value: str, by: tuple[str, ...], ranks: DataFrame, bins: int = BINS, few: int = FEW, rounds: int = 400) -> DataFrame:
    """(by, rank, value): the values of wanted ranks, counted from 0.

    ranks: (by, lo, hi, n, rank), the least and greatest value and the number of rows of the
    group beside each wanted rank. Every round takes the least and the greatest value out of
    each bin that more than ``few`` rows hold, and in most data a factor of ``bins``.
    """
    rows = df.select(*by, F.col(value).alias("v_"))
    state = written(ranks.select(*by, "rank", "lo", "hi", F.lit(0).cast("bigint").alias("before"), F.col("n").alias("inside")), "brackets")
    wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > few)

    def held(some: DataFrame) -> DataFrame:
        """Rows in one of some brackets, with it; the brackets of a group are apart, so a row is in one at most."""
        each = some.groupBy(*(F.col(c).alias(f"k_{c}") for c in by)).agg(F.collect_set(F.struct("lo", "hi", "before")).alias("of_"))
        own = F.filter("of_", lambda b: (F.col("v_") >= b["lo"]) & (F.col("v_") <= b["hi"]))
        return rows.join(each, same(by, "k_")).withColumn("b_", F.get(own, F.lit(0))).where("b_ IS NOT NULL").select(*by, "v_", "b_.*")

    for _ in range(rounds):
        open_ = state.where(wide)
        if open_.isEmpty():
            break
        half = lambda c: F.col(c) * 0.5  # noqa: E731  the distance of halves can't overflow
        bin_ = F.least(F.lit(bins - 1), F.floor((half("v_") - half("lo")) / (half("hi") - half("lo")) * bins)).cast("int")
        counted = held(open_).groupBy(*by, "lo", "hi", "before", bin_.alias("bin")).agg(F.count("*").alias("inside"), F.min("v_").alias("least"), F.max("v_").alias("most"))
        run = Window.partitionBy(*by, "lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # the bins of a bracket
        placed = counted.withColumn("start", F.col("before") + F.coalesce(F.sum("inside").over(run), F.lit(0)))
        placed = placed.select(*(F.col(c).alias(f"k_{c}") for c in by), F.col("lo").alias("k_lo"), "least", "most", "start", "inside")
        own = same(by, "k_") & (F.col("lo") == F.col("k_lo")) & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + placed["inside"])
        cut = open_.drop("inside").join(placed, own).select(*by, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("start").alias("before"), "inside")
        state = written(state.where(~wide).unionByName(cut), "brackets")
    else:
        raise RuntimeError(f"ranks were not found in {rounds} rounds")
    single = state.where("lo = hi").select(*by, "rank", F.col("lo").alias("value"))
    last = held(state.where("lo < hi"))
    place = F.col("before") + F.row_number().over(Window.partitionBy(*by, "lo").orderBy("v_")) - 1  # of at most ``few`` rows
    found = last.select(*(F.col(c).alias(f"k_{c}") for c in by), place.alias("k_rank"), F.col("v_").alias("value"))
    asked = state.where("lo < hi").select(*by, "rank")
    return single.unionByName(asked.join(found, same(by, "k_") & (F.col("rank") == F.col("k_rank"))).select(*by, "rank", "value"))


def exact_quantiles(df: DataFrame, value: str, probs: tuple[float, ...], *by: str, bins: int = BINS, few: int = FEW) -> DataFrame:
    """(by, n, q): the number of values and an array of their quantiles, interpolated linearly between ranks.

    Null and NaN values don't count; infinite ones count as the largest numbers. Groups without
    values are left out. Null groups are groups of their own.
    """
    v = F.col(value).cast("double")
    rows = written(df.where(v.isNotNull() & ~F.isnan(v)).select(*by, F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v)).alias("v")), "values")
    size = written(rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0"), "sizes")
    at = [F.lit(p) * (F.col("n") - 1) for p in probs]
    low, high = [F.floor(a) for a in at], [F.least(F.floor(a) + 1, F.col("n") - 1) for a in at]
    ranks = size.withColumn("rank", F.explode(F.array_distinct(F.array(*low, *high))))
    found = ranked(rows, "v", by, ranks, bins, few).groupBy(*(F.col(c).alias(f"k_{c}") for c in by)).agg(F.map_from_entries(F.collect_set(F.struct("rank", "value"))).alias("at"))
    of = lambda k: F.try_element_at(F.col("at"), k)
    q = [of(a) * (a + 1 - x) + of(b) * (x - a) for a, b, x in zip(low, high, at, strict=True)]
    return size.join(found, same(by, "k_")).select(*by, "n", F.array(*q).alias("q"))
