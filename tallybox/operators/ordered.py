"""Running sums, row numbers and neighbours in ordered groups, however large a group is.

A window over a group puts the group into one task. Here the rows of all groups are dealt to
ranges of about equal size by (group, order), so that a large group lies in many ranges.
Each range adds up its part of a group; a table with one row for each range and group, far
smaller than the rows, turns these into what stands before the range; and a window over the
range's own rows does the rest. A neighbour across a border is the last (or first) row
of the range beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybox.operators.work import written

RANGE = "range_"


def scan(
    df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, lags: dict[str, str] | None = None, leads: dict[str, str] | None = None, totals: dict[str, Column] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """``df`` with new columns, each by name, from its rows in rising order of the columns ``order`` in every group.

    sums: running sums, the row included, nulls as 0; ``{"n": F.lit(1)}`` numbers the rows.
    lags, leads: a column of the row before, or after; null at the ends of a group.
    totals: sums over the whole group.
    parts: how many ranges; by default what Spark chooses for a shuffle of that size.

    A new column takes the place of one of its name. The order should be total: what falls between equal rows is not defined, and equal rows
    stay in one range. Null groups are groups of their own; nulls come first in the
    order. The rows are written twice, since dealing ranges reads them twice and the
    ranges must stay as they are.
    """
    sums, lags, leads, totals = sums or {}, lags or {}, leads or {}, totals or {}
    values = {f"s_{k}": F.coalesce(c, F.lit(0)) for k, c in sums.items()} | {f"t_{k}": F.coalesce(c, F.lit(0)) for k, c in totals.items()}
    given = written(df.withColumns(values) if values else df, "scan")
    dealt = given.repartitionByRange(parts, *by, *order) if parts else given.repartitionByRange(*by, *order)
    dealt = written(dealt.withColumn(RANGE, F.spark_partition_id()), "ranges")

    beside = [*lags.values(), *leads.values()]
    ends = {"last_": F.max_by(F.struct(*dict.fromkeys(lags.values())), F.struct(*order))} if lags else {}
    ends |= {"first_": F.min_by(F.struct(*dict.fromkeys(leads.values())), F.struct(*order))} if leads else {}
    parts_ = dealt.groupBy(*by, RANGE).agg(F.count("*").alias("rows_"), *(F.sum(c).alias(c) for c in values), *(c.alias(k) for k, c in ends.items()))
    across = Window.partitionBy(*by).orderBy(RANGE)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts_.select(
        *(F.col(c).alias(f"k_{c}") for c in [*by, RANGE]),
        *(F.coalesce(F.sum(f"s_{k}").over(before), F.lit(0)).alias(f"o_{k}") for k in sums),
        *(F.sum(f"t_{k}").over(Window.partitionBy(*by)).alias(f"a_{k}") for k in totals),
        *([F.lag("last_").over(across).alias("last_")] if lags else []),
        *([F.lead("first_").over(across).alias("first_")] if leads else []),
        *([F.col("rows_").alias("size_")] if beside else []),
    )

    inside = Window.partitionBy(RANGE, *by).orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    same = F.col(RANGE) == F.col(f"k_{RANGE}")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    local = dealt.withColumns({f"s_{k}": F.sum(f"s_{k}").over(running) for k in sums} | ({"at_": F.row_number().over(inside)} if beside else {}) | {f"g_{k}": F.lag(c).over(inside) for k, c in lags.items()} | {f"h_{k}": F.lead(c).over(inside) for k, c in leads.items()})
    joined = local.join(offsets, same)
    return joined.select(
        *(c for c in df.columns if c not in {*sums, *lags, *leads, *totals}),
        *((F.col(f"s_{k}") + F.col(f"o_{k}")).alias(k) for k in sums),
        *(F.when(F.col("at_") == 1, F.col("last_")[c]).otherwise(F.col(f"g_{k}")).alias(k) for k, c in lags.items()),
        *(F.when(F.col("at_") == F.col("size_"), F.col("first_")[c]).otherwise(F.col(f"h_{k}")).alias(k) for k, c in leads.items()),
        *(F.col(f"a_{k}").alias(k) for k in totals),
    )


def numbered(df: DataFrame, order: list[str], *by: str, name: str = "i") -> DataFrame:
    """Rows numbered from 0 in each group."""
    return scan(df, list(by), order, {name: F.lit(1).cast("bigint")}).withColumn(name, F.col(name) - 1)
