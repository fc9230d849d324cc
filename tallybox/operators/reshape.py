"""Unions, ids, long and wide forms, completions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybox.operators.ordered import scan


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dense_ids(df: DataFrame, source: str, order: list, name: str = "id") -> DataFrame:
    """Ids 1.. by source and order, without gaps; null sources come first."""
    return scan(df, [], [source, *order], {name: F.lit(1).cast("bigint")})


def merge_datasets(images: DataFrame, annotations: DataFrame, source: str = "dataset") -> tuple[DataFrame, DataFrame]:
    """Images and annotations of many datasets with new ids; old ids are per source."""
    new = dense_ids(images, source, ["image_id"], "new_image_id")
    moved = annotations.join(new.select(source, "image_id", "new_image_id"), [source, "image_id"])
    return new, dense_ids(moved, source, ["image_id", "ann_id"], "new_ann_id")


def melted(df: DataFrame, keys: list[str], pattern: str, parts: list[str], value: str = "value") -> DataFrame:
    """Long form of all columns but the keys, with the parts that a pattern finds in their names."""
    others = [c for c in df.columns if c not in keys]
    long = df.unpivot([F.col(k) for k in keys], [F.col(c) for c in others], "name_", value)
    return long.select(*keys, *(F.regexp_extract("name_", pattern, k + 1).alias(p) for k, p in enumerate(parts)), value)


def mirrored(df: DataFrame, a: str, b: str) -> DataFrame:
    """The table and its mirror image with a and b exchanged; the diagonal once."""
    swap = df.select(*(F.col(b).alias(a) if c == a else F.col(a).alias(b) if c == b else F.col(c) for c in df.columns))
    return df.where(F.col(a) != F.col(b)).unionByName(swap)


def previous_blanked(df: DataFrame, column: str, order: list, *by: str) -> DataFrame:
    """Null where a value equals the one before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(column, F.when(F.col(column) == F.lag(column).over(w), F.lit(None)).otherwise(F.col(column)))


def without_empty_columns(df: DataFrame, drop: str | None = None) -> DataFrame:
    """Columns that match ``drop`` and columns without a value go; one pass over the rows."""
    import re

    names = [c for c in df.columns if not (drop and re.search(drop, c))]
    n = df.agg(*(F.count(c).alias(c) for c in names)).first()
    return df.select(*(c for c in names if n[c]))
