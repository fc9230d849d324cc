"""Overlap joins of boxes and of filled pixel rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybox.functions import boxes, contours
from tallybox.operators.work import written


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}") for c in df.columns))


#: Side of a grid cell: a few boxes wide.
CELL = 512


def with_cells(df: DataFrame, cell: int, prefix: str) -> DataFrame:
    """A row for each grid cell that a box covers."""
    s = lambda n: F.col(f"{prefix}{n}")
    cx = F.explode(F.sequence(F.floor(s("x1") / cell), F.floor((F.ceil(s("x2")) - 1) / cell)))
    cy = F.explode(F.sequence(F.floor(s("y1") / cell), F.floor((F.ceil(s("y2")) - 1) / cell)))
    return df.withColumn("cx", cx).withColumn("cy", cy)


def overlap_join(left: DataFrame, right: DataFrame, on: str = "image_id", cell: int | None = CELL) -> DataFrame:
    """Pairs of boxes of one image that overlap; columns a_*, b_* and the image.

    ``cell`` deals the boxes of an image to grid cells, so that dense images don't stay in
    one task; a pair counts in the one cell that holds the upper left corner of its
    intersection. Without it the join is on the image alone, for images of a few boxes.
    """
    a, b = prefixed(left, "a_", (on,)), prefixed(right, "b_", (on,))
    if cell is None:
        return a.join(b, on).where(boxes.overlaps("a_", "b_"))
    pairs = with_cells(a, cell, "a_").join(with_cells(b, cell, "b_"), [on, "cx", "cy"]).where(boxes.overlaps("a_", "b_"))
    home = (F.floor(F.greatest("a_x1", "b_x1") / cell) == F.col("cx")) & (F.floor(F.greatest("a_y1", "b_y1") / cell) == F.col("cy"))
    return pairs.where(home).drop("cx", "cy")


def self_overlaps(df: DataFrame, on: str = "image_id", key: str = "ann_id", cell: int | None = CELL) -> DataFrame:
    """Each unordered pair of overlapping boxes once, the smaller key first."""
    return overlap_join(df, df, on, cell).where(F.col(f"a_{key}") < F.col(f"b_{key}"))


def with_rows(df: DataFrame, points: str = "points") -> DataFrame:
    """``df`` with its contours filled in place of their points: ``rows`` as packed rectangles, their pixels, and x1..y2 of the box they fill (corners inclusive and exclusive).

    Written, so that contours are filled once however often their columns are used.
    """
    own = df.withColumn("filled_", contours.filled(F.col(points))).drop(points)
    sides = {s: F.col(f"filled_.{s}") + int(s in ("x2", "y2")) for s in boxes.SIDES}
    return written(own.withColumns({"rows": F.col("filled_.rectangles"), "pixels": F.col("filled_.pixels")} | sides).drop("filled_"), "contour-rows")


def contour_intersections(a: DataFrame, b: DataFrame, key: str = "ann_id", on: str = "image_id", cell: int | None = CELL) -> DataFrame:
    """Pairs of contours of one image that share pixels, from two tables ``with_rows``: on, a_key, b_key, a_pixels, b_pixels, pixels.

    Contours meet where their boxes do, in grid cells; rows travel with their contour as
    rectangles and are held against each other within a pair, so no table of pixel rows is joined.
    """
    need = [on, key, "rows", "pixels", *boxes.SIDES]
    pairs = overlap_join(a.select(*need), b.select(*need), on, cell)
    both = pairs.withColumn("pixels", contours.common_pixels(F.col("a_rows"), F.col("b_rows")))
    return both.where("pixels > 0").select(on, f"a_{key}", f"b_{key}", "a_pixels", "b_pixels", "pixels")


def tiles_of(df: DataFrame, tile: int) -> DataFrame:
    """A row for each tile of a fixed grid that a box touches: an equi-join instead of a range join."""
    return with_cells(df, tile, "")
