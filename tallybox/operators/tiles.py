"""Tile grids, pyramids and merging of tile detections."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybox.functions import boxes
from tallybox.operators import suppress


def segments(total: Column, size: int, overlap: int) -> Column:
    """How many segments cover a length."""
    return F.when(total == size, F.lit(1)).otherwise(F.ceil((total - overlap) / F.lit(size - overlap))).cast("int")


def segment_start(i: Column, n: Column, total: Column, size: int) -> Column:
    """Where segment i of n starts: evenly spread overlaps, the first ones a pixel larger."""
    spare = n * size - total
    distance, rest = size - F.floor(spare / F.greatest(n - 1, F.lit(1))), F.pmod(spare, F.greatest(n - 1, F.lit(1)))
    return F.when(n < 2, F.lit(0)).otherwise(i * distance - F.least(i, rest)).cast("bigint")


def tile_grid(images: DataFrame, tile: int = 1024, overlap: int = 384, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys, m, n, x0, y0), a row for each tile of each image."""
    sized = images.withColumns({"nx_": segments(F.col("width"), tile, overlap), "ny_": segments(F.col("height"), tile, overlap)})
    rows = sized.withColumn("m", F.explode(F.sequence(F.lit(0), F.col("nx_") - 1))).withColumn("n", F.explode(F.sequence(F.lit(0), F.col("ny_") - 1)))
    return rows.select(*keys, "m", "n", segment_start(F.col("m"), F.col("nx_"), F.col("width"), tile).alias("x0"), segment_start(F.col("n"), F.col("ny_"), F.col("height"), tile).alias("y0"))


def pyramid(images: DataFrame, tile: int = 1024, increment: float = 0.5) -> DataFrame:
    """(image columns, level, scale): from tile over the longest side up by 1 / increment while at most 0.9, then 1."""
    first = F.lit(float(tile)) / F.greatest("width", "height")
    levels = F.greatest(F.ceil(F.log(F.lit(0.9) / first) / math.log(1 / increment)).cast("int") + 1, F.lit(0))  # one to spare for rounding
    many = F.filter(F.transform(F.sequence(F.lit(0), levels), lambda k: first / F.pow(F.lit(increment), k)), lambda s: s <= 0.9)
    scales = F.when(first >= 1, F.array(first)).otherwise(F.concat(many, F.array(F.lit(1.0))))
    return images.select("*", F.posexplode(scales).alias("level", "scale"))


def scaled_images(levels: DataFrame, tile: int = 1024) -> DataFrame:
    """Sides rounded to multiples of 4, the true scales, and padding up to the tile."""
    side = lambda c: F.when(F.col("scale") == 1, F.col(c)).otherwise(F.bround(F.col(c) * F.col("scale") / 4) * 4).cast("bigint")
    out = levels.withColumns({"w": side("width"), "h": side("height")})
    pad = lambda c: F.floor(F.greatest(F.lit(0), F.lit(tile) - F.col(c)) / 2)
    return out.withColumns({"scale_x": F.col("w") / F.col("width"), "scale_y": F.col("h") / F.col("height"), "pad_x": pad("w"), "pad_y": pad("h")})


def to_image(tile_detections: DataFrame, tiles: DataFrame) -> DataFrame:
    """Boxes of tiles in image coordinates: tile offset, clamp to the scaled image, undo the scale.

    The join's key is the image, which has few tiles, so detections that lie by image need not move again.
    """
    place = ("level", "m", "n")
    t = tiles.select("image_id", *(F.col(c).alias(f"of_{c}") for c in place), "x0", "y0", "w", "h", "scale_x", "scale_y")
    d = tile_detections.join(t, "image_id").where(" AND ".join(f"{c} - of_{c} = 0" for c in place))
    out = {}
    for s in boxes.SIDES:
        x = s[0] == "x"
        moved = F.greatest(F.lit(0), F.least(F.col(s) + F.col("x0" if x else "y0"), F.col("w" if x else "h") - 1))
        out[s] = moved / F.col("scale_x" if x else "scale_y")
    return d.withColumns(out).withColumn("scale", (F.col("scale_x") + F.col("scale_y")) / 2).select(*tile_detections.columns, "scale")


def postprocess(detections: DataFrame, most: int, low: float, high: float, size: int, margin: int, threshold: float, pixels: int, mask: Column | None = None) -> DataFrame:
    """The detections of tiles that stay: the ``most`` best of a tile, of a side from low to high, away from the tile's edge,

    without a better one that overlaps by more than the threshold, and with a mask of ``pixels`` at least.
    """
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("conf"), "ann_id"))
    kept = detections.withColumn("place", place).where(F.col("place") <= most).drop("place")
    kept = kept.where(boxes.geometric_side().between(low, high) & boxes.away_from_edge(F.lit(size), margin))
    return suppress.one_pass_nms(kept, threshold).where((boxes.area() if mask is None else mask) >= pixels)


def merged(detections: DataFrame, images: DataFrame, margin: int, threshold: float, pad: int = 5, whole: int = suppress.WHOLE) -> DataFrame:
    """Detections of all tiles and scales of an image: near-equal boxes go, boxes are padded and clamped, clusters are suppressed.

    Padding looks at one box only, so it comes first, and both suppressions of an image are one pass.
    """
    sized = detections.join(images.select("image_id", "width", "height"), "image_id")
    safe = {f"safe_{s}": c for s, c in boxes.scaled_padded(F.lit(0), F.lit(0), F.lit(1.0), F.col("width"), F.col("height"), pad).items()}
    both = sized.select(*detections.columns, *(c.alias(s) for s, c in safe.items()))
    kept, larger = suppress.settled(both, (boxes.SIDES, boxes.pairs_nearer(margin)), (tuple(safe), boxes.pairs_above(threshold)), whole=whole)
    padded = lambda df: df.select(*(F.col(f"safe_{c}").alias(c) if c in boxes.SIDES else F.col(c) for c in detections.columns))
    if larger is None:
        return padded(kept)
    return padded(kept).unionByName(suppress.cluster_first_nms(padded(suppress.drop_near_equal(larger, margin, whole)), threshold, whole=whole))


def detect(tiles: DataFrame, detector: Callable, schema: str) -> DataFrame:
    """Run a user's batch detector over tiles: an iterator of pandas frames to an iterator of detections."""
    return tiles.mapInPandas(detector, schema)
