"""Box geometry as column expressions. A box is four columns; corners are inclusive-exclusive."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def side(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def area(prefix: str = "") -> Column:
    return (side(prefix, "x2") - side(prefix, "x1")) * (side(prefix, "y2") - side(prefix, "y1"))


def overlap_width(a: str, b: str) -> Column:
    return F.greatest(F.lit(0), F.least(side(a, "x2"), side(b, "x2")) - F.greatest(side(a, "x1"), side(b, "x1")))


def overlap_height(a: str, b: str) -> Column:
    return F.greatest(F.lit(0), F.least(side(a, "y2"), side(b, "y2")) - F.greatest(side(a, "y1"), side(b, "y1")))


def intersection(a: str, b: str) -> Column:
    return overlap_width(a, b) * overlap_height(a, b)


def overlaps(a: str, b: str) -> Column:
    return (side(a, "x1") < side(b, "x2")) & (side(b, "x1") < side(a, "x2")) & (side(a, "y1") < side(b, "y2")) & (side(b, "y1") < side(a, "y2"))


def iou(a: str, b: str, eps: float = 0.0) -> Column:
    """Intersection over union; ``eps`` is added to the union (1e-6 in the mask variant)."""
    inter = intersection(a, b)
    union = (area(a) + area(b) - inter).cast("double")
    return inter.cast("double") / (union + F.lit(eps)) if eps else F.try_divide(inter.cast("double"), union)


def ios(a: str, b: str) -> Column:
    """Intersection over the smaller area."""
    return F.try_divide(intersection(a, b).cast("double"), F.least(area(a), area(b)).cast("double"))


def max_side_difference(a: str, b: str) -> Column:
    return F.greatest(*(F.abs(side(a, s) - side(b, s)) for s in SIDES))


def corners_from_xywh(x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    return {"x1": x, "y1": y, "x2": x + w, "y2": y + h}


def corners_from_centre(cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    return {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2}


def clamp(value: Column, limit: Column) -> Column:
    """Into [0, limit - 1]."""
    return F.greatest(F.lit(0), F.least(value, limit - 1))


def scaled_padded(offset_x: Column, offset_y: Column, scale: Column, width: Column, height: Column, pad: int = 5, prefix: str = "") -> dict[str, Column]:
    """Offset, scale, round half to even, pad outwards and clamp to the image."""
    out = {}
    for s in SIDES:
        off, limit, way = (offset_x, width, s) if s[0] == "x" else (offset_y, height, s)
        moved = F.bround((side(prefix, s) + off) * scale).cast("bigint")
        out[s] = clamp(moved - pad if way[1] == "1" else moved + pad, limit)
    return out


def flipped(size: Column, axis: str, prefix: str = "") -> dict[str, Column]:
    """Mirror on an axis; the lower side stays lower."""
    out = {s: side(prefix, s) for s in SIDES}
    out[f"{axis}1"], out[f"{axis}2"] = size - side(prefix, f"{axis}2"), size - side(prefix, f"{axis}1")
    return out


def letterbox_inverse(gain: Column, pad_x: Column, pad_y: Column, width: Column, height: Column, prefix: str = "") -> dict[str, Column]:
    """Coordinates of a padded and scaled frame back in the image, clipped to it."""
    out = {}
    for s in SIDES:
        pad, limit = (pad_x, width) if s[0] == "x" else (pad_y, height)
        out[s] = F.greatest(F.lit(0.0), F.least((side(prefix, s) - pad) / gain, limit.cast("double")))
    return out


def geometric_side(prefix: str = "") -> Column:
    return F.sqrt(area(prefix).cast("double"))


def away_from_edge(tile: Column, margin: int, prefix: str = "") -> Column:
    """Whether a box in tile coordinates keeps its distance from the tile's edges."""
    return (side(prefix, "x1") >= margin) & (side(prefix, "y1") >= margin) & (side(prefix, "x2") <= tile - margin) & (side(prefix, "y2") <= tile - margin)


# ---- all pairs of a few boxes at once, from arrays of their sides x1, y1, x2, y2: whether they overlap and


def pairs_above(threshold: float) -> Callable[..., np.ndarray]:
    """``iou`` is above the threshold."""

    def clash(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
        w = np.minimum(x2[:, None], x2) - np.maximum(x1[:, None], x1)
        h = np.minimum(y2[:, None], y2) - np.maximum(y1[:, None], y1)
        out = np.zeros(w.shape, bool)
        a, b = np.nonzero((w > 0) & (h > 0))
        inter, area = w[a, b] * h[a, b], (x2 - x1) * (y2 - y1)
        out[a, b] = inter.astype(float) / (area[a] + area[b] - inter).astype(float) > threshold
        return out

    return clash


def pairs_nearer(margin: int) -> Callable[..., np.ndarray]:
    """``max_side_difference`` is below the margin."""

    def clash(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
        out = (x1[:, None] < x2) & (x1 < x2[:, None]) & (y1[:, None] < y2) & (y1 < y2[:, None])
        for s in (x1, y1, x2, y2):
            out &= np.abs(s[:, None] - s) < margin
        return out

    return clash
