"""Contours as arrays of (x, y) structs, with higher-order functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_flat(flat: Column) -> Column:
    """[x1, y1, x2, y2, ...] to points."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda i: F.struct(flat[2 * i].alias("x"), flat[2 * i + 1].alias("y")))


def to_flat(points: Column) -> Column:
    return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))


def from_lists(xs: Column, ys: Column) -> Column:
    return F.transform(F.arrays_zip(xs.alias("x"), ys.alias("y")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def bounds(points: Column) -> dict[str, Column]:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)}


def rolled(points: Column) -> Column:
    """Each point's successor; the first follows the last."""
    return F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))


def signed_area(points: Column) -> Column:
    """Shoelace formula; negative for clockwise order in a y-up frame."""
    cross = F.zip_with(points, rolled(points), lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]).cast("double"))
    return F.aggregate(cross, F.lit(0.0), lambda a, x: a + x) / 2


def centroid(points: Column) -> tuple[Column, Column]:
    """Mean vertex."""
    total = lambda k: F.aggregate(F.transform(points, lambda p: p[k].cast("double")), F.lit(0.0), lambda a, x: a + x) / F.size(points)
    return total("x"), total("y")


def midpoints(points: Column, scale_x: Column, scale_y: Column) -> Column:
    """Edge midpoints over a scale: the contour of a scaled image in its image."""
    previous = F.concat(F.slice(points, F.size(points), 1), F.slice(points, 1, F.size(points) - 1))
    return F.zip_with(points, previous, lambda p, q: F.struct(((p["x"] + q["x"]) / (2 * scale_x)).alias("x"), ((p["y"] + q["y"]) / (2 * scale_y)).alias("y")))


def rescaled(points: Column, scale_x: Column, scale_y: Column) -> Column:
    """Scaled and rounded half to even."""
    return F.transform(points, lambda p: F.struct(F.bround(p["x"] * scale_x).cast("bigint").alias("x"), F.bround(p["y"] * scale_y).cast("bigint").alias("y")))


def projected(points: Column, matrix: list[Column]) -> Column:
    """Transformed by a 3 x 3 matrix given row by row."""
    m = matrix

    def one(p: Column) -> Column:
        w = m[6] * p["x"] + m[7] * p["y"] + m[8]
        return F.struct(((m[0] * p["x"] + m[1] * p["y"] + m[2]) / w).alias("x"), ((m[3] * p["x"] + m[4] * p["y"] + m[5]) / w).alias("y"))

    return F.transform(points, one)


def shifted(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


SPAN = "array<struct<x0:bigint,x1:bigint>>"
ROWS = f"array<{SPAN}>"


def _union(r: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (row, x0, x1) sorted, those of a row that overlap or touch as one."""
    if not len(r):
        return r, x0, x1
    order = np.lexsort((x0, r))
    r, x0, x1 = r[order], x0[order], x1[order]
    wide = int(x1.max() - x0.min()) + 2
    reach = np.maximum.accumulate(x1 - x0.min() + r * wide)  # of all spans before, in this row or those above
    new = np.r_[True, ((x0 - x0.min() + r * wide)[1:] > reach[:-1] + 1) | (r[1:] != r[:-1])]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(r) - 1]
    r, least = r[new], x0.min()
    return r, x0[new], reach[last] - r * wide + least


def _runs(points: pa.Array) -> tuple[np.ndarray, ...]:
    """A column of contours, all of a batch at once, as runs of equal filled rows.

    (owner, y, n, at, x0, x1, first, height): contour, first row and number of rows of each run,
    by contour and row; run, x0 and x1 of each span; first row and number of rows of each
    contour. Between two corners rows are equal where all edges run straight down; there one
    row stands for all, elsewhere each row is a run.
    """
    n = len(points)
    held = points.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(held, pc.list_value_length(points).fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = points.flatten()
    x, y = (flat.field(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in range(2))
    owner, at = np.repeat(np.arange(n), sizes), np.arange(len(x))
    after = np.where(at + 1 == sizes.cumsum()[owner], at + 1 - sizes[owner], at + 1)
    ax, ay, bx, by = x, y, x[after], y[after]
    slope = ay != by

    # corners by contour and height; those of one height are a level, and levels take turns with the gaps above them
    order = np.lexsort((y, owner))
    high_, of_ = y[order], owner[order]
    new = np.r_[True, (high_[1:] != high_[:-1]) | (of_[1:] != of_[:-1])] if len(x) else np.zeros(0, bool)
    level = np.empty(len(x), np.int64)
    level[order] = new.cumsum() - 1
    height_of, holder = high_[new], of_[new]
    last = np.r_[holder[1:] != holder[:-1], True] if len(holder) else new
    low, high = np.minimum(level, level[after]), np.maximum(level, level[after])
    bent = slope & (ax != bx)
    slanted = np.bincount(low[bent], minlength=len(height_of)).cumsum() - np.bincount(high[bent], minlength=len(height_of)).cumsum() > 0
    begin = np.floor(height_of).astype(np.int64) + 1
    end = np.where(last, begin, np.ceil(np.r_[height_of[1:], 0.0]).astype(np.int64)) if len(height_of) else begin
    inner = np.maximum(0, end - begin)
    exact = height_of == np.floor(height_of)
    lines = np.c_[exact.astype(np.int64), np.where(slanted, inner, np.minimum(inner, 1))].ravel()
    unit = np.repeat(np.arange(len(lines)), lines)
    before = np.r_[0, lines.cumsum()]
    gap = unit % 2 == 1
    y_run = np.where(gap, begin[unit // 2] + np.arange(len(unit)) - before[unit], begin[unit // 2] - 1)
    n_run = np.where(gap & ~slanted[unit // 2], inner[unit // 2], 1)

    start = before[2 * low]
    count = before[2 * high + 1] - start
    e = np.repeat(at, count)  # an edge for each run it meets
    run = np.repeat(start - (count.cumsum() - count), count) + np.arange(len(e))
    line = y_run[run]
    steep = slope[e]
    # multiplied first: a quotient without rest is exact
    cross = np.where(steep, ax[e] + (line - ay[e]) * (bx[e] - ax[e]) / np.where(steep, by[e] - ay[e], 1), ax[e])
    # crossings by run, then by x: one order serves what lies above a row and what lies below it
    order = np.lexsort((cross, run))
    e, run, line, cross, steep = e[order], run[order], line[order], cross[order], steep[order]
    parts = []
    for inside in (steep & (line < np.maximum(ay, by)[e]), steep & (line > np.minimum(ay, by)[e])):
        r, c = run[inside], cross[inside]
        parts.append((r[0::2], c[0::2], c[1::2]))
    ends = steep & ((line == ay[e]) | (line == by[e]))
    parts += [(run[ends], cross[ends], cross[ends]), (run[~steep], np.minimum(ax, bx)[e][~steep], np.maximum(ax, bx)[e][~steep])]
    at, x0, x1 = (np.concatenate([p[k] for p in parts]) for k in range(3))
    x0, x1 = np.ceil(x0).astype(np.int64), np.floor(x1).astype(np.int64)
    keep = x1 >= x0
    at, x0, x1 = _union(at[keep], x0[keep], x1[keep])

    first, height = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first[holder[::-1]] = np.ceil(height_of[::-1]).astype(np.int64)
    bottom = np.zeros(n, np.int64)
    bottom[holder] = np.floor(height_of).astype(np.int64)
    height[holder] = np.maximum(1, bottom - first + 1)[holder]
    return holder[unit // 2], y_run, n_run, at, x0, x1, first, height


def _fill(points: pa.Array) -> pa.Array:
    """A column of contours to their filled rows, all contours of a batch at once."""
    held = points.is_valid().to_numpy(zero_copy_only=False)
    owner, y, n, at, x0, x1, first, height = _runs(points)
    base = np.r_[0, height.cumsum()]
    of = np.full(int(base[-1]), -1)  # the run of each row; a contour between two rows has a row without one
    of[np.repeat(base[owner] + y - first[owner] - (n.cumsum() - n), n) + np.arange(int(n.sum()))] = np.repeat(np.arange(len(n)), n)
    spans_of = np.bincount(at, minlength=len(n) + 1)  # the last stands for no run
    begin = np.r_[0, spans_of.cumsum()[:-1]]
    many = spans_of[of]
    pick = np.repeat(begin[of] - (many.cumsum() - many), many) + np.arange(int(many.sum()))
    spans_ = pa.StructArray.from_arrays([pa.array(x0[pick], pa.int64()), pa.array(x1[pick], pa.int64())], ["x0", "x1"])
    rows_ = pa.ListArray.from_arrays(np.r_[0, many.cumsum()].astype(np.int32), spans_)
    offsets = pa.array(base.astype(np.int32), mask=np.r_[~held, False])
    return pa.ListArray.from_arrays(offsets, rows_)


#: Corners and rows, or rectangles of pairs, of a column that are worked on at once.
AT_ONCE = 1 << 19


def _slices(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows of about AT_ONCE in all."""
    cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(sizes.cumsum() // AT_ONCE)) + 1, len(sizes)])
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _corner_slices(points: pa.Array) -> list[pa.Array]:
    """A column of contours in parts of about AT_ONCE corners and rows that edges meet."""
    sizes = pc.list_value_length(points).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    y = points.flatten().field(1).cast(pa.float64()).to_numpy(zero_copy_only=False)
    tall = np.r_[0, np.abs(np.diff(y, prepend=y[:1])).cumsum()]
    stops = sizes.cumsum()
    # the edge that closes a contour is no taller than the others together
    return [points.slice(a, b - a) for a, b in _slices(sizes + 2 * (tall[stops] - tall[np.minimum(stops - sizes + 1, stops)]).astype(np.int64))] or [points]


#: A filled contour: its pixels, its box (corners inclusive; null without pixels), and rectangles of four longs (y, rows, x0, x1).
FILLED = "struct<pixels:bigint,x1:bigint,y1:bigint,x2:bigint,y2:bigint,rectangles:binary>"


def _rectangles(points: pa.Array) -> pa.Array:
    made = []
    for part in _corner_slices(points):
        owner, y, n, at, x0, x1, _, _ = _runs(part)
        of, y, n, held = owner[at], y[at], n[at], part.is_valid().to_numpy(zero_copy_only=False)
        each = np.bincount(of, minlength=len(part))
        stops = np.r_[0, each.cumsum()]
        pixels = np.r_[0, (n * (x1 - x0 + 1)).cumsum()]
        some = each > 0
        edge = {}
        for k, v, f in (("x1", x0, np.minimum), ("y1", y, np.minimum), ("x2", x1, np.maximum), ("y2", y + n - 1, np.maximum)):
            full = np.zeros(len(part), np.int64)
            if some.any():
                full[some] = f.reduceat(v, stops[:-1][some])
            edge[k] = pa.array(full, mask=~some)
        data = np.ascontiguousarray(np.c_[y, n, x0, x1], "<i8")
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((stops * 32).astype(np.int32)), pa.py_buffer(data)])
        total = pa.array(pixels[stops[1:]] - pixels[stops[:-1]], mask=~held)
        made.append(pa.StructArray.from_arrays([total, *edge.values(), packed], ["pixels", *edge, "rectangles"]))
    return pa.concat_arrays(made)


def filled(points: Column) -> Column:
    """Pixels, box and rectangles of a filled contour, as FILLED; null contours have null pixels.

    The same pixels as those of ``rows``, but equal rows in a row are one rectangle, so an
    upright contour takes a few numbers, whatever its size.
    """
    return F.arrow_udf(_rectangles, FILLED)(points)


def _unpacked(rectangles: pa.Array) -> tuple[np.ndarray, ...]:
    """(row of the column, y, rows, x0, x1) of packed rectangles."""
    size = pc.binary_length(rectangles).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 32
    held = rectangles.drop_null()
    data = np.frombuffer(b"".join(held.to_pylist()), "<i8").reshape(-1, 4)
    return np.repeat(np.arange(len(rectangles)), size), *data.T


def _in_window(rectangles: pa.Array, x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array) -> pa.Array:
    of, y, n, x0, xe = _unpacked(rectangles)
    left, top, right, bottom = (v.to_numpy(zero_copy_only=False)[of] for v in (x1, y1, x2, y2))
    wide = np.maximum(0, np.minimum(xe, right - 1) - np.maximum(x0, left) + 1)
    tall = np.maximum(0, np.minimum(y + n, bottom) - np.maximum(y, top))
    total = np.r_[0, (wide * tall).cumsum()]
    stops = np.r_[0, np.bincount(of, minlength=len(rectangles)).cumsum()]
    return pa.array(total[stops[1:]] - total[stops[:-1]])


def pixels_in_window(rectangles: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Pixels of a filled contour in a window whose corners are inclusive and exclusive."""
    return F.arrow_udf(_in_window, "bigint")(rectangles, *(c.cast("bigint") for c in (x1, y1, x2, y2)))


def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    """Pixels of both contours of each pair.

    Rectangles of a contour don't overlap and stand by rows, so those of the other that share
    a row with one are a range of theirs, and the pixels of both add up over such pairs.
    """
    out = []
    sizes = (pc.binary_length(a).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + pc.binary_length(b).fill_null(0).to_numpy(zero_copy_only=False)) // 32
    for s, t in _slices(sizes):
        p, y, n, x0, x1 = _unpacked(a.slice(s, t - s))
        q, v, m, u0, u1 = _unpacked(b.slice(s, t - s))
        total = np.zeros(t - s, np.int64)
        if len(p) and len(q):
            least = min(y.min(), v.min())
            high = int(max((y + n).max(), (v + m).max()) - least) + 2
            begin, end = p * high + (y - least), p * high + (y + n - least)
            other, stop = q * high + (v - least), q * high + (v + m - least)
            low = np.searchsorted(stop, begin, side="right")
            many = np.maximum(0, np.searchsorted(other, end, side="left") - low)
            # a few rectangles at a time, however many share a row
            for c, d in _slices(many):
                k = np.repeat(np.arange(c, d), many[c:d])
                j = np.repeat(low[c:d] - (many[c:d].cumsum() - many[c:d]), many[c:d]) + np.arange(len(k))
                tall = np.minimum(end[k], stop[j]) - np.maximum(begin[k], other[j])
                wide = np.maximum(0, np.minimum(x1[k], u1[j]) - np.maximum(x0[k], u0[j]) + 1)
                np.add.at(total, p[k], tall * wide)
        out.append(total)
    return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))


def common_pixels(a: Column, b: Column) -> Column:
    """Pixels of both of two filled contours, from their rectangles."""
    return F.arrow_udf(_common, "bigint")(a, b)


def rows(points: Column) -> Column:
    """The filled pixel rows of a contour from its least y on, each an array of spans (x0, x1), ends included.

    A pixel is inside if its centre lies in the contour or on its border. On a scan line the
    contour is what lies just above it, what lies just below it, and the edges that end or
    run on it: edges count in [low, high) for the one and (low, high] for the other, and
    sorted crossings pair up in both (even-odd). Rows of a batch are filled together in
    numpy; as expressions over arrays the same takes several times as long. Null
    contours stay null, empty ones have no rows.
    """
    return F.arrow_udf(_fill, ROWS)(points)


def first_row(points: Column) -> Column:
    """The y of the first of ``rows``."""
    return F.ceil(bounds(points)["y1"].cast("double")).cast("bigint")


def _total(of: Column) -> Column:
    return F.aggregate(of, F.lit(0).cast("bigint"), lambda a, v: a + v)


def n_pixels(rows_: Column) -> Column:
    return _total(F.transform(F.flatten(rows_), lambda s: s["x1"] - s["x0"] + 1))


def clipped(rows_: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The rows cut to a window whose corners are inclusive and exclusive; rows outside become empty."""

    def line(spans: Column, i: Column) -> Column:
        cut = F.transform(spans, lambda s: F.struct(F.greatest(s["x0"], x1.cast("bigint")).alias("x0"), F.least(s["x1"], x2.cast("bigint") - 1).alias("x1")))
        inside = (y0 + i >= y1) & (y0 + i < y2)
        return F.when(inside, F.filter(cut, lambda s: s["x1"] >= s["x0"])).otherwise(F.array().cast(SPAN))

    return F.transform(rows_, line)


def row_bounds(rows_: Column, y0: Column) -> dict[str, Column]:
    """The box of filled rows, corners inclusive; null without pixels."""
    flat = F.flatten(rows_)
    used = F.filter(F.transform(rows_, lambda r, i: F.when(F.size(r) > 0, y0 + i)), lambda y: y.isNotNull())
    return {"x1": F.array_min(F.transform(flat, lambda s: s["x0"])), "y1": F.array_min(used), "x2": F.array_max(F.transform(flat, lambda s: s["x1"])), "y2": F.array_max(used)}


def spans(df: DataFrame, points: str = "points") -> DataFrame:
    """The columns of ``df`` besides its contour, and a row for each filled span: y, x0, x1 (ends included)."""
    others = [c for c in df.columns if c != points]
    each = df.select(*others, first_row(F.col(points)).alias("y_"), F.posexplode(rows(F.col(points))).alias("i_", "r_"))
    return each.select(*others, (F.col("y_") + F.col("i_")).alias("y"), F.explode("r_").alias("s_")).select(*others, "y", "s_.x0", "s_.x1")
