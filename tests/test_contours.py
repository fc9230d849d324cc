"""Filled rows of contours against a plain point-in-polygon test, and what is built on them."""

from fractions import Fraction

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybox.functions import contours
from tallybox.operators import spatial

POINT = pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))


def inside(points, x, y):
    """On the border, or an odd number of edges to the right."""
    odd = False
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and x < ax + Fraction((y - ay) * (bx - ax), by - ay):
            odd = not odd
    return odd


def plain(points):
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return {(x, y) for y in range(min(ys), max(ys) + 1) for x in range(min(xs), max(xs) + 1) if inside(points, x, y)}


def filled(many):
    got = contours._fill(pa.array([None if p is None else [{"x": x, "y": y} for x, y in p] for p in many], POINT)).to_pylist()
    return [None if r is None else [[(s["x0"], s["x1"]) for s in line] for line in r] for r in got]


coordinate = st.tuples(st.integers(-9, 9), st.integers(-9, 9))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(coordinate, min_size=1, max_size=9), min_size=1, max_size=4))
def test_rows_hold_the_pixels_in_and_on_any_contour(many):
    for points, got in zip(many, filled(many), strict=True):
        y0 = min(y for _, y in points)
        assert {(x, y0 + i) for i, line in enumerate(got) for a, b in line for x in range(a, b + 1)} == plain(points)
        for line in got:
            assert all(a <= b for a, b in line) and all(b + 1 < c for (_, b), (c, _) in zip(line, line[1:], strict=False))


def test_a_contour_with_legs_keeps_its_border():
    legs = [(0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 6), (0, 6)]
    (got,) = filled([legs])
    assert sum(b - a + 1 for line in got for a, b in line) == len(plain(legs)) == 84
    assert got[6] == [(0, 3), (7, 10)] and got[3] == [(0, 10)]


def test_odd_contours_and_slices():
    assert filled([None, [], [(2, 3)], [(0, 0), (3, 0)]]) == [None, [], [[(2, 2)]], [[(0, 3)]]]
    every = pa.array([[{"x": 0, "y": 0}, {"x": k, "y": 0}, {"x": 0, "y": k}] for k in range(1, 6)], POINT)
    assert contours._fill(every.slice(2, 2)).to_pylist() == contours._fill(every).to_pylist()[2:4]
    assert contours._fill(pa.array([], POINT)).to_pylist() == []


@pytest.fixture(scope="module")
def shapes(spark):
    legs = lambda x, y: [(x, y), (x + 3, y), (x + 3, y + 6), (x + 6, y + 6), (x + 6, y), (x + 9, y), (x + 9, y + 9), (x, y + 9)]
    given_ = {1: legs(0, 0), 2: legs(4, 1), 3: legs(3, -4), 4: [(100, 100), (120, 100), (100, 120)], 5: [(4, 0), (5, 0), (5, 5), (4, 5)]}
    df = spark.createDataFrame([(k, k % 1, [{"x": x, "y": y} for x, y in p]) for k, p in given_.items()], "ann_id bigint, image_id bigint, points array<struct<x:bigint,y:bigint>>")
    return {k: plain(p) for k, p in given_.items()}, df


@pytest.mark.parametrize("cell", [None, 4, 512])
def test_shared_pixels_of_pairs(shapes, cell):
    pixels, df = shapes
    own = spatial.with_rows(df)
    got = {(r["a_ann_id"], r["b_ann_id"]): (r["a_pixels"], r["b_pixels"], r["pixels"]) for r in spatial.contour_intersections(own, own, cell=cell).collect()}
    assert got == {(a, b): (len(p), len(q), len(p & q)) for a, p in pixels.items() for b, q in pixels.items() if p & q}
    assert (1, 5) not in got or pixels[1] & pixels[5]


def test_clipping_and_boxes_of_rows(shapes):
    pixels, df = shapes
    own = df.withColumns({"r": contours.rows(F.col("points")), "y0": contours.first_row(F.col("points"))})
    cut = contours.clipped(F.col("r"), F.col("y0"), F.lit(2), F.lit(1), F.lit(8), F.lit(7))
    box = contours.row_bounds(cut, F.col("y0"))
    for r in own.select("ann_id", contours.n_pixels(cut).alias("n"), *(c.alias(k) for k, c in box.items())).collect():
        want = {(x, y) for x, y in pixels[r["ann_id"]] if 2 <= x < 8 and 1 <= y < 7}
        assert r["n"] == len(want)
        xs, ys = [x for x, _ in want], [y for _, y in want]
        assert (r["x1"], r["y1"], r["x2"], r["y2"]) == ((min(xs), min(ys), max(xs), max(ys)) if want else (None,) * 4)


def test_spans_list_the_rows(shapes):
    pixels, df = shapes
    got = {}
    for r in contours.spans(df).collect():
        got.setdefault(r["ann_id"], set()).update((x, r["y"]) for x in range(r["x0"], r["x1"] + 1))
    assert got == pixels


def test_upright_contours_are_few_rectangles_whatever_their_size():
    box = [[(0, 0), (9, 0), (9, 4_000), (0, 4_000)], [(0, 0), (3, 0), (3, 500), (6, 500), (6, 0), (9, 0), (9, 900), (0, 900)]]
    got = contours._rectangles(pa.array([[{"x": x, "y": y} for x, y in p] for p in box], POINT)).to_pylist()
    assert [g["pixels"] for g in got] == [10 * 4_001, 500 * 8 + 401 * 10]
    assert all(len(g["rectangles"]) // 32 <= 10 for g in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(coordinate, min_size=0, max_size=9), min_size=2, max_size=4))
def test_rectangles_hold_the_same_pixels(many):
    made = contours._rectangles(pa.array([[{"x": x, "y": y} for x, y in p] for p in many], POINT))
    pixels = [plain(p) if p else set() for p in many]
    for p, g in zip(pixels, made.to_pylist(), strict=True):
        xs, ys = [x for x, _ in p], [y for _, y in p]
        assert (g["pixels"], g["x1"], g["y1"], g["x2"], g["y2"]) == (len(p), *((min(xs), min(ys), max(xs), max(ys)) if p else (None,) * 4))
    packed = made.field(5)
    assert contours._common(packed, pa.concat_arrays([packed[1:], packed[:1]])).to_pylist() == [len(p & q) for p, q in zip(pixels, pixels[1:] + pixels[:1], strict=True)]
    window = [pa.array([v] * len(many)) for v in (-4, -3, 6, 5)]
    assert contours._in_window(packed, *window).to_pylist() == [sum(-4 <= x < 6 and -3 <= y < 5 for x, y in p) for p in pixels]
