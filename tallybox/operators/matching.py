"""Matching predictions to ground truth, and the match table.

The rows of an image move once and meet in one task, which finds the matches of many images at
once in numpy. Images of more than ``WHOLE`` rows, or with a row without id, join their pairs in grid cells, as do
boxes whose sides aren't integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, LongType, StringType, StructField, StructType

from tallybox.functions import boxes
from tallybox.functions.metrics import outcome
from tallybox.operators.spatial import CELL, overlap_join
from tallybox.operators.work import written

#: Rows of an image whose pairs are compared at once; larger images go by a join in grid cells.
WHOLE = 1_000
#: Pairs that are compared at once, and rows that are gathered before they are.
PAIRS, ROWS = 1 << 19, 1 << 14


def _match_joined(gt: DataFrame, pred: DataFrame, threshold: float, cell: int | None) -> DataFrame:
    pairs = overlap_join(gt, pred, cell=cell).select("image_id", F.col("a_ann_id").alias("idx_1"), F.col("b_ann_id").alias("idx_2"), boxes.iou("a_", "b_").alias("iou"))
    # the best of a few columns is an aggregate, which meets its rows before the shuffle; no sort of all pairs
    named = pairs.groupBy("image_id", "idx_2").agg(F.min(F.struct((-F.col("iou")).alias("low"), "idx_1")).alias("n")).where(-F.col("n.low") > threshold)
    taken = named.groupBy("image_id", F.col("n.idx_1").alias("idx_1")).agg(F.min(F.struct("n.low", (-F.col("idx_2")).alias("last"))).alias("m"))
    return taken.select("image_id", "idx_1", (-F.col("m.last")).alias("idx_2"), (-F.col("m.low")).alias("iou"))


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its keys, in rows in their order."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _coded(image: np.ndarray, ann: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code of each row by image and id, rows by code, where a code's rows start, and how many they are)."""
    order = np.lexsort((ann, image))
    new = _firsts(image[order], ann[order])
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    return code, order, start, np.diff(np.append(start, len(order)))


def _matches(image: np.ndarray, known: np.ndarray, second: np.ndarray, ann: np.ndarray, sides: list[np.ndarray], threshold: float, every: tuple[bool, bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the ground truth, row of the prediction, IoU) of whole images, -1 for none; image: rising numbers of the images.

    Rows that aren't known are matched with none. An id that an image has twice is one row until
    it is matched; then all of its rows are, if ``every`` says so of its side, else the first.
    """
    a, b = np.flatnonzero(~second), np.flatnonzero(second)
    (code_a, rows_a, start_a, n_a), (code_b, rows_b, start_b, n_b) = (_coded(image[k], ann[k]) for k in (a, b))
    left, right = a[known[a]], b[known[b]]
    begin, end = (np.searchsorted(image[right], image[left], s) for s in ("left", "right"))
    total, at, met = np.cumsum(end - begin), 0, [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = end[at:stop] - begin[at:stop]
        p = np.repeat(left[at:stop], n)
        q = right[np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at:stop], n)]
        for low, high in ((0, 2), (1, 3)):
            near = (sides[low][p] < sides[high][q]) & (sides[low][q] < sides[high][p])
            p, q = p[near], q[near]
        wide, tall = (np.maximum(0, np.minimum(sides[h][p], sides[h][q]) - np.maximum(sides[s][p], sides[s][q])) for s, h in ((0, 2), (1, 3)))
        of = lambda k: (sides[2][k] - sides[0][k]) * (sides[3][k] - sides[1][k])
        inter = wide * tall
        union = of(p) + of(q) - inter
        # without a union there is no IoU, which comes before all others as a null does
        low = np.where(union == 0, -np.inf, -(inter.astype(float) / np.where(union == 0, 1, union).astype(float)))
        met.append((p, q, low))
        at = stop
    p, q, low = (np.concatenate(m) for m in zip(*met, strict=True))
    order = np.lexsort((ann[p], low, ann[q], image[q]))
    p, q, low = p[order], q[order], low[order]
    named = _firsts(image[q], ann[q]) & (low > -np.inf) & (-low > threshold)
    p, q, low = p[named], q[named], low[named]
    order = np.lexsort((-ann[q], low, ann[p], image[p]))
    p, q, low = p[order], q[order], low[order]
    taken = _firsts(image[p], ann[p])
    i, j, iou = code_a[np.searchsorted(a, p[taken])], code_b[np.searchsorted(b, q[taken])], -low[taken]
    each_a, each_b = (n[k] if all_ else np.ones(len(k), np.int64) for n, k, all_ in ((n_a, i, every[0]), (n_b, j, every[1])))
    n = each_a * each_b
    pair = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    one, two = a[rows_a[start_a[i[pair]] + k // each_b[pair]]], b[rows_b[start_b[j[pair]] + k % each_b[pair]]]
    alone, lone = np.ones(len(n_a), bool), np.ones(len(n_b), bool)
    alone[i], lone[j] = False, False
    fn, fp = a[alone[code_a]], b[lone[code_b]]
    none = lambda k: np.full(len(k), -1)
    return np.concatenate([one, fn, none(fp)]), np.concatenate([two, none(fn), fp]), np.concatenate([iou[pair], np.full(len(fn) + len(fp), np.nan)])


def _by_image(gt: DataFrame, pred: DataFrame, threshold: float, whole: int, carry: tuple[str, ...] = (), every: tuple[bool, bool] = (True, True)) -> tuple[DataFrame | None, tuple[DataFrame, DataFrame] | None]:
    """(rows, larger): the match table of images of ``whole`` rows or fewer, and both tables of the other images, None where there are none.

    rows: image_id, idx_1, idx_2, iou, and the sides and ``carry`` of both as name_1 and name_2, null where
    there is no partner or a table has no such column.
    """
    columns = [c for c in dict.fromkeys([*boxes.SIDES, *carry]) if c in gt.columns or c in pred.columns]
    kinds = {c: [df.schema[c].dataType for df in (gt, pred) if c in df.columns] for c in ("image_id", *columns)}
    whole_numbers = all(isinstance(df.schema[c].dataType, IntegralType) for df in (gt, pred) for c in ("ann_id", *boxes.SIDES))
    if not whole_numbers or not isinstance(kinds["image_id"][0], IntegralType | StringType) or any(k[0] != k[-1] for k in kinds.values()):
        return None, (gt, pred)
    of = lambda df, second: df.select("image_id", F.lit(second).alias("second"), F.col("ann_id").cast("bigint").alias("ann_id"), *((F.col(c) if c in df.columns else F.lit(None).cast(kinds[c][0])).alias(c) for c in columns))
    rows = of(gt, False).unionByName(of(pred, True))
    counts = rows.where("image_id IS NOT NULL").groupBy(F.col("image_id").alias("of")).agg(F.count("*").alias("n"), F.count("ann_id").alias("m"))
    large = written(counts.where((F.col("n") > whole) | (F.col("m") < F.col("n"))).select("of"), "large-images")
    some = not large.isEmpty()
    same = F.col("image_id") == F.col("of")
    schema = StructType([StructField("image_id", kinds["image_id"][0]), StructField("idx_1", LongType()), StructField("idx_2", LongType()), StructField("iou", DoubleType()), *(StructField(f"{c}_{k}", kinds[c][0]) for c in columns for k in (1, 2))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, ann = t.column("image_id").combine_chunks(), t.column("ann_id")
            runs = pc.run_end_encode(ids).run_ends.to_numpy()
            image = np.repeat(np.arange(len(runs)), np.diff(runs, prepend=0))
            known = np.logical_and.reduce([t.column(c).is_valid().to_numpy() for c in ("image_id", "ann_id", *boxes.SIDES)])
            sides = [t.column(c).fill_null(0).to_numpy().astype(np.int64) for c in boxes.SIDES]
            i, j, iou = _matches(image, known, t.column("second").to_numpy(), ann.fill_null(0).to_numpy(), sides, threshold, every)
            one, two = pa.array(i, mask=i < 0), pa.array(j, mask=j < 0)
            first = t.take(one), t.take(two)
            made = [t.column("image_id").take(pa.array(np.maximum(i, j))), first[0].column("ann_id"), first[1].column("ann_id"), pa.array(iou, mask=np.isnan(iou))]
            made += [first[k].column(c) for c in columns for k in (0, 1)]
            yield from pa.Table.from_arrays(made, schema.names).combine_chunks().to_batches(max_chunksize=ROWS)

        for b in batches:
            if b.num_rows:
                held, n = [*held, b], n + b.num_rows
                if n >= ROWS:  # all images but the last, which may go on
                    t = pa.Table.from_batches(held).combine_chunks()
                    runs = pc.run_end_encode(t.column("image_id").combine_chunks()).run_ends.to_numpy()
                    cut = 0 if len(runs) == 1 else int(runs[-2])
                    if t.column("image_id")[-1].as_py() is None:  # rows without an image meet none
                        cut = len(t)
                    if cut:
                        yield from out(t.slice(0, cut).combine_chunks())
                    held, n = t.slice(cut).to_batches(), len(t) - cut
        if n:
            yield from out(pa.Table.from_batches(held).combine_chunks())

    few = rows.join(large, same, "left_anti") if some else rows
    # an image's rows go to one task, rows without one to any
    dealt = few.repartition("image_id", F.when(F.col("image_id").isNull(), F.col("ann_id"))).sortWithinPartitions("image_id")
    made = dealt.mapInArrow(run, schema).withColumns({f"idx_{k}": F.col(f"idx_{k}").cast(df.schema["ann_id"].dataType) for k, df in ((1, gt), (2, pred))})
    return made, tuple(df.join(large, same, "left_semi") for df in (gt, pred)) if some else None


def _whole(found: tuple[DataFrame | None, tuple[DataFrame, DataFrame] | None], by_image: Callable[[DataFrame], DataFrame], joined: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """One table of what ``_by_image`` found and of the larger images, whose pairs are joined."""
    rows, larger = found
    parts = ([] if rows is None else [by_image(rows)]) + ([] if larger is None else [joined(*larger)])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


BOTH = "idx_1 IS NOT NULL AND idx_2 IS NOT NULL"


def match(gt: DataFrame, pred: DataFrame, threshold: float = 0.2, cell: int | None = CELL, whole: int = WHOLE) -> DataFrame:
    """image_id, idx_1 (ground truth), idx_2 (prediction), iou of mutual best pairs above the threshold.

    Every prediction names its best ground truth; of the predictions that name one, the
    best is matched. A prediction that loses isn't matched to another.
    """
    found = _by_image(*(df.select("image_id", "ann_id", *boxes.SIDES) for df in (gt, pred)), threshold, whole, every=(False, False))
    return _whole(found, lambda rows: rows.where(BOTH).select("image_id", "idx_1", "idx_2", "iou"), lambda g, p: _match_joined(g, p, threshold, cell))


def matched(gt: DataFrame, pred: DataFrame, threshold: float = 0.2, whole: int = WHOLE) -> DataFrame:
    """The rows of ``match`` with their ground truth's dataset: those of the match table that are matched, without its joins with all rows."""
    gt, pred = gt.select("image_id", "ann_id", *boxes.SIDES, "dataset"), pred.select("image_id", "ann_id", *boxes.SIDES)
    own = lambda g: g.select("image_id", F.col("ann_id").alias("idx_1"), "dataset")
    by_image = lambda rows: rows.where(BOTH).select("image_id", "idx_1", "idx_2", "iou", F.col("dataset_1").alias("dataset"))
    return _whole(_by_image(gt, pred, threshold, whole, ("dataset",), (True, False)), by_image, lambda g, p: _match_joined(g, p, threshold, CELL).join(own(g), ["image_id", "idx_1"]))


def match_table(gt: DataFrame, pred: DataFrame, threshold: float = 0.2, carry: tuple[str, ...] = (), whole: int = WHOLE) -> DataFrame:
    """A row for each ground truth and each unmatched prediction; -1, 0 and null stand for none.

    carry: columns of both tables to take along, as name_1 and name_2; null where a table has no such column.
    """
    need = tuple(dict.fromkeys(("dataset", "conf", *boxes.SIDES, *carry)))
    beside = lambda df, k: [(F.col(c) if c in df.columns else F.lit(None)).alias(f"{c}_{k}") for c in need]
    side = lambda df, k: df.select("image_id", F.col("ann_id").alias(f"idx_{k}"), *beside(df, k))
    area = lambda k: ((F.col(f"x2_{k}") - F.col(f"x1_{k}")) * (F.col(f"y2_{k}") - F.col(f"y1_{k}")))

    def joined(gt: DataFrame, pred: DataFrame) -> DataFrame:
        m = _match_joined(gt, pred, threshold, CELL).join(side(pred, 2), ["image_id", "idx_2"], "right")
        return table(side(gt, 1).join(m, ["image_id", "idx_1"], "full"))

    def table(both: DataFrame) -> DataFrame:
        return both.select(
            "image_id",
            F.coalesce("dataset_1", "dataset_2").alias("dataset"),
            F.coalesce("idx_1", F.lit(-1)).alias("idx_1"),
            F.coalesce("idx_2", F.lit(-1)).alias("idx_2"),
            F.col("conf_2").alias("conf2"),
            F.coalesce("iou", F.lit(0.0)).alias("iou"),
            F.coalesce(area(1), F.lit(0)).alias("area_1"),
            F.coalesce(area(2), F.lit(0)).alias("area_2"),
            *((F.col(f"{c}_{k}") if f"{c}_{k}" in both.columns else F.lit(None).alias(f"{c}_{k}")) for c in carry for k in (1, 2)),
        )

    rows = _whole(_by_image(gt, pred, threshold, whole, need), table, joined)
    return rows.withColumn("result", outcome(F.col("idx_1"), F.col("idx_2")))
