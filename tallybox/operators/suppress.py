"""Duplicate suppression: greedy, one-pass and by near-equal sides."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from tallybox.functions import boxes
from tallybox.operators.graph import components, components_within
from tallybox.operators.spatial import CELL, overlap_join
from tallybox.operators.work import written

Score = Callable[[str, str], Column]


#: Conflicts of an image, or of a component of a larger one, that one task decides in order.
MOST = 500_000
#: Rows of an image whose pairs are compared at once; larger images go by a join in grid cells.
WHOLE = 1_000
#: A step of suppression: the names of the four sides, and which pairs of them clash.
Step = tuple[tuple[str, ...], Callable[..., np.ndarray]]


def conflicts(df: DataFrame, clash: Column, cell: int | None = CELL, group: str = "image_id") -> DataFrame:
    """(group, better, worse, conf) of pairs that clash; better: higher confidence, then lower id; conf: the better one's."""
    pairs = overlap_join(df, df, group, cell).where(clash)
    ahead = (F.col("a_conf") > F.col("b_conf")) | ((F.col("a_conf") == F.col("b_conf")) & (F.col("a_ann_id") < F.col("b_ann_id")))
    return pairs.where(ahead & (F.col("a_ann_id") != F.col("b_ann_id"))).select(F.col(group).alias("group"), F.col("a_ann_id").alias("better"), F.col("b_ann_id").alias("worse"), F.col("a_conf").alias("conf"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What conflicts suppress, from (group, better, worse) by group and, within it, those of the best row first.

    So a row is decided before it suppresses any. Only what the group at hand has lost is held.
    """
    group, gone = object(), set()
    for b in batches:
        lost = []
        for of, better, worse in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if of != group:
                group, gone = of, set()
            if better not in gone and worse not in gone:
                gone.add(worse)
                lost.append(worse)
        yield pa.RecordBatch.from_arrays([pa.array(lost, b.schema.field(2).type)], ["ann_id"])


def _in_order(pairs: DataFrame, by: str, schema: str) -> DataFrame:
    dealt = pairs.select(by, "better", "worse", "conf").repartition(by).sortWithinPartitions(by, F.desc("conf"), "better")
    return dealt.drop("conf").mapInArrow(_sweep, schema)


def _by_rounds(pairs: DataFrame, rounds: int) -> DataFrame:
    """The same over all tasks: rows without a better undecided neighbour are kept, theirs go, and again."""
    gone = pairs.select(F.col("worse").alias("ann_id")).limit(0)
    for _ in range(rounds):
        if pairs.isEmpty():
            return gone
        better = pairs.select(F.col("better").alias("ann_id")).distinct()
        won = better.join(pairs.select(F.col("worse").alias("ann_id")), "ann_id", "left_anti")
        lost = written(pairs.join(won.withColumnRenamed("ann_id", "better"), "better", "left_semi").select(F.col("worse").alias("ann_id")).distinct(), "lost")
        # conflicts of what is lost or won are settled
        left = pairs.join(lost.withColumnRenamed("ann_id", "worse"), "worse", "left_anti").join(lost.withColumnRenamed("ann_id", "better"), "better", "left_anti")
        pairs = written(left, "pairs")
        gone = written(gone.unionByName(lost), "gone")
    raise RuntimeError(f"suppression did not end in {rounds} rounds")


def suppressed(pairs: DataFrame, most: int = MOST, rounds: int = 1000) -> DataFrame:
    """(ann_id): what greedy suppression drops, from ``conflicts``.

    The conflicts of an image are decided in order in one pass, if they are ``most`` or fewer;
    larger images fall apart into components of their conflicts, decided in the same way;
    only components beyond ``most`` go through rounds over all tasks, half as many as their
    longest chain of falling scores.
    """
    schema = f"ann_id {pairs.schema['worse'].dataType.simpleString()}"
    pairs = written(pairs, "pairs")

    def split(pairs: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
        n = pairs.groupBy(F.col(by).alias("of")).agg(F.count("*").alias("n")).where(F.col("n") > most)
        same = F.col(by).eqNullSafe(F.col("of"))
        return pairs.join(n, same, "left_anti"), pairs.join(n, same, "left_semi")

    few, many = split(pairs, "group")
    gone = _in_order(few, "group", schema)
    if many.isEmpty():
        return gone
    home = components(many.select(F.col("better").alias("a"), F.col("worse").alias("b")))
    placed = written(many.join(home.withColumnRenamed("node", "better"), "better").select("component", "better", "worse", "conf"), "pairs")
    few, many = split(placed, "component")
    gone = gone.unionByName(_in_order(few, "component", schema))
    return gone if many.isEmpty() else gone.unionByName(_by_rounds(many.select("better", "worse"), rounds))


def _kept(known: np.ndarray, steps: list[tuple[Callable[..., np.ndarray], list[np.ndarray]]]) -> np.ndarray:
    """Which rows of an image, the best first, all steps leave one after the other. Rows that aren't known clash with none."""
    keep, left = np.ones(len(known), bool), np.flatnonzero(known)
    for clash, sides in steps:
        ahead = np.triu(clash(*(s[left] for s in sides)), 1)
        lost = np.zeros(len(left), bool)
        for k in np.flatnonzero(ahead.any(axis=1)):
            if not lost[k]:
                lost |= ahead[k]
        keep[left[lost]] = False
        left = left[~lost]
    return keep


def settled(df: DataFrame, *steps: Step, whole: int = WHOLE, group: str = "image_id") -> tuple[DataFrame, DataFrame | None]:
    """(kept, larger): what greedy suppression keeps, step after step, of images of ``whole`` rows or fewer, and all rows of larger ones, None without any.

    The rows of an image move once and meet in one task, the best first; a larger image's go through it in batches.
    """
    need = list(dict.fromkeys([group, "ann_id", "conf", *(c for names, _ in steps for c in names)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, ()  # rows of the image at hand, and its id if it is too large

        def out(rows: pa.Table, keep: np.ndarray, decided: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from rows.append_column("decided_", pa.array(decided)).filter(pa.array(keep)).combine_chunks().to_batches()

        def parts(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, large
            runs = pc.run_end_encode(rows.column(group).chunk(0))
            ends, ids = runs.run_ends.to_pylist(), runs.values.to_pylist()
            known = np.logical_and.reduce([rows.column(c).is_valid().to_numpy() for c in need])
            sides = [[rows.column(c).fill_null(0).to_numpy() for c in names] for names, _ in steps]
            sides = [[s.astype(np.int64) if s.dtype.kind == "i" else s for s in own] for own in sides]
            keep, decided, at = np.ones(len(rows), bool), np.ones(len(rows), bool), 0
            held = None
            for end, of in zip(ends, ids, strict=True):
                if of is not None and (large == (of,) or end - at > whole):
                    decided[at:end], large = False, (of,)
                elif of is not None and end == len(rows) and not last:
                    held = rows.slice(at)
                    rows, keep, decided = rows.slice(0, at), keep[:at], decided[:at]
                elif of is not None and end - at > 1:
                    keep[at:end] = _kept(known[at:end], [(clash, [s[at:end] for s in own]) for (_, clash), own in zip(steps, sides, strict=True)])
                at = end
            if len(rows):
                yield from out(rows, keep, decided)

        for b in batches:
            if b.num_rows:
                new = pa.Table.from_batches([b])
                yield from parts(new if held is None else pa.concat_tables([held, new]).combine_chunks(), False)
        if held is not None:
            yield from parts(held, True)

    schema = StructType([*df.schema.fields]).add("decided_", BooleanType())
    dealt = df.repartition(group).sortWithinPartitions(group, F.desc("conf"), "ann_id")
    made = written(dealt.mapInArrow(run, schema), "settled")
    larger = made.where("NOT decided_").drop("decided_")
    return made.where("decided_").drop("decided_"), None if larger.isEmpty() else larger


def _without(df: DataFrame, pairs: DataFrame, **how: int) -> DataFrame:
    return df.join(suppressed(pairs, **how), "ann_id", "left_anti")


def nms(df: DataFrame, threshold: float, score: Score = boxes.iou, cell: int | None = CELL, whole: int = WHOLE, **how: int) -> DataFrame:
    """Rows kept by greedy suppression; a pair clashes if its score is above the threshold. Other scores than the IoU are columns of joined pairs."""
    if score is not boxes.iou:
        return _without(df, conflicts(df, score("a_", "b_") > threshold, cell), **how)
    kept, larger = settled(df, (boxes.SIDES, boxes.pairs_above(threshold)), whole=whole)
    return kept if larger is None else kept.unionByName(_without(larger, conflicts(larger, score("a_", "b_") > threshold, cell), **how))


def one_pass_nms(df: DataFrame, threshold: float, score: Score = boxes.iou) -> DataFrame:
    """Rows that no better row overlaps, suppressed or not."""
    gone = conflicts(df, score("a_", "b_") > threshold).select(F.col("worse").alias("ann_id")).distinct()
    return df.join(gone, "ann_id", "left_anti")


def drop_near_equal(df: DataFrame, margin: int, whole: int = WHOLE) -> DataFrame:
    """Greedy suppression of boxes all of whose sides differ by less than the margin."""
    kept, larger = settled(df, (boxes.SIDES, boxes.pairs_nearer(margin)), whole=whole)
    return kept if larger is None else kept.unionByName(_without(larger, conflicts(larger, boxes.max_side_difference("a_", "b_") < margin)))


def clusters(df: DataFrame, threshold: float, score: Score = boxes.iou) -> DataFrame:
    """(ann_id, component) of the graph of pairs that score at least the threshold; lone boxes are their own."""
    close = overlap_join(df, df).where((F.col("a_ann_id") < F.col("b_ann_id")) & (score("a_", "b_") >= threshold))
    found = components_within(close.select(F.col("image_id").alias("group"), F.col("a_ann_id").alias("a"), F.col("b_ann_id").alias("b")))
    return df.select("ann_id").join(found.withColumnRenamed("node", "ann_id"), "ann_id", "left").select("ann_id", F.coalesce("component", "ann_id").alias("component"))


def cluster_first_nms(df: DataFrame, threshold: float, least: int = 10, **how: int) -> DataFrame:
    """Greedy suppression within clusters of a quarter of the threshold, in images of ``least`` boxes or more.

    A pair above the threshold is above a quarter of it, so two boxes that clash are always of one
    cluster, and suppression within clusters keeps what suppression in the whole image keeps.
    Clusters only spare comparisons, which grid cells do here; so none are made, and ``least`` doesn't matter.
    """
    return nms(df, threshold, **how)
