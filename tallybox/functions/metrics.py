"""Metric formulas. ``empty`` is the value where nothing can be divided: None, 0 or 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(float(empty)))


def precision(tp: Column, fp: Column, empty: float | None = None) -> Column:
    return ratio(tp, tp + fp, empty)


def recall(tp: Column, fn: Column, empty: float | None = None) -> Column:
    return ratio(tp, tp + fn, empty)


def f1(tp: Column, fp: Column, fn: Column, empty: float | None = 0.0) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn, empty)


def fitness(map50: Column, map50_95: Column) -> Column:
    return 0.1 * map50 + 0.9 * map50_95


def relative_change(value: Column, base: Column) -> Column:
    """Share of the room above the base, or of the base itself below it; 0 if equal."""
    return F.when(value == base, F.lit(0.0)).otherwise((value - base) / F.when(value >= base, 1 - base).otherwise(base))


def outcome(gt: Column, pred: Column) -> Column:
    """TP, FP or FN from ids that are -1 where there is none."""
    return F.when((gt != -1) & (pred != -1), "TP").when(gt == -1, "FP").otherwise("FN")
