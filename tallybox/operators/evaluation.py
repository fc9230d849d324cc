"""Metrics, precision-recall curves, thresholds and costs over the match table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybox.functions import metrics
from tallybox.operators.ordered import scan


def outcome_counts(matches: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn per group."""
    n = lambda k: F.count_if(F.col("result") == k).alias(k.lower())
    return matches.groupBy(*by).agg(n("TP"), n("FP"), n("FN"))


def precision_recall(matches: DataFrame, *by: str, empty: float | None = None) -> DataFrame:
    c = outcome_counts(matches, *by)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*by, metrics.precision(tp, fp, empty).alias("precision"), metrics.recall(tp, fn, empty).alias("recall"), metrics.f1(tp, fp, fn).alias("f1"), (tp + fn).alias("n_instances"))


def pr_curve(detections: DataFrame, positives: DataFrame, *by: str) -> DataFrame:
    """Running precision and recall of detections (by, conf, ann_id, tp) by falling confidence.

    positives: (by, n_gt). Ties follow the id. A group of any size is ordered in many ranges.
    """
    run = scan(detections.withColumn("low_", -F.col("conf")), list(by), ["low_", "ann_id"], {"tps": F.col("tp"), "seen": F.lit(1)})
    return run.join(positives, list(by)).select(*by, "ann_id", "conf", (F.col("tps") / F.col("n_gt")).alias("recall"), (F.col("tps") / F.col("seen")).alias("precision"))


def trapezoid(points: DataFrame, *by: str, x: str = "x", y: str = "y") -> DataFrame:
    """Area under y(x) per group; of equal x the largest y counts. One point has no area."""
    top = scan(points.groupBy(*by, x).agg(F.max(y).alias(y)), list(by), [x], lags={"x_": x, "y_": y})
    dx, mean = F.col(x) - F.col("x_"), (F.col(y) + F.col("y_")) / 2
    return top.withColumn("part", F.coalesce(dx * mean, F.lit(0.0))).groupBy(*by).agg(F.sum("part").alias("area"))


def average_precision(matches: DataFrame, thresholds: list[int], by: str = "dataset", mode: str = "standard", bins: int = 1_000) -> DataFrame:
    """(by, t, ap): area under the curve per group and IoU threshold (in hundredths).

    standard: a match below the threshold is a false positive and a missed instance.
    compat: rows below the threshold are dropped unless they are missed instances, so
    false positives vanish and precision is 1.

    The curve has a point for each hit, the k-th of which has the recall k / n and the
    precision k / (detections so far), and starts at precision 0 if a false positive
    leads. So the area needs but a few sums over the hits, for all thresholds at once.
    Detections are counted by bins of confidence, summed from the top, and ordered within
    their bin only.
    """
    steps = sorted(thresholds)
    hit = [(F.col("idx_1") != -1) & (F.col("idx_2") != -1) & (F.col("iou") >= t / 100) for t in steps]
    found = F.col("idx_2") != -1

    def long(df: DataFrame, area: Callable[[Column], Column]) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), area(F.col(f"s{t}")).alias("ap")) for t in steps)))
        return df.select(by, each.alias("e")).select(by, "e.t", "e.ap").where("ap IS NOT NULL")

    if mode == "compat":
        some = [F.struct(F.count_if(h).alias("k")).alias(f"s{t}") for t, h in zip(steps, hit, strict=True)]
        counted = matches.groupBy(by).agg(F.count_if(~found).alias("missed"), *some)
        return long(counted, lambda s: F.when(s["k"] > 0, (s["k"] - 1) / (s["k"] + F.col("missed"))))

    n_gt = matches.groupBy(by).agg(F.count_if(F.col("idx_1") != -1).alias("n_gt"))
    rows = matches.where(found).select(by, "conf2", "idx_2", F.floor(F.col("conf2") * bins).alias("bin"), *(h.cast("int").alias(f"h{t}") for t, h in zip(steps, hit, strict=True)))
    counted = rows.groupBy(by, "bin").agg(F.count("*").alias("n"), *(F.sum(f"h{t}").alias(f"h{t}") for t in steps))
    above = Window.partitionBy(by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select(by, "bin", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"b_{c}") for c in ["n", *(f"h{t}" for t in steps)]))
    inside = Window.partitionBy(by, "bin").orderBy(F.desc("conf2"), "idx_2")
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(before, [by, "bin"]).select(by, *(f"h{t}" for t in steps), (F.col("b_n") + F.row_number().over(inside)).alias("seen"), *((F.col(f"b_h{t}") + F.sum(f"h{t}").over(run)).alias(f"k{t}") for t in steps))

    def sums(t: int) -> Column:
        at = F.when(F.col(f"h{t}") == 1, F.col("seen"))
        return F.struct(F.sum(F.col(f"k{t}") / at).alias("p"), F.sum(f"h{t}").alias("k"), F.min(at).alias("first"), F.max(at).alias("last")).alias(f"s{t}")

    def area(s: Column) -> Column:
        ends = F.when(s["first"] > 1, 0.0).otherwise(1 / s["first"]) + s["k"] / s["last"]
        return F.when(s["k"] > 0, (s["p"] - ends / 2) / F.col("n_gt")).otherwise(0.0)

    return long(placed.groupBy(by).agg(*map(sums, steps)).join(n_gt, by), area)


def best_threshold(rows: DataFrame, label: Column, conf: Column, *by: str, steps: int = 100) -> DataFrame:
    """Confidence cut with the best F1 of conf >= cut against a label; the lowest of equals.

    Confidences are counted by the cuts they reach, then summed from the top: one pass
    over the rows whatever the number of cuts.
    """
    reach = F.floor(F.coalesce(conf, F.lit(0.0)) * steps + 1e-9).cast("int")
    counted = rows.groupBy(*by, reach.alias("k")).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("n"))
    grid = counted.select(*by).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    w = Window.partitionBy(*by).orderBy(F.desc("k"))
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    full = grid.join(counted, [*by, "k"], "left").na.fill(0, ["p", "n"])
    full = full.withColumn("tp", F.sum("p").over(up)).withColumn("fp", F.sum("n").over(up)).withColumn("fn", F.sum("p").over(every) - F.col("tp"))
    scored = full.withColumn("f1", metrics.f1(F.col("tp"), F.col("fp"), F.col("fn")))
    return scored.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("k")).alias("low"))).alias("best")).select(*by, (-F.col("best.low") / steps).alias("threshold"), F.col("best.f1").alias("f1"))


def costs_at(matches: DataFrame, cut: Column, *by: str) -> DataFrame:
    """cost_f1 and cost_iou if detections below the cut had not been made."""
    below = (F.col("idx_2") != -1) & (F.col("conf2") < cut)
    kept = matches.where(~(below & (F.col("idx_1") == -1)) | F.col("conf2").isNull()).withColumn("below", F.coalesce(below, F.lit(False)))
    iou = F.when(F.col("below"), F.lit(0.0)).otherwise(F.col("iou"))
    tp = F.count_if(~F.col("below") & (F.col("idx_1") != -1) & (F.col("idx_2") != -1))
    wrong = F.count_if(~F.col("below") & (F.col("idx_1") == -1))
    missed = F.count_if(F.col("below") | (F.col("idx_2") == -1))
    out = kept.groupBy(*by).agg(tp.alias("tp"), wrong.alias("fp"), missed.alias("fn"), F.avg(1 - iou).alias("cost_iou"))
    return out.select(*by, (1 - metrics.f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("cost_f1"), "cost_iou")
