"""Matches found image by image equal those of joins, and an image's rows move once."""

import random
from collections import Counter

import pytest

from tallybox.operators import matching
from tallybox.sources import documents

BOX = "ann_id long, image_id long, dataset string, x1 long, y1 long, x2 long, y2 long, conf double"


def some_boxes(n, seed, first):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randrange(60), r.randrange(60)
        out.append((first + i, r.randrange(6), f"d{seed}", x, y, x + r.randrange(0, 40), y + r.randrange(5, 40), r.randrange(20) / 20))
    odd = [(first + n, None, "d", 0, 0, 9, 9, 0.5), (first + n + 1, 2, None, None, 0, 9, 9, 0.5), (first + n + 2, 2, "d", 30, 30, 10, 40, None), (first + n + 3, 50 + seed, "d", 0, 0, 9, 9, 0.5)]
    return [*out, *odd, *out[:3], (None, 5, "d", 10, 10, 40, 40, 0.1), (first, 3, "other", 20, 20, 50, 50, 0.2)]


@pytest.mark.parametrize("step", ["match", "matched", "match_table"])
def test_images_give_the_rows_of_joins(spark, step):
    gt, pred = (spark.createDataFrame(some_boxes(70, k, 1000 * k), BOX) for k in (1, 2))
    how = {"match_table": {"carry": ("conf", "x1", "dataset")}}.get(step, {})
    found = {whole: getattr(matching, step)(gt, pred, 0.1, whole=whole, **how) for whole in (0, 30, 1_000)}
    rows = {k: Counter(tuple(r) for r in df.collect()) for k, df in found.items()}
    assert rows[0] == rows[30] == rows[1_000] and sum(rows[0].values()) > 20
    assert len({str(df.dtypes) for df in found.values()}) == 1


def test_many_images_go_through_a_task_in_batches(spark, monkeypatch):
    monkeypatch.setattr(matching, "PAIRS", 50)
    monkeypatch.setattr(matching, "ROWS", 40)
    gt, pred = (spark.createDataFrame([(i, i // 7, "d", i % 7 * 20, 0, i % 7 * 20 + 10 + k, 10, 0.5) for i in range(3_000)], BOX) for k in (0, 1))
    got = matching.match_table(gt.coalesce(1), pred.coalesce(1)).collect()
    assert sorted((r["idx_1"], r["idx_2"], r["result"]) for r in got) == [(i, i, "TP") for i in range(3_000)]


def test_rows_move_once_by_image(spark):
    """One shuffle by image, no joins of pairs with all rows again."""
    gt, pred = (spark.createDataFrame(some_boxes(20, k, 1000 * k)[:20], BOX) for k in (1, 2))
    plan = matching.match_table(gt, pred, carry=("x1", "y1"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1


def test_other_numbers_than_integers_are_joined(spark):
    gt, pred = (spark.createDataFrame(some_boxes(40, k, 1000 * k), BOX) for k in (1, 2))
    real = [df.selectExpr("ann_id", "image_id", "dataset", *(f"cast({c} as double) as {c}" for c in ("x1", "y1", "x2", "y2")), "conf") for df in (gt, pred)]
    pairs = lambda g, p: sorted((r["idx_1"] or -1, r["idx_2"]) for r in matching.match(g, p).collect())
    assert pairs(*real) == pairs(gt, pred)


def test_match_rows_are_written_gzipped(spark, tmp_path):
    m = spark.createDataFrame([("1", 1, None), ("2", -1, 0.5)], "image string, idx_1 long, conf2 double")
    documents.write_matches(m, f"file://{tmp_path}/m")
    assert list(tmp_path.glob("m/part-*.csv.gz")) and not list(tmp_path.glob("m/part-*.csv"))
    assert sorted(map(tuple, documents.read_matches(spark, f"file://{tmp_path}/m", "image string, idx_1 bigint, conf2 double").collect())) == [("1", 1, None), ("2", -1, 0.5)]
