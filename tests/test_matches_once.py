"""Queries that use the match table more than once make it once."""

from pyspark.sql import functions as F

from tallybox.plans import analysis, detection, files, tables

SF = "/root/testdata/sf0.001"


def test_result_tables_make_the_matches_once(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a", 1, -1, "FN"), (2, "a", 2, 3, "TP"), (3, "b", -1, 4, "FP")], "image_id long, dataset string, idx_1 long, idx_2 long, result string")
    seen = spark.sparkContext.accumulator(0)

    def look(v):
        seen.add(1)
        return v

    made = rows.repartition(2).withColumn("result", F.udf(look, "string")("result"))
    monkeypatch.setattr(tables.Tables, "matches", property(lambda self: made))
    query = getattr(files.result_tables_from_names, "__wrapped__", files.result_tables_from_names)
    got = sorted(tuple(r) for r in query(tables.Tables(spark, SF)).collect())
    assert seen.value == 3
    assert got == [("a", "M", 1, 0), ("a", "S", 1, 1), ("b", "N", 1, 0)]


def test_curves_count_positives_without_the_matches(spark):
    plan = detection.pr_curve(tables.Tables(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "Outer" not in plan  # matches are an outer join


def test_matched_rows_are_those_of_the_match_table(spark):
    t = tables.Tables(spark, SF)
    want = t.matches.where("result = 'TP'").select("image_id", "dataset", "idx_1", "idx_2", "iou")
    assert sorted(map(tuple, t.hits.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (t.hits, analysis._per_image(t))]
    assert not any("Outer" in p for p in plans)


def test_shapes_are_not_carried_through_the_matches(spark, monkeypatch):
    carried = []
    monkeypatch.setattr(files, "match_table", lambda *a, plain=files.match_table, **k: carried.extend(k["carry"]) or plain(*a, **k))
    files.match_csv_with_shapes(tables.Tables(spark, SF))
    assert carried and "points" not in carried
