"""Documents of bounded size, their metadata, match tables with shapes, and prediction files as a stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallybox.operators import matching
from tallybox.sources import documents
from tallybox.streaming import jobs


@pytest.fixture(scope="module")
def coco(spark):
    images = [(d, i, 100, 80, f"{d}_{i}.jpg") for d, n in (("a", 40), ("b", 3)) for i in range(1, n + 1)]
    notes = [(d, 1_000 * i + k, i, 1, 2, 3, 4, 0.5) for d, i, *_ in images for k in range(30 if i == 7 else i % 4)]
    return spark.createDataFrame(images, "dataset string, id int, width int, height int, file_name string"), spark.createDataFrame(notes, "dataset string, id bigint, image_id int, x int, y int, w int, h int, conf double"), images, notes


def test_documents_are_bounded_and_whole(spark, tmp_path, coco):
    images, notes, image_rows, note_rows = coco
    manifest = documents.write_coco(images, notes, f"file://{tmp_path}/c", most=10).collect()
    i, a, kinds = documents.read_coco(spark, f"file://{tmp_path}/c")
    assert sorted((r["id"], r["file_name"]) for r in i.collect()) == sorted((r[1], r[4]) for r in image_rows)
    assert sorted(r["id"] for r in a.collect()) == sorted(r[1] for r in note_rows)
    assert {r["name"] for r in kinds.collect()} == {"insect"}
    files = [json.loads(f.read_text()) for f in tmp_path.glob("c/**/part-*.json")]
    assert len(files) == len(manifest) > 8 and all(f.read_text().count("\n") == 1 for f in tmp_path.glob("c/**/part-*.json"))
    for f in files:
        assert len(f["images"]) + len(f["annotations"]) <= 10 + 31
        assert {n["image_id"] for n in f["annotations"]} <= {m["id"] for m in f["images"]}
        assert [m["id"] for m in f["images"]] == sorted(m["id"] for m in f["images"])
    assert sorted((len(f["images"]), len(f["annotations"])) for f in files) == sorted((r["n_images"], r["n_annotations"]) for r in manifest)


def test_small_documents_share_files_and_unpack_to_one_each(spark, tmp_path, coco):
    images, notes, image_rows, note_rows = coco
    at, to = f"file://{tmp_path}/c", f"file://{tmp_path}/d"
    manifest = documents.write_coco(images, notes, at, most=10, lines=True).collect()
    assert len(list(tmp_path.glob("c/**/part-*.json"))) <= int(spark.conf.get("spark.sql.shuffle.partitions")) < len(manifest)
    docs = [json.loads(x) for f in tmp_path.glob("c/part-*.json") for x in f.read_text().splitlines()]
    assert sorted((len(d["images"]), len(d["annotations"])) for d in docs) == sorted((r["n_images"], r["n_annotations"]) for r in manifest)
    i, a, _ = documents.read_coco(spark, at, lines=True)
    assert sorted((r["id"], r["file_name"]) for r in i.collect()) == sorted((r[1], r[4]) for r in image_rows)
    assert i.select("source").distinct().count() == len(manifest) == documents.read_metadata(spark, at, lines=True).select("source").distinct().count()
    documents.unpack_coco(spark, at, to)
    assert len(list(tmp_path.glob("d/**/part-*.json"))) == len(manifest)
    _, b, _ = documents.read_coco(spark, to)
    place = lambda df: sorted(map(tuple, df.select(F.regexp_extract("source", "dataset=[^/]+/shard=[^/]+/", 0), "id").collect()))
    assert place(a) == place(b) and sorted(k for _, k in place(a)) == sorted(r[1] for r in note_rows)


def test_metadata_goes_with_every_document(spark, tmp_path, coco):
    images, notes, *_ = coco
    each = spark.createDataFrame([(d, (f"of {d}",), [(0, d, "")]) for d in "ba"], "dataset string, info struct<description:string>, licenses array<struct<id:int,name:string,url:string>>")
    one = documents.first_metadata(each, "dataset", F.lit("b"))
    documents.write_coco(images.where("dataset = 'b'"), notes, f"file://{tmp_path}/c", most=2, metadata=one)
    got = documents.read_metadata(spark, f"file://{tmp_path}/c").collect()
    assert len(got) > 1 and {r["info"]["description"] for r in got} == {"of a"} and {r["licenses"][0]["name"] for r in got} == {"a"}


def test_match_rows_carry_shapes_and_both_confidences(spark, tmp_path):
    schema = "ann_id bigint, image_id bigint, dataset string, x1 bigint, y1 bigint, x2 bigint, y2 bigint, conf double, points array<struct<x:bigint,y:bigint>>"
    box = lambda i, x, c: (i, 1, "d", x, 0, x + 10, 10, c, [(x, 0), (x + 10, 10)])
    gt, pred = spark.createDataFrame([box(1, 0, 0.7), box(2, 500, None)], schema), spark.createDataFrame([box(3, 1, 0.9), box(4, 900, 0.4)], schema)
    m = matching.match_table(gt, pred, carry=("conf", "x1", "y1", "x2", "y2", "points"))
    documents.write_matches(documents.match_rows(m), f"file://{tmp_path}/m")
    got = {(r["idx_1"], r["idx_2"]): r for r in documents.read_matches(spark, f"file://{tmp_path}/m").collect()}
    assert got.keys() == {(1, 3), (2, -1), (-1, 4)}
    both = got[1, 3]
    assert (both["conf1"], both["conf2"], both["bbox_1"], both["bbox_2"]) == (0.7, 0.9, "[0,0,10,10]", "[1,0,11,10]") and json.loads(both["contour_2"]) == [[1, 0], [11, 10]]
    assert (got[2, -1]["conf1"], got[2, -1]["bbox_2"], got[2, -1]["contour_2"]) == (None, None, None) and got[-1, 4]["contour_1"] is None


def document(identifier, n=1, **other):
    d = {"boxes": [[k, 0, 9, 9] for k in range(n)], "contours": [[[1, 2], [3, 4]]] * n, "confs": [0.5] * n, "classes": [0] * n, "scales": [1.0] * n, "image_path": "a.jpg", "image_width": 9, "image_height": 9, "mask_width": 5, "mask_height": 5, "identifier": identifier}
    return json.dumps(d | other)


def test_faulty_empty_and_repeated_documents(spark, tmp_path):
    into = tmp_path / "in"
    into.mkdir()
    files = {"a": document("one", 2), "b": document("none", 0), "c": '{"boxes": [[1, 2', "d": document("two", 1, confs=[]), "e": document(None), "f": document("one", 1), "g": json.dumps({"identifier": "bare"})}
    for name, text in files.items():
        (into / f"{name}.json").write_text(text)
    at = {k: f"file://{tmp_path}/{k}" for k in ("rows", "faults", "state")}
    run = lambda: jobs.ingest_predictions(jobs.stream_predictions(spark, f"file://{into}", files_each=10), at["rows"], at["faults"], at["state"]).awaitTermination()
    run()
    assert sorted((r["identifier"], r["i"]) for r in jobs.ingested(spark, at["rows"]).collect()) == [("one", 0), ("one", 1)]
    faults = {r["file"][-6]: (r["fault"], r["text"] is not None) for r in spark.read.parquet(at["faults"]).collect()}
    assert faults == {"c": ("not a document", True), "d": ("arrays of unlike lengths", False), "e": ("no identifier", False), "g": ("no boxes", False)}
    (into / "h.json").write_text(document("one", 3))  # a later copy, and a new document
    (into / "i.json").write_text(document(["three"]))
    run()
    run()
    assert sorted((r["identifier"], r["i"]) for r in jobs.ingested(spark, at["rows"]).collect()) == [("one", 0), ("one", 1), ("three", 0)]


def test_path_index_and_file_lists(spark, tmp_path):
    for k in "cab":
        (tmp_path / f"{k}.csv").write_text("x")
    (tmp_path / "index.txt").write_text("/data/val/images/a.jpg\n\n  /data/b.PNG  \n")
    assert [r["path"] for r in documents.read_path_index(spark, f"file://{tmp_path}/index.txt").collect()] == ["/data/val/images/a.jpg", "/data/b.PNG"]
    assert [r["path"][-5:] for r in documents.list_files(spark, f"file://{tmp_path}", r"\.csv$", first=2).collect()] == ["a.csv", "b.csv"]


def test_label_shards_are_as_many_as_tasks_and_unpack_to_a_file_an_image(spark, tmp_path):
    points = F.array(*(F.struct((F.col("id") % 7 + k).alias("x"), F.lit(4 * k).alias("y")) for k in range(3)))
    rows = spark.range(600).select(F.expr("if(id % 5 = 0, 'val', 'train')").alias("split"), F.expr("cast(id div 2 as string)").alias("image"), F.lit(0).alias("class"), F.lit(16).alias("width"), F.lit(8).alias("height"), points.alias("points"))
    at, to = str(tmp_path / "shards"), str(tmp_path / "files")
    documents.write_yolo(rows, at)
    assert sum(f.endswith(".parquet") for _, _, names in os.walk(at) for f in names) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {(r["split"], r["image"]): r["n"] for r in documents.label_counts(spark, at).collect()}
    assert sum(got.values()) == 600 and ("val", "0") in got and ("train", "0") in got
    lines = documents.read_yolo(spark, at)
    assert [r["value"] for r in lines.where("image = '0' AND split = 'val'").collect()] == ["0 0.000000 0.000000 0.062500 0.500000 0.125000 1.000000"]
    documents.unpack_yolo(spark, at, to)
    assert sum(f.endswith(".txt") for _, _, names in os.walk(to) for f in names) == len(got)
    assert sorted(r[0] for r in spark.read.text(to).select("value").collect()) == sorted(r[0] for r in lines.select("value").collect())
