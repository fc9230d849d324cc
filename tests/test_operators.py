"""Small tables for the rules that decide results, and properties of the iterative operators."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybox.functions import boxes, contours, metrics, names
from tallybox.operators import evaluation, graph, matching, naming, reshape, resample, spatial, suppress, tiles
from tallybox.operators import statistics as S
from tallybox.plans.tables import Tables
from tallybox.sources import documents

BOX = "ann_id bigint, image_id bigint, dataset string, x1 bigint, y1 bigint, x2 bigint, y2 bigint, conf double"


def random_boxes(n, seed, images=3, side=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randrange(200), r.randrange(200)
        out.append((i, r.randrange(images), "d", x, y, x + r.randrange(10, side), y + r.randrange(10, side), r.randrange(20) / 20))
    return out


def iou(a, b):
    w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
    inter = max(0, w) * max(0, h)
    area = lambda p: (p[5] - p[3]) * (p[6] - p[4])
    return inter / (area(a) + area(b) - inter)


def test_matching_is_mutual_best_without_second_choices(spark):
    gt, pred = random_boxes(60, 1), random_boxes(80, 2)
    got = {(r["idx_1"], r["idx_2"]) for r in matching.match(spark.createDataFrame(gt, BOX), spark.createDataFrame(pred, BOX), 0.1).collect()}
    named = {}
    for p in pred:
        best = [(iou(g, p), -g[0]) for g in gt if g[1] == p[1] and iou(g, p) > 0]
        if best and max(best)[0] > 0.1:
            named.setdefault(-max(best)[1], []).append((max(best)[0], p[0]))
    assert got == {(g, max(c)[1]) for g, c in named.items()}


@pytest.mark.parametrize("seed", range(2))
def test_greedy_suppression_equals_the_plain_loop(spark, seed):
    rows = random_boxes(90, seed)
    kept = []
    for b in sorted(rows, key=lambda r: (-r[7], r[0])):
        if not any(k[1] == b[1] and iou(k, b) > 0.2 for k in kept):
            kept.append(b)
    df = spark.createDataFrame(rows, BOX)
    want = sorted(k[0] for k in kept)
    assert sorted(r["ann_id"] for r in suppress.nms(df, 0.2).collect()) == want
    assert sorted(r["ann_id"] for r in suppress.nms(df, 0.2, cell=50).collect()) == want
    for most in (0, 8):  # by rounds, and by components
        assert sorted(r["ann_id"] for r in suppress.nms(df, 0.2, most=most).collect()) == want
    one = sorted(b[0] for b in rows if not any(a[1] == b[1] and (-a[7], a[0]) < (-b[7], b[0]) and iou(a, b) > 0.2 for a in rows if a is not b))
    assert sorted(r["ann_id"] for r in suppress.one_pass_nms(df, 0.2).collect()) == one


def test_clusters_first_equal_the_plain_loops(spark):
    rows = random_boxes(120, 7, images=4)
    home = {b[0]: b[0] for b in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if a[1] == b[1] and iou(a, b) >= 0.05:
                    home[a[0]] = home[b[0]] = min(home[a[0]], home[b[0]])
        if all(home[a[0]] == home[b[0]] for a in rows for b in rows if a[1] == b[1] and iou(a, b) >= 0.05):
            break
    for least in (10, 30, 1_000):
        n = {i: sum(b[1] == i for b in rows) for i in range(4)}
        kept = []
        for b in sorted(rows, key=lambda r: (-r[7], r[0])):
            if not any(k[1] == b[1] and iou(k, b) > 0.2 and (n[b[1]] < least or home[k[0]] == home[b[0]]) for k in kept):
                kept.append(b)
        got = suppress.cluster_first_nms(spark.createDataFrame(rows, BOX), 0.2, least)
        assert sorted(r["ann_id"] for r in got.collect()) == sorted(k[0] for k in kept)


def test_margin_zero_suppresses_nothing(spark):
    df = spark.createDataFrame([(1, 1, "d", 0, 0, 9, 9, 0.5), (2, 1, "d", 0, 0, 9, 9, 0.4)], BOX)
    assert suppress.drop_near_equal(df, 0).count() == 2
    assert [r["ann_id"] for r in suppress.drop_near_equal(df, 1).collect()] == [1]


def test_grid_join_equals_plain_join(spark):
    a, b = spark.createDataFrame(random_boxes(120, 5, 1), BOX), spark.createDataFrame(random_boxes(120, 6, 1), BOX)
    pairs = lambda c: sorted((r["a_ann_id"], r["b_ann_id"]) for r in spatial.overlap_join(a, b, cell=c).collect())
    assert pairs(None) == pairs(32) == pairs(7)


def test_components_and_spanning_tree(spark):
    r = random.Random(2)
    edges = [(a, b, float(r.randrange(100))) for a in range(40) for b in range(a + 1, 40) if r.random() < 0.06]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    tree = []
    for a, b, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        x, y = sorted((find(a), find(b)))
        if x != y:
            root[y] = x
            tree.append((a, b, w))
    df = spark.createDataFrame(edges, "a bigint, b bigint, w double")
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == {x: find(x) for x in root}
    assert sorted(tuple(r) for r in graph.spanning_tree(df).select("a", "b", "w").collect()) == sorted(tree)


def test_empty_detections(spark):
    empty = spark.createDataFrame([], BOX)
    gt = spark.createDataFrame(random_boxes(3, 1), BOX)
    assert suppress.nms(empty, 0.2).collect() == []
    assert [r["result"] for r in matching.match_table(gt, empty).collect()] == ["FN"] * 3
    assert [r["result"] for r in matching.match_table(empty, gt).collect()] == ["FP"] * 3


def test_segments_cover_the_length(spark):
    df = spark.createDataFrame([(n, total, size) for total in (1000, 1024, 1500, 4001) for size in (250, 1024) for n in range(2, 9) if n * size >= total], "n int, total bigint, size int")
    for size in (250, 1024):
        rows = df.where(F.col("size") == size).withColumn("start", tiles.segment_start(F.col("n") - 1, F.col("n"), F.col("total"), size)).collect()
        assert all(r["start"] + size == r["total"] for r in rows)
    starts = spark.range(5).select(tiles.segment_start(F.col("id").cast("int"), F.lit(5), F.lit(1000), 250).alias("s")).collect()
    assert [r["s"] for r in starts] == [0, 187, 374, 562, 750]


def test_spans_fill_squares_and_triangles(spark):
    shapes = {"square": [(0, 0), (9, 0), (9, 9), (0, 9)], "point": [(3, 3), (3, 3), (3, 3)], "triangle": [(0, 0), (8, 0), (0, 8)], "line": [(0, 2), (6, 2), (6, 2)]}
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in v]) for k, v in shapes.items()], "name string, points array<struct<x:bigint,y:bigint>>")
    area = {r["name"]: r["n"] for r in contours.spans(df).groupBy("name").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n")).collect()}
    assert area == {"square": 100, "triangle": 45, "point": 1, "line": 7}


def test_flip_and_clamp(spark):
    b = spark.createDataFrame([(1, 1, "d", 10, 20, 30, 60, 0.5)], BOX)
    r = b.select(*(c.alias(s) for s, c in boxes.flipped(F.lit(100), "y").items())).first()
    assert (r["x1"], r["y1"], r["x2"], r["y2"]) == (10, 40, 30, 80)
    r = b.select(*(c.alias(s) for s, c in boxes.scaled_padded(F.lit(-8), F.lit(0), F.lit(1.0), F.lit(25), F.lit(25)).items())).first()
    assert (r["x1"], r["y1"], r["x2"], r["y2"]) == (0, 15, 24, 24)


def test_nothing_to_divide(spark):
    r = spark.range(1).select(metrics.precision(F.lit(0), F.lit(0)).alias("n"), metrics.precision(F.lit(0), F.lit(0), 1).alias("one"), metrics.f1(F.lit(0), F.lit(0), F.lit(0)).alias("f"), metrics.relative_change(F.lit(0.5), F.lit(0.5)).alias("c")).first()
    assert (r["n"], r["one"], r["f"], r["c"]) == (None, 1.0, 0.0, 0.0)


def test_average_precision_modes(spark):
    rows = [("d", 1, 1, 0.9, 0.8), ("d", 2, 2, 0.8, 0.4), ("d", -1, 3, 0.7, 0.0), ("d", 3, -1, None, 0.0)]
    df = spark.createDataFrame(rows, "dataset string, idx_1 bigint, idx_2 bigint, conf2 double, iou double")
    two = spark.createDataFrame([*rows, ("d", 4, 4, 0.6, 0.9)], df.schema)
    standard = evaluation.average_precision(two, [50]).first()["ap"]
    compat = evaluation.average_precision(two, [50], mode="compat").first()["ap"]
    assert standard == pytest.approx((0.5 - 0.25) * (1 + 0.5) / 2)
    assert compat == pytest.approx((2 / 3 - 1 / 3) * 1.0)


def test_lowest_of_equal_thresholds(spark):
    df = spark.createDataFrame([("d", True, 0.8), ("d", False, 0.3), ("d", True, None)], "g string, y boolean, c double")
    r = evaluation.best_threshold(df, F.col("y"), F.col("c"), "g").first()
    assert r["threshold"] == 0.0 and r["f1"] == pytest.approx(0.8)


def test_local_regression_keeps_a_line(spark):
    df = spark.createDataFrame([("g", i, float(i), 2.0 * i + 1) for i in range(30)], "g string, k int, x double, y double")
    rows = S.local_regression(df, "x", "y", "k", "g").collect()
    assert all(r["smooth"] == pytest.approx(2 * r["k"] + 1) for r in rows)


def test_quota_is_the_smallest_that_suffices(spark):
    sizes = [3, 50, 7, 7, 20]
    df = spark.createDataFrame([(f"g{k}",) for k, n in enumerate(sizes) for _ in range(n)], "g string")
    for most in (5, 20, 33, 34, 60, 86, 87, 200):
        q = max(sizes) if most >= sum(sizes) else next(q for q in range(most // 5, 99) if sum(min(q, n) for n in sizes) >= most)
        assert sorted(r["taken"] for r in resample.equal_quota(df, most, "g").collect()) == sorted(min(q, n) for n in sizes)


def test_split_is_stable(spark):
    r = spark.createDataFrame([("hello",)], "t string").select(resample.content_share(F.col("t")).alias("s")).first()
    assert r["s"] == int("5d41", 16) / 0xFFFF


def test_ids_and_mirror(spark):
    df = spark.createDataFrame([("b", 5), ("a", 9), ("a", 2)], "s string, k int")
    assert {(r["s"], r["k"]): r["id"] for r in reshape.dense_ids(df, "s", ["k"]).collect()} == {("a", 2): 1, ("a", 9): 2, ("b", 5): 3}
    m = reshape.mirrored(spark.createDataFrame([("a", "b", 1), ("a", "a", 2), (None, None, 3)], "l string, r string, v int"), "l", "r")
    assert sorted((r["l"] or "", r["r"] or "", r["v"]) for r in m.collect()) == [("", "", 3), ("a", "a", 2), ("a", "b", 1), ("b", "a", 1)]


def test_names(spark):
    df = spark.createDataFrame([("/x/val/images/00-partial-Bugs_1.JPG", "run_L_1", "a_s1_matches.csv")], "p string, r string, f string")
    f = names.path_features(F.col("p"))
    r = df.select(*(c.alias(k) for k, c in f.items()), names.model_size(F.col("r")).alias("m"), names.sample_key(F.col("f")).alias("s"), names.stem(F.col("p")).alias("stem")).first()
    assert tuple(r) == ("jpg", "val", "images", "Bugs", "L", "s1_matches", "00-partial-Bugs_1")  # the sample part is greedy


def test_a_real_shaped_document(spark, tmp_path):
    doc = '{"boxes": [[1,2,30,40],[5,6,70,80]], "contours": [[[1,2,3],[4,5,6]],[[7,8],[9,10]]], "confs": [0.9,0.8], "classes": [0,0], "scales": [1.0,0.5], "image_path": "a.jpg", "image_width": 100, "image_height": 90, "mask_width": 50, "mask_height": 45, "identifier": ["id1"]}'
    (tmp_path / "a.json").write_text(doc)
    rows = documents.read_predictions(spark, f"file://{tmp_path}/*.json").orderBy("i").collect()
    assert [(r["identifier"], r["i"], r["x2"], r["conf"], len(r["points"])) for r in rows] == [("id1", 0, 30, 0.9, 3), ("id1", 1, 70, 0.8, 2)]
    images, annotations = documents.predictions_to_coco(spark.read.schema(documents.PREDICTION).json(f"file://{tmp_path}/*.json", multiLine=True))
    assert [tuple(r) for r in images.select("id", "width", "height", "file_name").collect()] == [(1, 100, 90, "a.jpg")]
    first = annotations.orderBy("id").first()
    # 3 and 6 in a mask of 50 x 45 stand for 3 * 99 / 49 and 6 * 89 / 44 in the image
    assert (first["id"], first["image_id"], first["w"], first["h"]) == (0, 1, 29, 38) and first["segmentation"] == [2, 8, 4, 10, 6, 12]


def test_missing_metadata_raises(spark):
    rows, meta = spark.createDataFrame([("r1", 1), ("r2", 2)], "run string, n int"), spark.createDataFrame([("r1", "m")], "run string, model string")
    with pytest.raises(ValueError, match="r2"):
        documents.with_run_metadata(rows, meta)


def test_columns_without_values_go(spark):
    df = spark.createDataFrame([(1, None, 3, 4), (2, None, None, 5)], "a int, b int, c int, _x int")
    assert reshape.without_empty_columns(df, "^_").columns == ["a", "c"]


def test_tables_of_detections(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.gt.count() == 3010 and t.pred.count() == 3726


def test_names_that_hold_one_another(spark):
    from tallybox.operators import naming

    left = ["North Sea moths", "sea", "ants", "x", "", None, "Bees and wasps", "ÄPFEL"]
    right = ["SEA", "moths of the north sea", "Ants", "bees", "wasps", "xylo", "y", "apfel", "äpfel rot"]
    got = {r["name"]: r["match"] for r in naming.fuzzy_names(*(spark.createDataFrame([(n,) for n in names], "name string") for names in (left, right))).collect()}
    want = {}
    for a in {x for x in left if x is not None}:
        hits = {b for b in right if a and (a.lower() in b.lower() or b.lower() in a.lower())}
        want[a] = hits.pop() if len(hits) == 1 else None
    assert got == want


def test_average_precision_of_many_thresholds_by_points(spark):
    import random

    from tallybox.operators import evaluation

    random.seed(4)
    rows = [("d", *((k, k, random.random(), random.random()) if k % 4 else (-1, k, random.random(), 0.0))) for k in range(60)] + [("d", 100 + k, -1, None, 0.0) for k in range(7)] + [("e", 1, -1, None, 0.0)]
    df = spark.createDataFrame(rows, "dataset string, idx_1 int, idx_2 int, conf2 double, iou double")
    got = {(r["dataset"], r["t"]): r["ap"] for r in evaluation.average_precision(df, [30, 60, 90], bins=7).collect()}
    n = sum(r[1] != -1 for r in rows if r[0] == "d")
    for t in (30, 60, 90):
        best, tp = {}, 0
        for seen, r in enumerate(sorted((r for r in rows if r[0] == "d" and r[2] != -1), key=lambda r: (-r[3], r[2])), 1):
            tp += r[1] != -1 and r[4] >= t / 100
            best[tp / n] = max(best.get(tp / n, 0), tp / seen)
        points = sorted(best.items())
        want = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False))
        assert abs(got[("d", t)] - want) < 1e-9
    assert set(got) == {("d", t) for t in (30, 60, 90)}


def test_nearest_in_cells_equals_all_pairs(spark):
    import math
    import random

    from tallybox.operators import graph

    random.seed(2)
    rows = [(k % 3, k, random.uniform(-300, 300), random.uniform(-300, 300)) for k in range(120)]
    df = spark.createDataFrame(rows, "image_id int, ann_id int, x double, y double")
    got = {r["a"]: (r["b"], round(r["distance"], 9)) for r in graph.nearest(df, df, "image_id", "x", "y", "ann_id", 60.0).collect()}
    want = {}
    for g, k, x, y in rows:
        near = min((math.dist((x, y), (u, v)), j) for h, j, u, v in rows if h == g and j != k)
        if near[0] <= 60:
            want[k] = (near[1], round(near[0], 9))
    assert got == want


def test_names_meet_at_their_rarest_substring(spark):
    words = [f"nation_{k:03d}_x" for k in range(300)] + ["na", "n", "7", "", None, "zzz", "tion_007", "nation_"]
    names_ = spark.createDataFrame([(w,) for w in words], "holder string")
    met = naming._candidates(names_.where("holder IS NOT NULL").select(F.col("holder").alias("key"), F.col("holder").alias("text")).distinct(), names_.select(F.col("holder").alias("part")).where("length(part) > 3"))
    assert met.where("part <> 'nation_'").count() < 12 * 300  # 302 * 302 with their first three characters
    got = {(r["holder"], r["part"]) for r in naming.containing(names_, names_.withColumnRenamed("holder", "part")).collect()}
    known = [w for w in words if w]
    assert got == {(h, p) for h in known for p in known if p in h}


def test_identifiers_in_texts(spark):
    texts = spark.createDataFrame([(1, "see doi/10.1 and x"), (2, "doi/10.12"), (3, None), (4, ""), (1, "see doi/10.1 and x"), (5, "a b")], "id int, text string")
    ids = spark.createDataFrame([("doi/10.1",), ("doi/10.1",), ("b",), ("10.12",), ("none",), (None,), ("",)], "identifier string")
    assert sorted(map(tuple, naming.mentions(texts, ids).collect())) == [(1, "doi/10.1"), (2, "10.12"), (2, "doi/10.1"), (5, "b")]
    pairs = spark.createDataFrame([("doi", "10.12"), ("x", "see"), ("", "a")], "p string, q string")
    both = naming.holding_both(texts.select(F.col("text").alias("holder")), pairs, "p", "q")
    assert sorted(map(tuple, both.select("holder", "p", "q").collect())) == [("doi/10.12", "doi", "10.12"), ("see doi/10.1 and x", "x", "see")]


def test_few_identifiers_are_found_in_one_pass(spark, monkeypatch):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abé日 -") for _ in range(n))
    rows = [(k // 2, None if k % 17 == 0 else word(r.randrange(30))) for k in range(200)] + [(None, "ab"), (500, word(4_000))]
    parts = sorted({word(n) for n in (1, 1, 2, 2, 3, 4, 5, 6, 9)} | {"b", "é", "日a", "zzz"})
    want = {(i, p) for i, t in rows if i is not None and t for p in parts if p in t}
    texts, ids = spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame([(p,) for p in parts], "identifier string")
    assert {tuple(x) for x in naming.mentions(texts, ids, few=0).collect()} == want
    column = pa.array([t for _, t in rows if t is not None])
    for size in (1, 50, 1 << 20):  # a slice of the column, cut into pieces
        assert {(k, parts[p]) for k, p in naming.Finder(parts, size).pairs(column.slice(5, 90))} == {(k, p) for k, t in enumerate(column.to_pylist()[5:95]) for p in parts if p in t}
    monkeypatch.setattr(naming, "_candidates", None)  # no substrings of texts are spread to rows
    got = naming.mentions(texts, ids).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_components_within_groups_take_no_rounds(spark, monkeypatch):
    r = random.Random(5)
    edges = [(g, 100 * g + a, 100 * g + b) for g in range(6) for a in range(40) for b in range(a + 1, 40) if r.random() < 0.03]
    df = spark.createDataFrame(edges, "group bigint, a bigint, b bigint")
    want = {r["node"]: r["component"] for r in graph.components(df).collect()}
    rounds = []
    monkeypatch.setattr(graph, "components", lambda e, plain=graph.components: rounds.append(1) or plain(e))
    assert {r["node"]: r["component"] for r in graph.components_within(df).collect()} == want and not rounds
    assert {r["node"]: r["component"] for r in graph.components_within(df, most=22).collect()} == want and rounds


def test_spanning_trees_of_groups_equal_the_rounds(spark):
    r = random.Random(6)
    edges = [(g, 100 * g + a, 100 * g + b, float(r.randrange(30))) for g in range(4) for a in range(40) for b in range(a + 1, 40) if r.random() < 0.15 * (g + 1)]
    df = spark.createDataFrame(edges, "g bigint, a bigint, b bigint, w double")
    nodes = spark.createDataFrame([(g, 40 if g else 41) for g in range(4)], "g bigint, n bigint")
    want = sorted(tuple(x) for x in graph.spanning_tree(df).select("a", "b", "w").collect())
    for most in (500, 40):
        assert sorted(tuple(x) for x in graph.spanning_trees(df, nodes, each=30, most=most).select("a", "b", "w").collect()) == want


def test_cluster_first_suppression_makes_no_clusters(spark, monkeypatch):
    monkeypatch.setattr(suppress, "clusters", None)
    rows = [(1, k, float(k), 0.0, float(k) + 10, 10.0, k / 100) for k in range(12)]
    df = spark.createDataFrame(rows, "image_id bigint, ann_id bigint, x1 double, y1 double, x2 double, y2 double, conf double")
    assert {x["ann_id"] for x in suppress.cluster_first_nms(df, 0.2).collect()} == {x["ann_id"] for x in suppress.nms(df, 0.2).collect()}


def test_images_decided_at_once_keep_what_joined_pairs_keep(spark, monkeypatch):
    r = random.Random(0)
    rows = [(k, r.choice([None, 1, 2, 2, 2, 3]), "d", x := r.randrange(60), y := r.randrange(60), x + r.randrange(-2, 25), y + r.randrange(25), r.choice([None, 0.1, 0.5, 0.9])) for k in range(160)]
    df = spark.createDataFrame(rows, BOX).repartition(3)
    ids = lambda d: sorted(x["ann_id"] for x in d.collect())
    want = ids(suppress.nms(df, 0.2, whole=0)), ids(suppress.drop_near_equal(df, 6, whole=0))
    assert len(want[0]) < len(want[1]) < 160
    assert ids(suppress.nms(df, 0.2, whole=0, most=8)) == want[0]
    images = spark.createDataFrame([(i, 70, 60) for i in (1, 2, 3)], "image_id bigint, width int, height int")
    safe = sorted(map(tuple, tiles.merged(df, images, 6, 0.2, whole=0).collect()), key=repr)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # images lie across batches
    try:
        assert (ids(suppress.nms(df, 0.2, whole=40)), ids(suppress.drop_near_equal(df, 6, whole=40))) == want
        assert sorted(map(tuple, tiles.merged(df, images, 6, 0.2, whole=40).collect()), key=repr) == safe
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(suppress, "overlap_join", None)  # images of a usual size make no pairs in Spark
    assert ids(suppress.nms(df, 0.2)) == want[0] and ids(suppress.drop_near_equal(df, 6)) == want[1]
    assert sorted(map(tuple, tiles.merged(df, images, 6, 0.2).collect()), key=repr) == safe
