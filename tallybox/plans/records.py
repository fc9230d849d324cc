"""Queries over names, labels, nested tables, weights, orders and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybox.functions import boxes, contours, metrics, names
from tallybox.operators import evaluation as E
from tallybox.operators import naming, reshape, spatial
from tallybox.operators import statistics as S
from tallybox.operators.ordered import numbered
from tallybox.operators.work import folder, written
from tallybox.plans.analysis import RUNS, _octagons, _points, _runs
from tallybox.plans.detection import _ap_sql, rounded
from tallybox.plans.tables import MATCHES, Tables, query


@query("SELECT event_type, count(*) AS trials, round(min(value), 6) AS best FROM events GROUP BY event_type")
def append_log(t: Tables) -> DataFrame:
    """A log table that grows by appends, one for each part of the day, and is read as one."""
    path = folder(t.spark, "log")
    e = t("events").withColumn("part", F.hour("ts") % 3)
    for k in range(3):
        e.where(F.col("part") == k).drop("part").write.mode("append").parquet(path)
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("trials"), F.round(F.min("value"), 6).alias("best"))


@query("SELECT DISTINCT coalesce(lft || '_' || rgt, 'FULL') AS run, coalesce(lft, '') AS lft, coalesce(rgt, '') AS rgt FROM cube", RUNS)
def run_name_parts(t: Tables) -> DataFrame:
    """Left and right datasets parsed out of run names; the full run has neither."""
    run = _runs(t).select(F.coalesce(F.concat_ws("_", "lft", "rgt"), F.lit("")).alias("r")).select(F.when(F.col("r") == "", "FULL").otherwise(F.col("r")).alias("run")).distinct()
    a, b = names.left_out_pair(F.col("run"))
    return run.select("run", a.alias("lft"), b.alias("rgt"))


@query("SELECT short, len(list(f1)) AS n, round(list_max(list(f1)), 6) AS top FROM cube GROUP BY short", RUNS)
def nested_runs(t: Tables) -> DataFrame:
    """Runs nested as an array of structs per dataset, then unnested."""
    nested = _runs(t).groupBy("short").agg(F.collect_list(F.struct("lft", "rgt", "f1")).alias("runs"))
    flat = nested.select("short", F.size("runs").alias("n"), F.explode("runs").alias("r"))
    return flat.groupBy("short", "n").agg(F.round(F.max("r.f1"), 6).alias("top"))


@query("WITH w AS (SELECT dataset, image_id, ln(1 + count(*)) AS w FROM gt GROUP BY ALL) SELECT dataset, image_id, round(w / avg(w) OVER (PARTITION BY dataset), 6) AS weight FROM w")
def group_mean_weights(t: Tables) -> DataFrame:
    w = t.gt.groupBy("dataset", "image_id").agg(F.log(1 + F.count("*")).alias("w"))
    return w.select("dataset", "image_id", F.round(F.col("w") / F.avg("w").over(Window.partitionBy("dataset")), 6).alias("weight"))


@query("WITH c AS (SELECT dataset, min(image_id)::VARCHAR AS example FROM images GROUP BY dataset) SELECT file_name, c.dataset, example FROM images JOIN c ON contains(file_name, c.dataset) AND contains(file_name, example)")
def substring_join(t: Tables) -> DataFrame:
    """Files whose name holds a dataset's name and that of its example image."""
    examples = t.images.groupBy("dataset").agg(F.min("image_id").cast("string").alias("example"))
    found = naming.holding_both(t.images.select(F.col("file_name").alias("holder")), examples, "dataset", "example")
    return found.select(F.col("holder").alias("file_name"), "dataset", "example")


@query("SELECT DISTINCT 'fb_' || ['L', 'M', 'S', 'N'][1 + l_suppkey % 4] || '_s' || (l_partkey % 5) || CASE WHEN l_orderkey % 2 = 0 THEN '_finetuned' ELSE '' END AS run, ['L', 'M', 'S', 'N'][1 + l_suppkey % 4] AS size, 's' || (l_partkey % 5) AS left_out, CASE WHEN l_orderkey % 2 = 0 THEN 'After' ELSE 'Before' END AS stage FROM lineitem", "one AS (SELECT 1)")
def run_name_sizes(t: Tables) -> DataFrame:
    """Model size, left-out dataset and stage of fine-tuning, out of run names."""
    size = F.element_at(F.array(*map(F.lit, "LMSN")), (F.col("l_suppkey") % 4 + 1).cast("int"))
    run = F.concat(F.lit("fb_"), size, F.lit("_s"), (F.col("l_partkey") % 5).cast("string"), F.when(F.col("l_orderkey") % 2 == 0, "_finetuned").otherwise(""))
    runs = t("lineitem").select(run.alias("run")).distinct()
    return runs.select("run", names.model_size(F.col("run")).alias("size"), names.left_out(F.col("run")).alias("left_out"), names.tuning_stage(F.col("run")).alias("stage"))


@query("SELECT image_id, dataset || '_' || image_id AS sample FROM images")
def sample_keys(t: Tables) -> DataFrame:
    """The sample that a result file belongs to, out of its name."""
    files = t.images.select("image_id", F.concat(F.lit("run1_"), F.regexp_replace("file_name", r"\.jpg$", ""), F.when(F.col("image_id") % 2 == 0, ".csv").otherwise("_heatmap.png")).alias("file"))
    return files.select("image_id", names.sample_key(F.col("file")).alias("sample"))


@query("SELECT short, coalesce(lft, '-') AS lft, row_number() OVER (PARTITION BY short ORDER BY CASE lft WHEN 's4' THEN 0 WHEN 's2' THEN 1 WHEN 's0' THEN 2 ELSE 3 END, lft, rgt) AS place FROM cube WHERE lft IS NOT NULL", RUNS)
def ordered_levels(t: Tables) -> DataFrame:
    """Rows in the order of given levels, as a rank column beside the text."""
    level = F.coalesce(F.array_position(F.array(*map(F.lit, ("s4", "s2", "s0"))), F.col("lft")), F.lit(0))
    rank = F.when(level == 0, 3).otherwise(level - 1)
    w = Window.partitionBy("short").orderBy(rank, "lft", "rgt")
    return _runs(t).where("lft IS NOT NULL").select("short", F.coalesce("lft", F.lit("-")).alias("lft"), F.row_number().over(w).alias("place"))


@query("SELECT o_orderpriority, printf('%.3f [%.3f, %.3f]', round(quantile_cont(o_totalprice, 0.5)), round(min(o_totalprice)), round(max(o_totalprice))) AS label FROM orders GROUP BY 1")
def interval_labels(t: Tables) -> DataFrame:
    middle = S.exact_quantiles(t("orders"), "o_totalprice", (0.0, 0.5, 1.0), "o_orderpriority")
    o = middle.select("o_orderpriority", *(F.round(F.col("q")[k]).alias(c) for k, c in enumerate("ayb")))
    return o.select("o_orderpriority", names.interval_text(F.col("y"), F.col("a"), F.col("b")).alias("label"))


@query("SELECT c_custkey, regexp_replace(c_name, '#0*', ' ') AS name, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS segment FROM customer")
def catalogue_cleaning(t: Tables) -> DataFrame:
    """Columns by name pattern and without values go, texts are tidied, gaps become a dash."""
    c = t("customer").withColumns({"_tmp": F.lit(1), "empty": F.lit(None).cast("string")})
    c = reshape.without_empty_columns(c, "^_")
    return c.select("c_custkey", F.regexp_replace("c_name", "#0*", " ").alias("name"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("-")).alias("segment"))


@query("SELECT ann_id FROM gt WHERE (least(0.5 * x2, 600.0) - greatest(0.5 * x1, 0.0)) * (least(0.5 * y2, 400.0) - greatest(0.5 * y1, 0.0)) / (0.25 * (x2 - x1) * (y2 - y1)) >= 0.6 AND 0.5 * x1 < 600 AND 0.5 * y1 < 400")
def transformed_candidates(t: Tables) -> DataFrame:
    """Boxes that keep enough of their area after a transform and a cut to the frame."""
    m = [F.lit(v) for v in (0.5, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 1.0)]
    b = t.gt.select("ann_id", *(F.col(s).alias(f"o_{s}") for s in boxes.SIDES), contours.projected(_points("x1, y1", "x2, y1", "x2, y2", "x1, y2"), m).alias("p"))
    b = b.select("ann_id", *(F.col(f"o_{s}") for s in boxes.SIDES), *(c.alias(f"a_{s}") for s, c in contours.bounds(F.col("p")).items()))
    w = b.withColumns({"b_x1": F.lit(0.0), "b_y1": F.lit(0.0), "b_x2": F.lit(600.0), "b_y2": F.lit(400.0)})
    return w.where(boxes.intersection("a_", "b_") / boxes.area("a_") >= 0.6).select("ann_id")


@query("SELECT ann_id, 3000 - x2 AS x1, 3000 - x1 AS x2, y1 FROM gt")
def flip_contours(t: Tables) -> DataFrame:
    p = F.transform(F.col("points"), lambda v: F.struct((3000 - v["x"]).alias("x"), v["y"].alias("y")))
    b = contours.bounds(F.col("q"))
    return _octagons(t.gt).select("ann_id", p.alias("q")).select("ann_id", b["x1"].alias("x1"), b["x2"].alias("x2"), b["y1"].alias("y1"))


@query(_ap_sql("range(50, 96, 5)", "standard") + ", a AS (SELECT dataset, t, sum(part) AS ap FROM d GROUP BY ALL) SELECT dataset, round(0.1 * max(ap) FILTER (t = 50) + 0.9 * avg(ap), 6) AS fitness FROM a GROUP BY dataset", MATCHES)
def fitness_score(t: Tables) -> DataFrame:
    """Fitness of average precision: at an overlap of 0.5, and its mean over 0.5, 0.55, ... 0.95."""
    ap = E.average_precision(t.matches, list(range(50, 96, 5)))
    m = ap.groupBy("dataset").agg(F.max(F.when(F.col("t") == 50, F.col("ap"))).alias("a"), F.avg("ap").alias("b"))
    return m.select("dataset", F.round(metrics.fitness(F.col("a"), F.col("b")), 6).alias("fitness"))


@query("""WITH c AS (SELECT 'g' AS k, image_id, ann_id, (x1 + 8) // 4 AS x1, (y1 + 8) // 4 AS y1, (x2 + 8) // 4 AS x2, (y2 + 8) // 4 AS y2 FROM gt UNION ALL SELECT 'p', image_id, ann_id, (x1 + 8) // 4, (y1 + 8) // 4, (x2 + 8) // 4, (y2 + 8) // 4 FROM pred),
r AS (SELECT k, image_id, ann_id, y, x1 + 1 - least(y - y1, y2 - y, 1) AS x0, x2 - 1 + least(y - y1, y2 - y, 1) AS x1 FROM (SELECT *, unnest(range(y1, y2 + 1)) AS y FROM c)),
n AS (SELECT k, ann_id, sum(x1 - x0 + 1) AS n FROM r GROUP BY ALL),
i AS (SELECT a.ann_id AS g, b.ann_id AS p, sum(least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1) AS i FROM r a JOIN r b ON a.k = 'g' AND b.k = 'p' AND a.image_id = b.image_id AND a.y = b.y AND least(a.x1, b.x1) >= greatest(a.x0, b.x0) GROUP BY ALL)
SELECT g AS idx_1, p AS idx_2, round(i / (a.n + b.n - i), 6) AS iou FROM i JOIN n a ON a.k = 'g' AND a.ann_id = g JOIN n b ON b.k = 'p' AND b.ann_id = p""")
def contour_iou(t: Tables) -> DataFrame:
    """Intersection over union of contours in mask cells."""
    s = spatial.contour_intersections(spatial.with_rows(_octagons(t.gt, 1, 4)), spatial.with_rows(_octagons(t.pred, 1, 4)))
    return s.select(F.col("a_ann_id").alias("idx_1"), F.col("b_ann_id").alias("idx_2"), F.round(F.col("pixels") / (F.col("a_pixels") + F.col("b_pixels") - F.col("pixels")), 6).alias("iou"))


#: An L and a U out of a box: the corner or the middle of the upper side is cut out, the border stays. Rows as spans, by y.
L_ROWS = "SELECT ann_id, image_id, 'L' AS shape, y, x1 AS x0, CASE WHEN y <= y1 + (y2 - y1) // 2 THEN x1 + (x2 - x1) // 2 ELSE x2 END AS x1 FROM (SELECT *, unnest(range(y1, y2 + 1)) AS y FROM gt)"
# the gap of the U is open between its legs above the cut; its bottom edge is border
U_ROWS = """SELECT ann_id, image_id, 'U' AS shape, y, x1 AS x0, CASE WHEN y < y1 + (y2 - y1) // 2 THEN x1 + (x2 - x1) // 3 ELSE x2 END AS x1 FROM (SELECT *, unnest(range(y1, y2 + 1)) AS y FROM gt)
UNION ALL SELECT ann_id, image_id, 'U', y, x2 - (x2 - x1) // 3, x2 FROM (SELECT *, unnest(range(y1, y1 + (y2 - y1) // 2)) AS y FROM gt)"""
#: The row of the L's inner edge reaches over the whole box.
CONCAVE = f"SELECT ann_id, image_id, shape, y, x0, CASE WHEN shape = 'L' AND y = y1 + (y2 - y1) // 2 THEN x2 ELSE r.x1 END AS x1 FROM ({L_ROWS} UNION ALL {U_ROWS}) r JOIN (SELECT ann_id, y1, x2, y2 FROM gt) g USING (ann_id)"


def _concave(t: Tables) -> DataFrame:
    """Every box as an L and as a U."""
    cx, cy, third = "x1 + (x2 - x1) div 2", "y1 + (y2 - y1) div 2", "(x2 - x1) div 3"
    shapes = {
        "L": _points("x1, y1", f"{cx}, y1", f"{cx}, {cy}", f"x2, {cy}", "x2, y2", "x1, y2"),
        "U": _points("x1, y1", f"x1 + {third}, y1", f"x1 + {third}, {cy}", f"x2 - {third}, {cy}", f"x2 - {third}, y1", "x2, y1", "x2, y2", "x1, y2"),
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("shape"), p.alias("points")) for k, p in shapes.items())))
    return t.gt.select("ann_id", "image_id", each.alias("s")).select("ann_id", "image_id", "s.shape", "s.points")


@query(f"WITH s AS ({CONCAVE}) SELECT ann_id, shape, sum(x1 - x0 + 1)::BIGINT AS pixels, min(x0) AS x1, min(y) AS y1, max(x1) AS x2, max(y) AS y2 FROM s GROUP BY ann_id, shape")
def concave_contours(t: Tables) -> DataFrame:
    """Filled pixels of concave contours, and boxes out of their filled rows."""
    own = _concave(t).select("ann_id", "shape", contours.filled(F.col("points")).alias("f"))
    return own.select("ann_id", "shape", "f.pixels", *(f"f.{s}" for s in boxes.SIDES))


@query(f"WITH s AS ({CONCAVE}), n AS (SELECT ann_id, shape, sum(x1 - x0 + 1) AS n, sum(greatest(0, least(x1, 1199) - greatest(x0, 400) + 1)) FILTER (y >= 300 AND y < 1000) AS v FROM s GROUP BY ann_id, shape) SELECT ann_id, shape, round(v / n, 6) AS visible FROM n WHERE v / n >= 0.5")
def visible_contours(t: Tables) -> DataFrame:
    """Contours of whose filled area at least half lies in a window, and that share."""
    own = _concave(t).select("ann_id", "shape", contours.filled(F.col("points")).alias("f"))
    inside = contours.pixels_in_window(F.col("f.rectangles"), F.lit(400), F.lit(300), F.lit(1200), F.lit(1000))
    # written, so that contours aren't filled once for the filter and once for the share
    counted = written(own.select("ann_id", "shape", F.col("f.pixels").alias("pixels"), inside.alias("inside")), "visible")
    seen = counted.select("ann_id", "shape", (F.col("inside") / F.col("pixels")).alias("visible"))
    return rounded(seen.where("visible >= 0.5"), "visible")


CELLS_U = "SELECT image_id, ann_id, y, x1 AS x0, CASE WHEN y < y1 + (y2 - y1) // 2 THEN x1 + (x2 - x1) // 3 ELSE x2 END AS x1 FROM (SELECT *, unnest(range(y1, y2 + 1)) AS y FROM {0}) UNION ALL SELECT image_id, ann_id, y, x2 - (x2 - x1) // 3, x2 FROM (SELECT *, unnest(range(y1, y1 + (y2 - y1) // 2)) AS y FROM {0})"


@query(f"""WITH cg AS (SELECT image_id, ann_id, (x1 + 32) // 16 AS x1, (y1 + 32) // 16 AS y1, (x2 + 32) // 16 AS x2, (y2 + 32) // 16 AS y2 FROM gt), cp AS (SELECT image_id, ann_id, (x1 + 32) // 16 AS x1, (y1 + 32) // 16 AS y1, (x2 + 32) // 16 AS x2, (y2 + 32) // 16 AS y2 FROM pred),
g AS ({CELLS_U.format('cg')}), p AS ({CELLS_U.format('cp')}), gc AS (SELECT image_id, ann_id, y, unnest(range(x0, x1 + 1)) AS x FROM g), pc AS (SELECT image_id, ann_id, y, unnest(range(x0, x1 + 1)) AS x FROM p),
gu AS (SELECT DISTINCT * FROM gc), pu AS (SELECT DISTINCT * FROM pc), ng AS (SELECT ann_id, count(*) AS n FROM gu GROUP BY 1), np AS (SELECT ann_id, count(*) AS n FROM pu GROUP BY 1),
i AS (SELECT gu.ann_id AS g, pu.ann_id AS p, count(*) AS n FROM gu JOIN pu ON gu.image_id = pu.image_id AND gu.y = pu.y AND gu.x = pu.x GROUP BY ALL)
SELECT g AS idx_1, p AS idx_2, i.n AS cells, round(i.n / (ng.n + np.n - i.n), 6) AS iou FROM i JOIN ng ON ng.ann_id = g JOIN np ON np.ann_id = p""")
def concave_iou(t: Tables) -> DataFrame:
    """Shared cells and intersection over union of concave contours (a U out of each box, in cells of 16 pixels)."""
    third, cy = "(x2 - x1) div 3", "y1 + (y2 - y1) div 2"
    shape = _points("x1, y1", f"x1 + {third}, y1", f"x1 + {third}, {cy}", f"x2 - {third}, {cy}", f"x2 - {third}, y1", "x2, y1", "x2, y2", "x1, y2")
    made = lambda df: spatial.with_rows(df.withColumns({s: F.floor((F.col(s) + 32) / 16) for s in boxes.SIDES}).select("image_id", "ann_id", shape.alias("points")))
    s = spatial.contour_intersections(made(t.gt), made(t.pred), cell=32)
    return s.select(F.col("a_ann_id").alias("idx_1"), F.col("b_ann_id").alias("idx_2"), F.col("pixels").alias("cells"), F.round(F.col("pixels") / (F.col("a_pixels") + F.col("b_pixels") - F.col("pixels")), 6).alias("iou"))


@query("WITH w AS (SELECT dataset, image_id, avg(iou) AS v FROM matches WHERE result = 'TP' GROUP BY ALL), q AS (SELECT dataset, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM w GROUP BY dataset), o AS (SELECT w.dataset, image_id, v FROM w JOIN q ON w.dataset = q.dataset WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) SELECT dataset, image_id, (row_number() OVER (PARTITION BY dataset ORDER BY v, image_id) % 2)::INT AS side FROM o", MATCHES)
def alternating_outliers(t: Tables) -> DataFrame:
    """Outlying images, labelled left and right in turn."""
    v = t.hits.groupBy("dataset", "image_id").agg(F.avg("iou").alias("v"))
    out = S.outlier_flag(v, "v", "dataset").where("outlier")
    return numbered(out, ["v", "image_id"], "dataset", name="n").select("dataset", "image_id", ((F.col("n") + 1) % 2).cast("int").alias("side"))


@query("WITH a AS (SELECT dataset, sqrt(area_1::DOUBLE) AS x, iou AS y FROM matches WHERE result = 'TP'), m AS (SELECT dataset, x, max(y) AS y FROM a GROUP BY ALL), d AS (SELECT dataset, coalesce((x - lag(x) OVER w) * ((y + lag(y) OVER w) / 2), 0.0) AS p FROM m WINDOW w AS (PARTITION BY dataset ORDER BY x)) SELECT dataset, round(sum(p), 4) AS area FROM d GROUP BY dataset", MATCHES)
def trapezoid_area(t: Tables) -> DataFrame:
    """Area under a curve; of equal x the largest y counts."""
    a = t.matches.where("result = 'TP'").select("dataset", F.sqrt(F.col("area_1").cast("double")).alias("x"), F.col("iou").alias("y"))
    return E.trapezoid(a, "dataset").withColumn("area", F.round("area", 4))


@query("WITH s AS (SELECT dataset, floor(log10(area_1) / 0.1)::INT AS bin, count(*) AS n FROM matches WHERE result <> 'FP' GROUP BY ALL) SELECT dataset, bin, n, round(sum(n) OVER (PARTITION BY dataset ORDER BY bin) / sum(n) OVER (PARTITION BY dataset), 6) AS below FROM s", MATCHES)
def log_area_histogram(t: Tables) -> DataFrame:
    s = t.matches.where("result <> 'FP'").groupBy("dataset", F.floor(F.log10("area_1") / 0.1).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("dataset")
    return rounded(s.withColumn("below", F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w)), "below")
