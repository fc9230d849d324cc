"""Detection tables derived from ``lineitem`` by integer arithmetic, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of a folder, and detections derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _base(self) -> DataFrame:
        e = F.expr
        return self("lineitem").select(
            e("((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey").alias("ann_id"),
            e("l_suppkey * 7 + (l_linenumber - 1)").alias("image_id"),
            e("concat('d', lpad(cast(l_suppkey % 23 as string), 2, '0'))").alias("dataset"),
            e("(l_partkey * 7919 + l_orderkey * 31) % 2000").alias("x1"),
            e("(l_orderkey * 10473 + l_partkey * 17) % 1400").alias("y1"),
            e("20 + cast(l_quantity as bigint) * 4").alias("w"),
            e("20 + cast(round(l_tax * 100) as bigint) * 20").alias("h"),
            e("(cast(round(l_extendedprice * 100) as bigint) % 1000) / 1000.0D").alias("conf"),
            "l_orderkey", "l_partkey", "l_linestatus", "l_returnflag",
        )

    @property
    def gt(self) -> DataFrame:
        return self._base().where("l_linestatus = 'F'").selectExpr("ann_id", "image_id", "dataset", "x1", "y1", "x1 + w as x2", "y1 + h as y2")

    @property
    def pred(self) -> DataFrame:
        made = self._base().where("(l_linestatus = 'F' and (l_orderkey + l_partkey) % 10 <> 0) or (l_linestatus = 'O' and l_returnflag = 'R')")
        return made.selectExpr(
            "ann_id", "image_id", "dataset", "x1 + l_partkey % 9 - 4 as x1", "y1 + l_orderkey % 9 - 4 as y1",
            "x1 + w + l_orderkey % 7 - 3 as x2", "y1 + h + l_partkey % 7 - 3 as y2", "conf",
        )

    @property
    def images(self) -> DataFrame:
        return self.gt.select("image_id", "dataset").distinct().withColumns({"width": F.expr("1600 + image_id % 13 * 100"), "height": F.expr("1200 + image_id % 7 * 100"), "file_name": F.expr("concat(dataset, '_', image_id, '.jpg')")})

    @property
    def matches(self) -> DataFrame:
        from tallybox.operators.matching import match_table

        return match_table(self.gt, self.pred)

    @property
    def hits(self) -> DataFrame:
        """The matched rows of ``matches``: image_id, dataset, idx_1, idx_2, iou."""
        from tallybox.operators.matching import matched

        return matched(self.gt, self.pred)


FIXTURE = """
base AS (
  SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ann_id, l_suppkey * 7 + (l_linenumber - 1) AS image_id,
    'd' || lpad((l_suppkey % 23)::VARCHAR, 2, '0') AS dataset, (l_partkey * 7919 + l_orderkey * 31) % 2000 AS x1, (l_orderkey * 10473 + l_partkey * 17) % 1400 AS y1,
    20 + l_quantity::BIGINT * 4 AS w, 20 + round(l_tax * 100)::BIGINT * 20 AS h, (round(l_extendedprice * 100)::BIGINT % 1000) / 1000.0::DOUBLE AS conf,
    l_orderkey, l_partkey, l_linestatus, l_returnflag
  FROM lineitem
), gt AS (
  SELECT ann_id, image_id, dataset, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM base WHERE l_linestatus = 'F'
), pred AS (
  SELECT ann_id, image_id, dataset, x1 + l_partkey % 9 - 4 AS x1, y1 + l_orderkey % 9 - 4 AS y1, x1 + w + l_orderkey % 7 - 3 AS x2, y1 + h + l_partkey % 7 - 3 AS y2, conf
  FROM base WHERE (l_linestatus = 'F' AND (l_orderkey + l_partkey) % 10 <> 0) OR (l_linestatus = 'O' AND l_returnflag = 'R')
), images AS (
  SELECT DISTINCT image_id, dataset, 1600 + image_id % 13 * 100 AS width, 1200 + image_id % 7 * 100 AS height, dataset || '_' || image_id || '.jpg' AS file_name FROM gt
)"""

_IOU = "(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"


def sql_inter(a: str, b: str) -> str:
    return _IOU.format(a=a, b=b)


def sql_area(a: str) -> str:
    return f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


def sql_iou(a: str, b: str) -> str:
    i = sql_inter(a, b)
    return f"({i}::DOUBLE / ({sql_area(a)} + {sql_area(b)} - {i})::DOUBLE)"


def sql_overlaps(a: str, b: str) -> str:
    return f"{a}.x1 < {b}.x2 AND {b}.x1 < {a}.x2 AND {a}.y1 < {b}.y2 AND {b}.y1 < {a}.y2"


MATCHES = f"""{FIXTURE}, pairs AS (
  SELECT g.image_id, g.ann_id AS idx_1, p.ann_id AS idx_2, {sql_iou("g", "p")} AS iou FROM gt g JOIN pred p ON g.image_id = p.image_id AND {sql_overlaps("g", "p")}
), named AS (
  SELECT *, row_number() OVER (PARTITION BY image_id, idx_2 ORDER BY iou DESC, idx_1) AS r FROM pairs
), taken AS (
  SELECT image_id, idx_1, idx_2, iou, row_number() OVER (PARTITION BY image_id, idx_1 ORDER BY iou DESC, idx_2 DESC) AS r FROM named WHERE r = 1 AND iou > 0.2
), matched AS (SELECT image_id, idx_1, idx_2, iou FROM taken WHERE r = 1
), matches AS (
  SELECT g.image_id, g.dataset, g.ann_id AS idx_1, coalesce(m.idx_2, -1) AS idx_2, p.conf AS conf2, coalesce(m.iou, 0.0) AS iou, {sql_area("g")} AS area_1, coalesce({sql_area("p")}, 0) AS area_2,
    CASE WHEN m.idx_2 IS NULL THEN 'FN' ELSE 'TP' END AS result
  FROM gt g LEFT JOIN matched m ON m.idx_1 = g.ann_id LEFT JOIN pred p ON p.ann_id = m.idx_2
  UNION ALL
  SELECT image_id, dataset, -1, ann_id, conf, 0.0, 0, {sql_area("pred")}, 'FP' FROM pred WHERE ann_id NOT IN (SELECT idx_2 FROM matched)
)"""


def query(sql: str | None = None, fixture: str | None = FIXTURE):
    """Register a function of Tables as a query, with SQL that may use the fixture's names."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            if fixture is None:
                ORACLES[f.__name__] = body
            else:
                ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if 'RECURSIVE' in body else ''}{fixture}" + (", " + body.removeprefix("WITH RECURSIVE").removeprefix("WITH").strip() if body.startswith("WITH") else " " + body)
        return f

    return add
