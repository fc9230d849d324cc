"""Mixing sources to target weights, in DataFrame functions only.

Words are summed by source. Sources in code-point order, null last, weigh 5, 2, 1,
repeating, and share all words by weight; a source stops at ``most`` times its own
size and what it leaves is shared again by weight. With the sources in rising order
of limit over weight, the level reached before each source is (words left) over
(weight left); it rises up to the first source that its limit doesn't stop, so the
final level is the largest. A document is then emitted floor(rate) times, and once
more if a hash of its id and a seed falls below the fraction of the rate. Where a
source has few or long documents one draw can end far from the target, so DRAWS
seeds are tried in one aggregate, and each source takes the seed whose words come
nearest its target, ties to the first.

Null texts have size 0. A source without words has the target 0. An empty table
gives an empty table. Repeated rows draw alike; rows without an id draw by their text.
The number of sources, not of documents, bounds the two windows over all sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybox.llm.common import WORD, text_of, written

WEIGHTS = (5, 2, 1)
MOST, SEED, DRAWS, BROADCAST = 3, 17, 32, 50_000


def n_words(col: str = "text") -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, size) rows to one row per source: source, source_size, target, rate."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    own = own.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * MOST)
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before, every = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    own = own.withColumn("level", left.cast("double") / weights.cast("double"))
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.max("level").over(every))
    return own.select("source", "source_size", target.alias("target")).withColumn("rate", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)))


def draw_key(id_col: str, text_col: str) -> Column:
    """What a row's draws are hashed from: its id, or without one its text."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(text_of(text_col))))


def draw(key: Column, seed: int, pick: Column) -> Column:
    """A number from 0 to 1 by the ``pick``-th of the seeds from ``seed`` on: a digest holds four."""
    digest = F.md5(F.concat((pick.cast("int") / 4).cast("int") + seed, F.lit(":"), key))
    return F.conv(F.substr(digest, pick.cast("int") % 4 * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(rate: Column, key: Column, seed: int, pick: Column) -> Column:
    """floor(rate), and one more with the probability of the fraction."""
    return F.floor(rate) + (draw(key, seed, pick) < rate - F.floor(rate)).cast("long")


def _beside(df: DataFrame, source_col: str, own: DataFrame, few: bool) -> DataFrame:
    return df.join(F.broadcast(own) if few else own, F.col(source_col).eqNullSafe(F.col("mix_source")), "inner")


def _sources(sized: DataFrame, seed: int) -> tuple[DataFrame, bool]:
    """(mix_source, mix_size, mix_target, mix_rate, mix_pick) from (key, source, size), and whether it may be broadcast.

    The table of sources is written, counted, and broadcast up to BROADCAST rows; more
    sources than that are joined by a shuffle, whose hot keys Spark splits.
    """
    targets = source_targets(sized)
    own = written(targets.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_size"), F.col("target").alias("mix_target"), F.col("rate").alias("mix_rate")), "mix-targets")
    few = own.count() <= BROADCAST
    every = [F.sum(F.col("size") * copies(F.col("mix_rate"), F.col("key"), seed, F.lit(k))).cast("double") for k in range(DRAWS)]
    names = ["mix_source", "mix_size", "mix_target", "mix_rate"]
    tried = _beside(sized, "source", own, few).groupBy(*names).agg(F.array(*(F.abs(taken - F.col("mix_target")) for taken in every)).alias("off"))
    return written(tried.select(*names, (F.array_position("off", F.array_min("off")) - 1).cast("int").alias("mix_pick")), "mix-seeds"), few


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(df.select(F.col(id_col).alias("id"), draw_key(id_col, text_col).alias("key"), F.col(source_col).alias("source"), n_words(text_col).alias("size")), "mix-sizes")


def mix_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One row per row: id, size, source_size, target, copies, taken."""
    sized = _sized(df, id_col, text_col, source_col)
    planned = _beside(sized, "source", *_sources(sized, seed)).withColumn("copies", copies(F.col("mix_rate"), F.col("key"), seed, F.col("mix_pick")))
    return planned.select(F.col("id").alias(id_col), "size", F.col("mix_size").alias("source_size"), F.col("mix_target").alias("target"), "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of ``df``, each as often as the plan takes it, with all its columns."""
    sources = _sources(_sized(df, id_col, text_col, source_col), seed)
    rows = df.select(F.struct("*").alias("row"), draw_key(id_col, text_col).alias("key"), F.col(source_col).alias("source"))  # columns of any name
    joined = _beside(rows, "source", *sources).withColumn("copies", copies(F.col("mix_rate"), F.col("key"), seed, F.col("mix_pick"))).where("copies > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER f, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level
  FROM w WINDOW f AS (ORDER BY 3 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * max(level) OVER ()) AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size::DOUBLE END AS rate FROM t
), c AS (
  SELECT d.*, r.* EXCLUDE (source), k,
         size * (floor(rate)::BIGINT + (CAST('0x' || substr(md5(({SEED} + k // 4)::VARCHAR || ':' || key), k % 4 * 8 + 1, 8) AS BIGINT)::DOUBLE / 4294967296.0 < rate - floor(rate))::BIGINT) AS taken
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, range({DRAWS}) n(k)
), p AS (
  SELECT source, k FROM c GROUP BY source, k, target QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(sum(taken)::DOUBLE - target), k) = 1
)
SELECT doc_id, size, source_size, target, taken FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source AND c.k = p.k
"""
