"""Small streaming jobs: ingest of prediction documents and running outcome counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallybox.functions import metrics
from tallybox.sources.documents import PREDICTION, detections_of


def stream_parquet(spark: SparkSession, path: str, schema: StructType, files_each: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a table, once for each input file, and stop."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


CORRUPT = "corrupt_"


def stream_predictions(spark: SparkSession, path: str, lines: bool = False, files_each: int = 100) -> DataFrame:
    """Prediction documents as they arrive, by a fixed schema; what is no document is kept as text in ``corrupt_``."""
    schema = f"{PREDICTION}, {CORRUPT} string"
    reader = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", not lines).option("maxFilesPerTrigger", files_each)
    return reader.json(path).withColumn("file", F.input_file_name())


def _fault() -> Column:
    """Why a document can't be taken, null if it can."""
    n = F.size("boxes")
    uneven = reduce(lambda a, c: a | F.coalesce(F.size(c) != n, F.lit(True)), ("contours", "confs", "classes", "scales"), F.lit(False))
    return F.when(F.col(CORRUPT).isNotNull(), "not a document").when(F.col("identifier").isNull(), "no identifier").when(F.col("boxes").isNull(), "no boxes").when(uneven, "arrays of unlike lengths")


def ingest_predictions(stream: DataFrame, rows: str, faults: str, checkpoint: str) -> StreamingQuery:
    """Append the detections of all documents that have arrived to one table and faulty documents, with the reason, to another, and stop.

    A batch writes its own folder of both, so a batch that is run again writes the same again.
    A document without detections gives no row. Of documents with one identifier the first
    batch's counts, within a batch the one whose file comes first; ``ingested`` reads it so.
    """

    def take(batch: DataFrame, number: int) -> None:
        judged = batch.withColumn("fault", _fault()).persist()
        judged.where("fault IS NOT NULL").select("file", "identifier", "fault", F.col(CORRUPT).alias("text")).write.mode("overwrite").parquet(f"{faults}/batch={number}")
        good = judged.where("fault IS NULL").groupBy("identifier").agg(F.min_by(F.struct(*(c for c in batch.columns if c != "identifier")), F.struct("file", F.to_json(F.struct("boxes", "confs")))).alias("d")).select("identifier", "d.*")
        detections_of(good, "file").write.mode("overwrite").parquet(f"{rows}/batch={number}")
        judged.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take).trigger(availableNow=True).start()


def ingested(spark: SparkSession, rows: str) -> DataFrame:
    """The detections of every document once."""
    every = spark.read.parquet(rows)
    first = every.groupBy(F.col("identifier").alias("of")).agg(F.min("batch").alias("first"))
    return every.join(first, (F.col("identifier") == F.col("of")) & (F.col("batch") == F.col("first"))).drop("of", "first", "batch")


def running_outcomes(stream: DataFrame, out: str, checkpoint: str, *by: str) -> StreamingQuery:
    """Counts and precision and recall per group as match rows arrive; every batch writes its changed groups.

    The table keeps the batch number, so the latest row of a group is its state and a
    batch that is run again overwrites its own folder.
    """
    n = lambda k: F.count_if(F.col("result") == k).alias(k.lower())
    counts = stream.groupBy(*by).agg(n("TP"), n("FP"), n("FN"))

    def upsert(batch: DataFrame, number: int) -> None:
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
        batch.select(*by, "tp", "fp", "fn", metrics.precision(tp, fp).alias("precision"), metrics.recall(tp, fn).alias("recall")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, *by: str) -> DataFrame:
    """The last state of every group that ``running_outcomes`` wrote."""
    rows = spark.read.parquet(out)
    return rows.groupBy(*by).agg(F.max_by(F.struct("tp", "fp", "fn", "precision", "recall"), "batch").alias("s")).select(*by, "s.*")


def windowed_counts(stream: DataFrame, ts: str, width: str, late: str, *by: str) -> DataFrame:
    """Rows per time window and group, with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"))
