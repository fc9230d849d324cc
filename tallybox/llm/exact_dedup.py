"""Exact deduplication through an extendible-hash index on shared files.

Texts are equal when identical after deleting ASCII white space. Every row leaves a
small entry (id, 64-bit key, digest) in the index, written to the shared folder. The
directory starts with one bucket; while a bucket holds more distinct keys than its
capacity, it splits on the next leading bit of the key, and the directory doubles when
the split bucket is as deep as the directory. The directory routes the texts: each
bucket, that is a range of keys, goes to an owner task, which reads it in order of
keys, compares the bytes of texts with one key, and chains those that differ. Equal
texts of a batch merge before they move, so a text that a third of all rows share
sends one row for each batch; its entries meet the verdict by a broadcast of the few
large groups, those of other texts by a join on the shared files.

Of equal texts the row with the most code points stays, then the smallest id. Null
texts count as empty, and empty texts equal each other. Rows repeated with one id and
one text are one document and share a verdict; other texts with that id are judged on
their own. A null id is a document with the id null, the smallest. An empty table
gives an empty table. Other columns are ignored by ``find_copies`` and kept by
``drop_copies``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybox.llm.common import lean, text_of, written
from tallybox.llm.tokens import forget

WHITE = " \t\n\x0b\x0c\r"


def normalised(col: str = "text") -> Column:
    return F.translate(text_of(col), WHITE, "")


def grow_directory(load: dict[int, int], bits: int, capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """Split overfull buckets until none is left that a further bit could divide.

    ``load`` counts distinct keys by their first ``bits`` bits. Returns the depth of
    the directory and its buckets as (first slot at ``bits``, local depth).
    """
    done, depth, todo = [], 0, [(0, 0, sum(load.values()), sorted(load.items()))]
    while todo:
        first, local, n, own = todo.pop()
        if n <= capacity or local == bits:
            done.append((first, local))
            continue
        half = first + (1 << (bits - local - 1))
        depth = max(depth, local + 1)
        for start, part in ((first, [x for x in own if x[0] < half]), (half, [x for x in own if x[0] >= half])):
            todo.append((start, local + 1, sum(c for _, c in part), part))
    return depth, sorted(done)


def slot_of(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a key, 0 for depth 0."""
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def _merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, key, id, n_chars, norm) to (bucket, key, n, n_chars, id, norm): equal texts of a batch are one row before they move."""
    forget()
    for b in it:
        first: dict[str, list] = {}
        for at, (own, n, norm) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
            seen = first.get(norm)
            if seen is None:
                first[norm] = [at, 1, n, own]
            else:
                seen[1] += 1
                if _before(n, own) < _before(seen[2], seen[3]):
                    seen[2:] = n, own
        at = pa.array([x[0] for x in first.values()], pa.int64())
        made = [pa.array([x[1] for x in first.values()], pa.int64()), pa.array([x[2] for x in first.values()], pa.int64()), pa.array([x[3] for x in first.values()], b.schema.field(2).type)]
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *made, b.column(4).take(at)], ["bucket", "key", "n", "n_chars", "id", "norm"])


def _before(n_chars: int, own: object) -> tuple:
    """Order in which rows with equal texts stay: more code points, then the smaller id, null first."""
    return -n_chars, own is not None, 0 if own is None else own


def _chained(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's rows, sorted by bucket and key, to (key, sha, group_size, keep_id) of the texts found twice or more.

    Texts with one key form a chain, and a row joins the link whose bytes are equal.
    Only the links of one key are held, each with one text, however many rows it has.
    """
    chain: list[list] = []
    last, kind = None, None

    def closed(out: list[tuple]) -> None:
        out.extend((last, hashlib.sha256(norm.encode()).hexdigest(), n, own) for norm, n, _, own in chain if n > 1)
        chain.clear()

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), kind]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[k]) for k in range(4)], ["key", "sha", "group_size", "keep_id"])

    for b in it:
        out, kind = [], b.schema.field(4).type
        for key, n, n_chars, own, norm in zip(*(b.column(k).to_pylist() for k in range(1, 6)), strict=True):
            if key != last:
                closed(out)
                last = key
            for link in chain:
                if link[0] == norm:
                    link[1] += n
                    if _before(n_chars, own) < _before(link[2], link[3]):
                        link[2:] = n_chars, own
                    break
            else:
                chain.append([norm, n, n_chars, own])
        yield batch(out)
    if kind is not None:
        out = []
        closed(out)
        yield batch(out)


def find_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1_000, bits: int = 14, hot: int = 10_000) -> DataFrame:
    """One row per row: id, keep_id, group_size, kept, text_sha256, bucket; see the module.

    capacity: distinct keys of a bucket. bits: depth at which the directory stops
    growing, so it has 2**bits slots at most; fuller buckets just hold more. hot: groups
    with more than one of so many rows of the table meet their rows by a broadcast, and
    there are fewer of them than that.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("norm", F.translate("text", WHITE, "")).select("id", F.length("text").cast("long").alias("n_chars"), "norm", F.xxhash64("norm").alias("key"))
    entries = written(rows.select("id", "key", F.sha2("norm", 256).alias("sha")), "hash-index")

    load = {r[0]: r[1] for r in entries.select("key").distinct().groupBy(slot_of(F.col("key"), bits).alias("slot")).count().collect()}  # 2**bits rows at most
    depth, buckets = grow_directory(load, bits, capacity)
    slots = [(s, b) for b, (first, local) in enumerate(buckets) for s in range(first >> (bits - depth), (first >> (bits - depth)) + (1 << (depth - local)))]
    directory = F.broadcast(spark.createDataFrame(slots, "slot int, bucket int"))  # 2**bits rows at most

    def routed(found: DataFrame) -> DataFrame:
        return found.withColumn("slot", slot_of(F.col("key"), depth)).join(directory, "slot").drop("slot") if depth else found.withColumn("bucket", F.lit(0))

    sent = routed(rows).select("bucket", "key", "id", "n_chars", "norm").mapInArrow(lean(_merged), f"bucket int, key bigint, n bigint, n_chars bigint, id {kind}, norm string")
    owned = sent.repartition("bucket").sortWithinPartitions("bucket", "key")
    chains = written(owned.mapInArrow(lean(_chained), f"key bigint, sha string, group_size bigint, keep_id {kind}"), "hash-chains")

    large = F.col("group_size") > max(1_000, entries.count() // hot)
    near = entries.join(F.broadcast(chains.where(large)), ["key", "sha"], "left")  # ``hot`` rows at most
    far = near.where("group_size IS NULL").drop("group_size", "keep_id").join(chains.where(~large).hint("merge"), ["key", "sha"], "left")
    found = routed(near.where("group_size IS NOT NULL").unionByName(far))
    size = F.coalesce("group_size", F.lit(1).cast(T.LongType()))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """The rows of ``df`` that stay, with all its columns. A row goes by its id and its text, so rows with one id and other texts stay."""
    gone = find_copies(df, id_col, text_col, **limits).where(~F.col("kept")).select(F.col(id_col).alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct()
    same = df[id_col].eqNullSafe(gone["gone_id"]) & (F.sha2(F.translate(F.coalesce(df[text_col], F.lit("")), WHITE, ""), 256) == gone["gone_sha"])
    return df.join(gone.hint("merge"), same, "left_anti")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
