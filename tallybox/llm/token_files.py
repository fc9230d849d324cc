"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are counted over the whole corpus and replaced by their rank, the most frequent
first, so that frequent ids take one byte. Four ranks share a control byte with two
bits each for a length of one to four bytes; control bytes and data bytes are kept
apart, so a reader looks up the lengths of four ranks at once in a table of 256 rows
and gathers the values with numpy.

A file set is written by Spark to a folder: Parquet shards in ascending id order with
one row per document (shard, id, place of its first id in the shard, number of ids,
control bytes, data bytes), and a table of ids by rank. Spark commits whole tasks, so
lost executors leave nothing behind.

Null and empty texts hold the end id alone. A null id comes first. Rows repeated with
one id stand side by side in any order. An empty table gives empty files; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybox.llm.common import lean, shared_folder, written
from tallybox.llm.tokens import ID, tokenizer

END, SHARD, BROADCAST = 2, 4_000_000, 100_000
#: Lengths of the four ranks of each control byte.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def encode_ranks(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of each document; counts: ranks of each, in order."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    ends, quads = np.cumsum(counts), np.cumsum(-(-counts // 4))
    code = np.zeros(int(quads[-1]) * 4 if len(quads) else 0, np.uint8)
    code[np.arange(len(ranks)) + np.repeat((quads + counts // -4) * 4 - (ends - counts), counts)] = size - 1
    code = code.reshape(-1, 4)
    control = (code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).tobytes()
    top = int(size.max()) if len(size) else 1
    four = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :top]
    data = four[np.arange(top, dtype=np.uint8) < size[:, None]].tobytes()
    stops = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.concatenate([[0], ends])].tolist()
    quads = np.concatenate([[0], quads]).tolist()
    return [control[a:b] for a, b in zip(quads, quads[1:], strict=False)], [data[a:b] for a, b in zip(stops, stops[1:], strict=False)]


def decode_ranks(control: list[bytes], data: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The ranks of all documents in order: the inverse of encode_ranks."""
    size = LENGTHS[np.frombuffer(b"".join(control), np.uint8)].ravel()
    ends, quads = np.cumsum(counts), np.cumsum(-(-counts // 4))
    n = int(ends[-1]) if len(ends) else 0
    size = size[np.arange(n) + np.repeat((quads + counts // -4) * 4 - (ends - counts), counts)]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(b"".join(data) + bytes(3), np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, int(size.max()) if n else 1):
        more = size > k
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenised(df: DataFrame, id_col: str, text_col: str, end: int, vocabulary: str | None) -> DataFrame:
    """(id, ids, width, counts): ids of two or four bytes, as the vocabulary needs; and a row of each task with counts alone, how often each id is in it, eight bytes each."""
    last = np.array([end], ID).tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, total = tokenizer(vocabulary), np.zeros(0, np.int64)
        for b in it:
            ids = [np.frombuffer(x + last, ID).astype(f"<u{tok.width}").tobytes() for x in tok.column(b.column(1))]
            if ids:
                kind = b.column(0).type
                n = np.bincount(np.frombuffer(b"".join(ids), f"<u{tok.width}"), minlength=len(total))
                n[: len(total)] += total
                total = n
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([tok.width] * len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], names)
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    names = ["id", "ids", "width", "counts"]
    kind_of_id = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind_of_id}, ids binary, width int, counts binary")


def _ids(ids: pa.Array, width: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of the intermediate table, and how many each document has."""
    parts, wide = ids.to_pylist(), width[0].as_py()
    return np.frombuffer(b"".join(parts), f"<u{wide}"), np.array([len(p) // wide for p in parts], np.int64)


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in it:
        for own in b.column(0).to_pylist():
            n = np.frombuffer(own, "<i8")
            if len(n) > len(total):
                total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
            total[: len(n)] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])


def write_tokens(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, vocabulary: str | None = None, shard: int = SHARD) -> None:
    """Write the file set of ``df`` to ``folder``/shards and ``folder``/ranks. shard: ids of a shard, about."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    _tokenised(df, id_col, text_col, end, vocabulary).write.option("compression", "zstd").parquet(f"{folder}/tokenised")
    made = spark.read.parquet(f"{folder}/tokenised")
    plain = made.where("ids IS NOT NULL").select("id", "ids", "width")
    counts = made.where("counts IS NOT NULL").select("counts").mapInArrow(_counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(((r["n"], r["id"]) for r in counts.collect()), key=lambda x: (-x[0], x[1]))  # a row for each id of the vocabulary at most
    spark.createDataFrame([(k, i, n) for k, (n, i) in enumerate(ranked)], "rank bigint, id bigint, n bigint").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(max((i for _, i in ranked), default=0) + 1, np.uint32)
    rank[[i for _, i in ranked]] = np.arange(len(ranked), dtype=np.uint32)

    def encoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in it:
            if b.num_rows:
                found, n = _ids(b.column(1), b.column(2))
                control, data = encode_ranks(rank[found], n)
                ends = at + np.cumsum(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part), pa.int32()), b.column(0), pa.array(ends - n, pa.int64()), pa.array(n), pa.array(control, pa.binary()), pa.array(data, pa.binary())], ["shard", "id", "place", "n_tokens", "control", "data"])
                at = int(ends[-1])

    shards = max(1, -(-sum(n for n, _ in ranked) // shard))
    (
        plain.repartitionByRange(shards, "id").sortWithinPartitions("id")
        .mapInArrow(encoded, f"shard int, id {kind}, place bigint, n_tokens bigint, control binary, data binary")
        .write.option("compression", "zstd").parquet(f"{folder}/shards")
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The file set as rows (id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    ranked = spark.read.parquet(f"{folder}/ranks").orderBy("rank").select("id").collect()  # a row for each id of the vocabulary at most
    ids = np.array([r[0] for r in ranked], ID)
    rows = spark.read.parquet(f"{folder}/shards")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = written(totals.select(F.col("shard").alias("own"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "token-shards")  # a row for each shard
    base = F.broadcast(base) if base.count() <= BROADCAST else base

    def decoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = b.column(2).to_numpy()
            found = ids[decode_ranks(b.column(3).to_pylist(), b.column(4).to_pylist(), n)].tobytes()
            stops = [0, *(np.cumsum(n) * ID.itemsize).tolist()]
            parts = [found[x:y] for x, y in zip(stops, stops[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(parts, pa.binary())], ["id", "start", "n_tokens", "ids"])

    placed = rows.join(base, F.col("shard") == F.col("own")).select("id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "control", "data")
    return placed.mapInArrow(decoded, f"id {rows.schema['id'].dataType.simpleString()}, start bigint, n_tokens bigint, ids binary")


def token_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Write the files of ``df`` below the shared folder, read them back: id, start, n_tokens, ids_crc32."""
    folder = shared_folder(df.sparkSession, "token-files")
    write_tokens(df, folder, id_col, text_col, **how)
    return read_tokens(df.sparkSession, folder).select(F.col("id").alias(id_col), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def brute_digests(rows: list[tuple[int, str | None]], end: int = END, vocabulary: str | None = None) -> list[tuple[int, int, int, int]]:
    """The same by plain encoding of whole texts, for tests."""
    tok, at, out = tokenizer(vocabulary), 0, []
    for i, text in sorted(rows):
        ids = np.array([*tok.whole.encode(text or "", add_special_tokens=False).ids, end], ID)
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out
