"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are encoded where they lie; only (id, piece, start, length, checksum) rows
move. Longer documents are cut into full pieces and a rest. The rows are dealt by a
hash of document and piece into groups of some ten thousands; each group is packed on
its own by bounded-space online best fit. Open bins are stacks keyed by free space,
with one bit for each free space that has a stack: shifting the bitset by the piece's
length and taking its lowest bit gives the fullest bin that still fits. Beyond
``open_bins`` open bins, the fullest closes. Longer pieces arrive first: a group of
40,000 pieces of the test tables would hold 2,679 bins open at most, and needs 8,791
bins with 2,600 open, 8,790 without a bound and 8,820 in order of arrival.

Null and empty texts are one piece with the end id alone. Ties are broken by id and
piece. Rows repeated with one id are separate pieces with equal numbers. An empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybox.llm.common import lean, short_batches, written
from tallybox.llm.tokens import ID, tokenizer

LENGTH, END, OPEN_BINS, GROUP = 4096, 1, 2_560, 40_000


def pack(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """The bin and the place in it of each length, in order of arrival."""
    stacks: dict[int, list[int]] = {}
    bits = n_open = n_bins = 0
    bins, places = [], []
    for need in lengths:
        fits = bits >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            own = stacks[free].pop()
            n_open -= 1
            if not stacks[free]:
                bits ^= 1 << free
        else:
            free, own = capacity, n_bins
            n_bins += 1
        bins.append(own)
        places.append(capacity - free)
        rest = free - need
        if rest:
            stacks.setdefault(rest, []).append(own)
            bits |= 1 << rest
            n_open += 1
            if n_open > open_bins:
                fullest = (bits & -bits).bit_length() - 1
                stacks[fullest].pop()
                n_open -= 1
                if not stacks[fullest]:
                    bits ^= 1 << fullest
    return bins, places


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    last = np.array([end], ID).tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for b in it:
            row, piece, start, size, crc = [], [], [], [], []
            for i, own in enumerate(tok.column(b.column(1))):
                ids = own + last
                n = len(ids) // ID.itemsize
                for k, at in enumerate(range(0, n, length)):
                    m = min(length, n - at)
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(m)
                    crc.append(zlib.crc32(memoryview(ids)[at * ID.itemsize : (at + m) * ID.itemsize]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))], ["id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, open_bins: int = OPEN_BINS, group: int = GROUP, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset; see the module."""
    short_batches(df.sparkSession)
    cut = written(pieces(df, id_col, text_col, length, end, vocabulary), "pieces")
    groups = max(1, -(-cut.count() // group))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        bins, places = pack(rows["length"].to_pylist(), length, open_bins)
        own = rows["dealt"].to_numpy() * (1 << 32) + np.array(bins, np.int64)
        return rows.drop_columns("dealt").append_column("sequence_id", pa.array(own, pa.int64())).append_column("offset", pa.array(places, pa.int64()))

    kind = df.schema[id_col].dataType.simpleString()
    dealt = cut.withColumn("dealt", F.pmod(F.xxhash64("id", "piece"), F.lit(groups)))
    out = dealt.groupBy("dealt").applyInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)
