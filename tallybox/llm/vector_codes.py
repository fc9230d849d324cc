"""Product-quantised codes of embeddings by Lloyd's rounds over partition-local cover trees.

Every component c becomes the integer floor(SCALE * c), and vectors are cut into equal
consecutive parts with a codebook each. Codebooks start as the parts of the rows with
the smallest ids (then the smallest vectors). Each task gathers its rows to blocks of at
most BLOCK, builds a cover tree over each part of a block and writes points and trees to
the shared folder once. A round walks every tree from its root: a subtree that lies
nearer to one entry than to any other goes there whole, with a difference of cumulative
sums, and only leaves that stay in doubt are compared point by point. A task hands on a sum
per entry and component, which Spark adds up; what comes to the driver are the entries' sums,
whatever the number of rows. Sums, means and errors are exact integers.

Rows: see ``vectors.usable`` for what is dropped. Repeated rows and ids each count and
code alike. Null ids come last among the first rows and stay null; null labels add up
together. Fewer rows than entries leave the codebooks shorter. An entry without points
stays. No usable row gives an empty table; other columns are ignored. Sums of errors
beyond a long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybox.llm import cover_tree
from tallybox.llm.common import lean, written
from tallybox.llm.vectors import floors, usable

SCALE, PARTS, ENTRIES, ROUNDS, BLOCK = 4096, 8, 16, 6, 8_192
#: Sums of this many labels are sent to every task; more are joined by a shuffle, whose hot keys Spark splits.
BROADCAST = 50_000

Codebooks = list[list[list[int]]]


def _cut(x: np.ndarray, part: int, parts: int) -> np.ndarray:
    size = x.shape[1] // parts
    return x[:, part * size : (part + 1) * size]


def _blocks(kept: DataFrame, dims: int, parts: int, scale: int, block: int) -> DataFrame:
    """(id, label, v) rows to blocks: ids, labels, wide, points, and an order and a tree for each part."""
    fields = {f.name: f.dataType.simpleString() for f in kept.schema}

    def made(rows: pa.Table) -> pa.RecordBatch:
        x = floors(rows.column("v").combine_chunks(), dims, scale)
        wide = bool(np.abs(x).max(initial=0) >= cover_tree.SMALL)
        trees = [cover_tree.build(cover_tree.exact(_cut(x, p, parts))) for p in range(parts)]
        cells = [[rows.column("id").to_pylist()], [rows.column("label").to_pylist()], [wide], [x.astype("<i8" if wide else "<i4").tobytes()], [[o.astype("<i4").tobytes() for o, _ in trees]], [[n.tobytes() for _, n in trees]]]
        kinds = [pa.list_(rows.schema.field("id").type), pa.list_(rows.schema.field("label").type), pa.bool_(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], ["ids", "labels", "wide", "points", "orders", "nodes"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for b in it:
            waiting.append(b)
            while sum(w.num_rows for w in waiting) >= block:
                rows = pa.Table.from_batches(waiting)
                yield made(rows.slice(0, block))
                waiting = rows.slice(block).to_batches()
        rows = pa.Table.from_batches(waiting) if waiting else None
        if rows is not None and rows.num_rows:
            yield made(rows)

    return kept.mapInArrow(lean(run), f"ids array<{fields['id']}>, labels array<{fields['label']}>, wide boolean, points binary, orders array<binary>, nodes array<binary>")


def _trees(b: pa.RecordBatch, row: int, dims: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(points, order, nodes) of each part of a block."""
    wide = b.column("wide")[row].as_py()
    x = np.frombuffer(b.column("points")[row].as_buffer(), "<i8" if wide else "<i4").reshape(-1, dims)
    for p in range(parts):
        order, nodes = (np.frombuffer(b.column(c)[row][p].as_buffer(), t) for c, t in (("orders", "<i4"), ("nodes", cover_tree.NODE)))
        yield cover_tree.exact(_cut(x, p, parts)), order, nodes


def _book(entries: list[list[int]], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points and entries in one kind of integers."""
    e = np.array(entries, object)
    small = max(abs(v) for row in entries for v in row) < cover_tree.SMALL and points.dtype != object
    return (points, e.astype(np.int64)) if small else (points.astype(object), e)


def _round(blocks: DataFrame, books: Codebooks, dims: int) -> Codebooks:
    """The books after all parts were assigned and every entry moved to the mean of its own, rounded down."""
    parts = len(books)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[int]] = {}
        for b in it:
            for row in range(b.num_rows):
                for p, (points, order, nodes) in enumerate(_trees(b, row, dims, parts)):
                    points, entries = _book(books[p], points)
                    _, sums, counts, _ = cover_tree.assign(points, order, nodes, entries)
                    for j in np.flatnonzero(counts).tolist():
                        now = [int(counts[j]), *map(int, sums[j])]
                        total[p, j] = [x + y for x, y in zip(total.get((p, j), [0] * len(now)), now, strict=True)]
        rows = [(p, j, i, str(v)) for (p, j), all_ in total.items() for i, v in enumerate(all_)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["part", "entry", "i", "v"])

    sums = blocks.select("wide", "points", "orders", "nodes").mapInArrow(lean(run), "part int, entry int, i int, v string")
    got = {(r["part"], r["entry"], r["i"]): int(r["v"]) for r in sums.groupBy("part", "entry", "i").agg(F.sum(F.col("v").cast("decimal(28,0)")).alias("v")).collect()}  # a row per entry and component
    move = lambda p, j, e: [got[p, j, i + 1] // got[p, j, 0] for i in range(len(e))] if (p, j, 0) in got else e
    return [[move(p, j, e) for j, e in enumerate(book)] for p, book in enumerate(books)]


def _coded(blocks: DataFrame, books: Codebooks, dims: int, id_kind: str, label_kind: str) -> DataFrame:
    """(id, label, code, error) of every row of the blocks."""
    parts = len(books)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in range(b.num_rows):
                codes, errors = [], []
                for p, (points, order, nodes) in enumerate(_trees(b, row, dims, parts)):
                    points, entries = _book(books[p], points)
                    code, *_ = cover_tree.assign(points, order, nodes, entries)
                    far = cover_tree.squared(points, entries[code])
                    codes.append(code.astype(np.uint8))
                    errors.append(far if int(far.max()) < 2**63 // parts else far.astype(object))
                error = sum(errors)
                text = np.column_stack(codes).tobytes().hex()
                whole = [text[i * 2 * parts : (i + 1) * 2 * parts] for i in range(len(error))]
                fits = [int(e) if int(e) < 2**63 else None for e in error]
                yield pa.RecordBatch.from_arrays([b.column("ids")[row].values, b.column("labels")[row].values, pa.array(whole, pa.string()), pa.array(fits, pa.int64())], ["id", "label", "code", "error"])

    return blocks.mapInArrow(lean(run), f"id {id_kind}, label {label_kind}, code string, error bigint")


def vector_codes(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK,
    watch: Callable[[Codebooks], None] | None = None,
) -> DataFrame:
    """One row per usable row: id, code (two hex digits a part), error, label_error, codebooks_sha256; at most 256 entries.

    watch: is told the books before the first round and after each.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so a book has 1 to 256 entries")
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    kept, dims = usable(rows, "v", scale, parts)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect() if dims else []
    if not first:
        return df.sparkSession.createDataFrame([], f"{id_col} {id_kind}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    x = floors(pa.array([r["v"] for r in first], pa.list_(pa.float64())), dims, scale)
    books = [_cut(x, p, parts).tolist() for p in range(parts)]
    blocks = written(_blocks(kept, dims, parts, scale, block), "vector-trees")
    for step in range(rounds + 1):
        if watch is not None:
            watch(books)
        if step < rounds:
            books = _round(blocks, books, dims)
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    coded = written(_coded(blocks, books, dims, id_kind, label_kind), "vector-codes")
    sums = written(coded.groupBy(F.col("label").alias("of_label")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST else sums
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(rounds: int = ROUNDS) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT p.row, p.vec_id, p.label, p.part, p.y, arg_min(b.entry, (list_sum(list_transform(list_zip(p.y, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.entry)) AS entry,
    min(list_sum(list_transform(list_zip(p.y, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT) AS far
  FROM p JOIN b{r} b ON p.part = b.part GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT part, entry, list(floor_mean ORDER BY i) AS y FROM (SELECT part, entry, i, ((sum(y[i]) - ((sum(y[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean FROM a{r}, ix GROUP BY part, entry, i) GROUP BY part, entry
), b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.y, b.y) AS y FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry)""")
    last = f"a{rounds}"
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), ix AS (SELECT unnest(range(1, len(x) // {PARTS} + 1)) AS i FROM (SELECT x FROM v LIMIT 1)
), p AS MATERIALIZED (SELECT row, vec_id, label, q AS part, x[q * (len(x) // {PARTS}) + 1 : (q + 1) * (len(x) // {PARTS})] AS y FROM v, range({PARTS}) t(q)
), b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, y FROM p WHERE row <= {ENTRIES}
), {", ".join(steps)}, c AS (
  SELECT row, vec_id, label, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM {last} GROUP BY ALL
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM c
"""


ORACLE = _oracle()
