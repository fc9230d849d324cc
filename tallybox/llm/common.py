"""Shared helpers: the shared work folder, written intermediate tables, words."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule of every query here: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary folder where that is unset and all runs on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words; ``bytes.split`` splits at exactly the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def coded_words(texts: pa.Array, size: int = 1 << 19) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """``word_codes`` with the distinct words as strings."""
    return ((words.to_pylist(), codes, ends) for words, codes, ends in word_codes(texts, size))


def word_codes(texts: pa.Array, size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Slices of a column of texts, of some ``size`` bytes, as (distinct words, code of each word, ends).

    Row k of a slice has the codes from ``ends[k]`` to ``ends[k + 1]``. Texts are cut at
    ASCII white space; the empty string stands before and after white space at an edge.
    A longer text is a slice of its own. Null texts have no words but the empty one.
    """
    texts = texts.fill_null("")
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + size, side="right")))
        split = pc.ascii_split_whitespace(texts.slice(at, to - at))
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        yield coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), ends - ends[0]
        at = to


def short_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """From here on at most so many rows of the session go to Python at once: texts are long, and both sides hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def give_back() -> None:
    """Return what this worker's allocators hold and don't use to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim is not None:
        trim(0)


@functools.cache
def return_large_blocks(size: int = 1 << 18) -> None:
    """From here on this worker gets blocks above ``size`` from the system and returns them when they are freed; its pools keep small ones only."""
    pa.set_memory_pool(pa.system_memory_pool())
    set_option = getattr(ctypes.CDLL(None), "mallopt", None)
    if set_option is not None:
        set_option(-3, size)  # M_MMAP_THRESHOLD: fixed, where the C library would raise it to the largest block freed


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving memory back during a task and when it ends: Spark keeps the worker, and an idle one counts as well."""

    @functools.wraps(run)
    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_large_blocks()
        try:
            yield from run(it)
        finally:
            give_back()

    return task


class WordHash:
    """64-bit hashes of words, remembered in a table of bounded size."""

    def __init__(self, limit: int = 100_000):
        self.limit, self.seen = limit, {}

    def __call__(self, words: Iterable[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.limit:
            seen.clear()
        out = []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64) if out else np.zeros(0, np.uint64)


MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n consecutive words, from the words' hashes (order matters)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mix(out) + h[i : len(h) - n + 1 + i]
    return mix(out)
