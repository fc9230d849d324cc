"""Joins on names that hold one another, met at a rare substring of the part instead of in a loop over all pairs."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tallybox.operators.work import written

GRAM = 3
#: Identifiers, and bytes of theirs, that go to every task; of more, texts meet each at its rarest substring.
FEW, FEW_BYTES = 100_000, 8_000_000


def _grams(name: Column, n: int) -> Column:
    """The distinct substrings of n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda k: F.substring(name, k, F.lit(n))))


def _candidates(holders: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, part) of holders (key, text) that have the rarest substring of the part; both tables are distinct."""
    pairs = None
    for n in range(1, GRAM + 1):
        own = parts.where(F.length("part") == n if n < GRAM else F.length("part") >= n)
        blocks = holders.where(F.length("text") >= n).select("key", F.explode(_grams(F.col("text"), n)).alias("gram"))
        if n < GRAM:
            rarest = own.select("part", F.col("part").alias("gram"))
        else:
            counts = blocks.groupBy("gram").agg(F.count("*").alias("n"))
            each = own.select("part", F.explode(_grams(F.col("part"), n)).alias("gram"))
            ranked = each.join(counts, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
            rarest = ranked.where("r.n > 0").select("part", "r.gram")
        met = blocks.join(rarest, "gram").select("key", "part")
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs


def containing(holders: DataFrame, parts: DataFrame) -> DataFrame:
    """(holder, part) pairs of distinct names where the holder contains the part; null and empty parts are in none.

    Every substring of GRAM characters is counted over the holders. A part must stand in its
    holder with all its substrings, so it meets the holders of its rarest one only; a part
    with one that no holder has meets none. Names with a common beginning or ending meet where they
    differ. Parts shorter than GRAM meet substrings of their own length.
    """
    known = written(holders.where("holder IS NOT NULL").select("holder").distinct(), "holders")
    wanted = written(parts.where(F.length("part") > 0).select("part").distinct(), "parts")
    pairs = _candidates(known.select(F.col("holder").alias("key"), F.col("holder").alias("text")), wanted)
    return pairs.where(F.contains("key", "part")).select(F.col("key").alias("holder"), "part")


def fuzzy_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each distinct name of ``left`` the one name of ``right`` that contains it or stands in it, whatever the case.

    Columns name and match; match is null where there is none or several.
    """
    a = left.select("name").where("name IS NOT NULL").distinct()
    b = right.select("name").where("name IS NOT NULL").distinct()
    low, known = a.select(F.lower("name").alias("own")).distinct(), b.select(F.lower("name").alias("other")).distinct()
    inner = containing(low.withColumnRenamed("own", "holder"), known.withColumnRenamed("other", "part")).select(F.col("holder").alias("own"), F.col("part").alias("other"))
    outer = containing(known.withColumnRenamed("other", "holder"), low.withColumnRenamed("own", "part")).select(F.col("part").alias("own"), F.col("holder").alias("other"))
    hits = inner.union(outer).distinct().join(b.select(F.col("name").alias("match"), F.lower("name").alias("other")), "other")
    single = hits.groupBy("own").agg(F.min("match").alias("match"), F.count("*").alias("n")).where("n = 1").drop("n")
    return a.withColumn("own", F.lower("name")).join(single, "own", "left").select("name", "match")


def holding_both(holders: DataFrame, pairs: DataFrame, first: str, second: str) -> DataFrame:
    """(holder, pair columns) where the holder contains both parts of a pair."""
    wanted = pairs.where((F.length(first) > 0) & (F.length(second) > 0)).distinct()
    longer = F.when(F.length(second) > F.length(first), F.col(second)).otherwise(F.col(first))  # the longer part has the rarer substrings
    wanted = wanted.withColumn("part", longer)
    found = containing(holders, wanted)
    return found.join(wanted, "part").where(F.contains("holder", F.col(first)) & F.contains("holder", F.col(second))).drop("part")


def _codes(data: np.ndarray, n: int) -> np.ndarray:
    """The number of the n bytes from each place on."""
    out = data[: max(len(data) - n + 1, 0)].astype(np.int32)
    for k in range(1, n):
        out = out << 8 | data[k : len(data) - n + 1 + k]
    return out


class Finder:
    """Which of some parts stand in texts. Each part is looked for where one run of its bytes, a rare one of the first texts, is found."""

    def __init__(self, parts: list[str], size: int = 1 << 20):
        self.parts, self.size, self.at = [p.encode() for p in parts], size, None

    def _anchors(self, data: np.ndarray) -> dict[int, tuple[np.ndarray, dict[int, list[int]]]]:
        """By length of the run: a table of the wanted ones, and the parts of each."""
        found = {n: defaultdict(list) for n in range(1, GRAM + 1)}
        seen = np.bincount(_codes(data, GRAM) % 65_521, minlength=65_521)
        for k, p in enumerate(self.parts):
            n = min(GRAM, len(p))
            own = _codes(np.frombuffer(p, np.uint8), n)
            found[n][int(own[np.argmin(seen[own % 65_521])]) if n == GRAM else int(own[0])].append(k)
        tables = {}
        for n, of in found.items():
            if of:
                tables[n] = np.zeros(1 << 8 * n, bool), of
                tables[n][0][list(of)] = True
        return tables

    def pairs(self, texts: pa.Array) -> Iterator[tuple[int, int]]:
        """(row, part), each once."""
        texts = texts.cast(pa.large_binary())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data or b"", np.uint8)
        first = 0
        while first < len(texts):  # rows of some ``size`` bytes, a longer text for itself
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + self.size, side="right")) - 1)
            own, of = data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
            if self.at is None:
                self.at = self._anchors(own)
            for n, (wanted, parts) in self.at.items():
                codes = _codes(own, n)
                hits = np.flatnonzero(wanted[codes])
                rows = np.searchsorted(of, hits, side="right") - 1
                met = np.unique(rows << 24 | codes[hits])
                row, text = -1, b""
                for r, c in zip((met >> 24).tolist(), (met & 0xFFFFFF).tolist(), strict=True):
                    if r != row:
                        row, text = r, own[of[r] : of[r + 1]].tobytes()
                    for k in parts[c]:
                        if self.parts[k] in text:
                            yield first + r, k
            first = last


def mentions(texts: DataFrame, identifiers: DataFrame, few: int = FEW) -> DataFrame:
    """(id, identifier) for texts (id, text) that hold an identifier, each pair once.

    Identifiers are made distinct first. Up to ``few`` of them (counted first) go to the tasks, and each text
    is read once where it lies. More meet texts at their rarest substring; only ids
    travel with the substrings, and the texts are joined to what met.
    """
    some = texts.where("id IS NOT NULL AND text IS NOT NULL").select("id", "text")
    wanted = written(identifiers.where(F.length("identifier") > 0).select(F.col("identifier").alias("part")).distinct(), "parts")
    n, size = wanted.agg(F.count("*"), F.sum(F.octet_length("part"))).first()
    if n <= few and (size or 0) <= FEW_BYTES:
        parts = [r[0] for r in wanted.collect()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(parts)
            for b in batches:
                met = list(finder.pairs(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r for r, _ in met], pa.int64())), pa.array([parts[k] for _, k in met], pa.string())], ["id", "identifier"])

        return some.mapInArrow(run, StructType([some.schema["id"]]).add("identifier", StringType())).distinct()
    known = written(some.withColumnRenamed("id", "key").distinct(), "texts")
    met = _candidates(known, wanted).distinct().join(known, "key").where(F.contains("text", "part"))
    return met.select(F.col("key").alias("id"), F.col("part").alias("identifier")).distinct()
