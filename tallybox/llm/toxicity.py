"""Toxicity by class-conditional Kneser-Ney models.

The model of a class is the Kneser-Ney distribution of words: a word counts as often
as it follows a different word in the training texts of the class (its continuation
count), an absolute discount is taken off every count, and the freed share goes to a
backoff distribution that both classes use: the part of their continuation
distributions that they have in common, and a floor for every word, unknown ones too.
Each distribution sums to one. An expression too rare to survive the discount in
either class is as likely under both, but for a constant, and does not speak; one that
is frequent in one class only does.

A text is scored by the difference of its toxic and its ordinary log-likelihood,
normalised by length: of the whole text, and of the passage of RUN words where it is
greatest, so that a long text doesn't dilute a short insult. A logistic curve of the
two, fitted on training texts that were not counted, turns them into a score.

Models are fitted on a bounded sample: at most ``per_class`` labelled texts of each
class, by hash order, of which a fifth fits the curve. All that survives in the sample
is used. Scores cover every whole text and use nothing but the text.

Null and empty texts have no evidence and get the curve's value at zero. Repeated
labels of one id count as toxic if one of them is. Null labels are skipped. Without
training texts of both classes every score is 0. Repeated rows score alike, an empty
table gives an empty table, and other columns are ignored by ``score_texts`` and kept
by ``drop_toxic``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybox.llm.common import coded_words, lean, short_batches, text_of, written
from tallybox.llm.tokens import forget

PER_CLASS = 10_000
DISCOUNT, FLOOR, RUN, THRESHOLD = 3.0, 1.0, 2, 0.7
STRIP = ".,;:!?\"'()[]{}*#$%&|<>-"


def held_out(id_col: str = "doc_id") -> Column:
    """True for the third of ids whose labels are never read."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def hashed_words(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of each text the 64-bit hashes of its words, A-Z in lower case and without marks at their ends; marks alone are no words."""
    for words, codes, ends in coded_words(pc.ascii_lower(texts)):
        stripped = [w.strip(STRIP) for w in words]
        every = np.fromiter((xxhash.xxh64_intdigest(w) for w in stripped), np.uint64, len(words))[codes]
        real = np.fromiter(map(bool, stripped), bool, len(words))[codes]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield every[a:b][real[a:b]]


def _followed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (word, before, in0, in1), a row for each distinct pair of words of a text; before is 0 for the first."""
    def batch(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), *(pa.array(rows[:, k].astype(np.int8)) for k in (2, 3))], ["word", "before", "in0", "in1"])

    forget()
    for b in it:
        parts, n = [], 0
        for toxic, h in zip(b.column(0).to_pylist(), hashed_words(b.column(1)), strict=True):
            pairs = np.unique(np.column_stack([h, np.r_[np.zeros(min(1, len(h)), np.uint64), h[:-1]]]), axis=0).view(np.int64)
            parts.append(np.column_stack([pairs, np.full((len(pairs), 2), [1 - toxic, toxic])]))
            n += len(pairs)
            if n > 200_000:
                yield batch(parts)
                parts, n = [], 0
        if parts:
            yield batch(parts)


@dataclass
class Model:
    """Of the words that survive the discount the log of toxic over ordinary probability, by sorted hashes."""

    words: np.ndarray
    evidence: np.ndarray
    other: float  # of every other word
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)

    def of_words(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
        return np.where(self.words[at] == h, self.evidence[at], self.other) if len(self.words) else np.full(len(h), self.other)

    def features(self, h: np.ndarray) -> tuple[float, float]:
        """Mean evidence of the passage of RUN words where it is greatest (of the text if shorter), and of the whole text."""
        if not len(h):
            return 0.0, 0.0
        total = np.concatenate([[0.0], np.cumsum(self.of_words(h))])
        run = min(RUN, len(h))
        return float((total[run:] - total[:-run]).max() / run), float(total[-1] / len(h))

    def scores(self, texts: pa.Array) -> list[float]:
        a, b, c = self.curve
        found = (self.features(h) for h in hashed_words(texts))
        return [1 / (1 + math.exp(-max(-700.0, min(700.0, a + b * x + c * y)))) for x, y in found]


@dataclass
class Totals:
    """What normalises the distributions: continuation counts, freed counts and words of the classes, and the share in common."""

    count: tuple[float, float]
    freed: tuple[float, float]
    n_words: int
    common: float

    def probabilities(self, n0: np.ndarray, n1: np.ndarray, discount: float = DISCOUNT, floor: float = FLOOR) -> np.ndarray:
        """(2, n): the probabilities of words with these continuation counts in the ordinary and the toxic class."""
        n, total = np.array([n0, n1], float), np.maximum(np.array(self.count, float), 1.0)[:, None]
        least = floor / total.min()
        shared = ((n / total).min(axis=0) + least) / (self.common + (self.n_words + 1) * least)
        return np.maximum(n - discount, 0.0) / total + np.array(self.freed, float)[:, None] / total * shared


def build(words: np.ndarray, n0: np.ndarray, n1: np.ndarray, totals: Totals, discount: float = DISCOUNT) -> Model:
    """The model of the words (64-bit hashes) whose count survives the discount in one class at least."""
    order = np.argsort(words.view(np.uint64), kind="stable")
    p = totals.probabilities(n0[order], n1[order], discount)
    least = totals.probabilities(np.zeros(1), np.zeros(1), discount)[:, 0]
    return Model(words.view(np.uint64)[order], np.log(p[1] / p[0]), float(np.log(least[1] / least[0])))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression on the columns of x by Newton's steps with a small ridge; both classes weigh the same."""
    if len(y) == 0 or y.min() == y.max():
        return (-1.0, 1.0, *[0.0] * (x.shape[1] - 1))
    z = np.column_stack([np.ones(len(y)), x])
    w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    beta, cost = np.zeros(z.shape[1]), ridge * np.array([1e-3, *[1.0] * x.shape[1]])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (w * q * (1 - q))[:, None]).T @ z + np.diag(cost), z.T @ (w * (y - q)) - cost * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, discount: float = DISCOUNT) -> Model | None:
    """The model of a bounded sample of labelled rows; None unless both classes have some."""
    short_batches(df.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("own")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("toxic"))
    if known.select("toxic").distinct().count() < 2:
        return None
    order = F.md5(F.col("own").cast("string"))
    both = [known.where(F.col("toxic") == k).orderBy(order, "own").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(both[0].unionByName(both[1]))  # 2 * per_class rows at most
    sample = df.select(F.col(id_col).alias("own"), text_of(text_col).alias("text")).join(chosen, "own")
    sample = written(sample.select("toxic", "text", (F.conv(F.substring(order, 32, 1), 16, 10).cast("int") < 3).alias("fits")), "toxic-sample")

    pairs = sample.where(~F.col("fits")).select("toxic", "text").mapInArrow(lean(_followed), "word bigint, before bigint, in0 tinyint, in1 tinyint")
    pairs = pairs.groupBy("word", "before").agg(F.max("in0").alias("in0"), F.max("in1").alias("in1"))
    words = written(pairs.groupBy("word").agg(F.sum("in0").alias("n0"), F.sum("in1").alias("n1")), "toxic-words")
    every = words.agg(*(f(c) for c in ("n0", "n1") for f in (F.sum, lambda c: F.sum(F.least(F.col(c), F.lit(discount))))), F.count("*")).first()
    count = (every[0] or 0, every[2] or 0)
    rate = [F.col(c) / F.lit(float(max(n, 1))) for c, n in zip(("n0", "n1"), count, strict=True)]
    common = words.agg(F.sum(F.least(*rate))).first()[0] or 0.0
    totals = Totals(count, (every[1] or 0.0, every[3] or 0.0), every[4], common)
    kept = words.where(F.greatest("n0", "n1") > discount).toPandas()  # words of the bounded sample
    model = build(kept["word"].to_numpy(np.int64), kept["n0"].to_numpy(float), kept["n1"].to_numpy(float), totals, discount)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = np.array([sent.value.features(h) for h in hashed_words(b.column(1))]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], ["toxic", "best", "whole"])

    fitted = sample.where("fits").select("toxic", "text").mapInArrow(lean(features), "toxic int, best double, whole double").toPandas().sort_values(["toxic", "best", "whole"])  # a part of the sample
    sent.destroy()
    model.curve = fit_curve(fitted[["best", "whole"]].to_numpy(), fitted["toxic"].to_numpy())
    return model


_SENT: list[Broadcast] = []


def _broadcast(spark: SparkSession, model: Model) -> Broadcast:
    """The model for the tasks; copies on the executors of models sent before are dropped, and sent again if they are asked for."""
    while _SENT:
        _SENT.pop().unpersist()
    _SENT.append(spark.sparkContext.broadcast(model))
    return _SENT[-1]


def score_texts(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, score."""
    if model is None:
        return df.select(id_col, F.lit(0.0).alias("score"))
    kind = df.schema[id_col].dataType.simpleString()
    sent = _broadcast(df.sparkSession, model)  # words of the bounded sample

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.scores(b.column(1)), pa.float64())], ["id", "score"])

    scored = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, score double")
    return scored.withColumnRenamed("id", id_col)


def drop_toxic(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns, judged where they lie."""
    if model is None:
        return df
    short_batches(df.sparkSession)
    sent = _broadcast(df.sparkSession, model)
    at = df.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in it:
            yield b.filter(pa.array([s < threshold for s in sent.value.scores(b.column(at))], pa.bool_()))

    return df.mapInArrow(lean(run), df.schema)


def classified(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **how) -> DataFrame:
    """One row per row: id, held_out, score, predicted."""
    scored = score_texts(df, fit(df, labels, id_col, text_col, **how), id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
