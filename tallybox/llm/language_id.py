"""Language of texts by a byte convolutional network, trained in numpy.

Bytes are looked up in a table of EMBED numbers, A-Z as a-z; filters of several widths run over them, each
filter keeps its largest response in the window (max pooling), and a linear layer with a
softmax gives the languages' probabilities. All widths are one matrix product: narrower
filters have zeros at their end.

The network is trained on windows of a bounded sample: at most ``per_lang`` texts of each
language, by hash order, WINDOWS_EACH windows of each at places a hash draws, some cut
short so that short texts are known too. Training is seeded, and the sample is sorted,
so a run gives the same network again. Only what the network reads comes to the
driver: per_lang * WINDOWS_EACH windows of WINDOW bytes a language.

A text is read whole, in windows that overlap by one byte less than the widest filter.
Its score for a language is the mean of the windows' log-probabilities, weighted by their
bytes, brought to sum to one again; the prediction is the best, of equals the first by
code point.

Rows: a null text, and one without a letter (\\p{L}), is ``und`` with the score 0; so is every
text when nothing could be learned. Null languages and ids without a value are not
learned from. Repeated rows are predicted alike, an empty table gives an empty table, and
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybox.llm.common import lean, short_batches, text_of, written

WIDTHS, FILTERS, EMBED, WINDOW = (2, 3, 4), 12, 8, 128
WIDEST = max(WIDTHS)
STEP = WINDOW - WIDEST + 1
PER_LANG, WINDOWS_EACH, BATCH, EPOCHS, LEAST_STEPS, RATE, SEED = 1_500, 4, 128, 3, 400, 4e-3, 11
UPPER, LOWER = slice(65, 91), slice(97, 123)
UNKNOWN = "und"
#: Counts of this many languages are sent to every task, so that texts need not move to their language's.
BROADCAST = 50_000


def held_out(id_col: str = "doc_id") -> Column:
    """True for the quarter of ids whose languages are never read."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Network:
    langs: list[str]
    table: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (WIDEST * EMBED, filters), zeros behind the narrower ones
    bias: np.ndarray
    out: np.ndarray  # (filters, langs)
    base: np.ndarray

    def spread(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, WIDEST * EMBED): what the filters see at each position."""
        x = np.ascontiguousarray(self.table[windows])
        n, w, d = x.shape
        return np.lib.stride_tricks.as_strided(x, (n, w - WIDEST + 1, WIDEST * d), (x.strides[0], x.strides[1], x.strides[2]))

    def responses(self, windows: np.ndarray) -> np.ndarray:
        seen = self.spread(windows)
        n, p, d = seen.shape
        return (seen.reshape(n * p, d) @ self.filters).reshape(n, p, -1)

    def log_probabilities(self, windows: np.ndarray, block: int = 64) -> np.ndarray:
        out = np.empty((len(windows), len(self.langs)), np.float32)
        for at in range(0, len(windows), block):
            top = self.responses(windows[at : at + block]).max(axis=1)
            z = np.maximum(top + self.bias, 0) @ self.out + self.base
            z -= z.max(axis=1, keepdims=True)
            out[at : at + block] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out


def _mask() -> np.ndarray:
    """1 where a filter has weights: those of width w at the first w bytes."""
    return np.concatenate([np.repeat((np.arange(WIDEST) < w).astype(np.float32), EMBED)[:, None].repeat(FILTERS, axis=1) for w in WIDTHS], axis=1)


def train(windows: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = EPOCHS, steps: int = LEAST_STEPS, rate: float = RATE, seed: int = SEED) -> Network:
    """A network from (n, WINDOW) bytes and the index of each one's language, by Adam, in ``epochs`` or more if those are few steps; languages weigh the same."""
    rng = np.random.default_rng(seed)
    fold = np.arange(256, dtype=np.uint8)
    fold[UPPER] = fold[LOWER]
    windows = fold[windows]
    mask = _mask()
    k = mask.shape[1]
    net = Network(langs, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), (rng.normal(0, 0.2, mask.shape) * mask).astype(np.float32), np.zeros(k, np.float32), rng.normal(0, 0.1, (k, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    weight = (len(y) / np.maximum(np.bincount(y, minlength=len(langs)), 1) / len(langs)).astype(np.float32)
    params = [net.table, net.filters, net.bias, net.out, net.base]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for _ in range(max(epochs, -(-steps * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            b, n = windows[pick], len(pick)
            r = net.responses(b)
            where = r.argmax(axis=1)  # only the largest response of a filter learns
            top = np.take_along_axis(r, where[:, None, :], 1)[:, 0] + net.bias
            h = np.maximum(top, 0)
            z = h @ net.out + net.base
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[pick]] -= 1
            p *= weight[y[pick]][:, None] / n
            back = (p @ net.out.T) * (top > 0)
            bytes_ = b[np.arange(n)[:, None, None], where[:, :, None] + np.arange(WIDEST)]  # (n, filters, WIDEST)
            seen = net.table[bytes_].reshape(n, k, -1)
            to_filters = np.einsum("nf,nfd->df", back, seen) * mask
            to_bytes = (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            flat = bytes_.ravel()
            to_table = np.column_stack([np.bincount(flat, to_bytes[:, d], 256) for d in range(EMBED)])
            t += 1
            for i, g in enumerate((to_table, to_filters, back.sum(axis=0), h.T @ p, p.sum(axis=0))):
                first[i] += 0.1 * (g.astype(np.float32) - first[i])
                second[i] += 0.01 * (g.astype(np.float32) ** 2 - second[i])
                params[i] -= rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-8)
    net.table[UPPER] = net.table[LOWER]
    return net


def windows_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """(n, WINDOW) bytes from ``starts``; zeros from ``stops`` on."""
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < stops[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8) if len(data) else np.zeros((len(starts), WINDOW), np.uint8)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and the ends of each."""
    texts = texts.fill_null("")
    texts = pa.concat_arrays([texts]) if not texts.offset else pa.array(texts.to_pylist(), texts.type)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, kind, len(texts) + 1).astype(np.int64)
    return np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.zeros(0, np.uint8), ends


def _drawn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, seed, text) to (lang, window): windows at drawn places, every second one cut to a drawn length."""
    for b in it:
        langs, out = [], []
        for lang, seed, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            data = text.as_py().encode("utf-8", "surrogatepass")
            rng = np.random.default_rng(seed)
            for i in range(WINDOWS_EACH):
                start = int(rng.integers(0, max(1, len(data) - WINDOW + 1)))
                length = WINDOW if i % 2 == 0 else int(rng.integers(8, WINDOW + 1))
                langs.append(lang)
                out.append(data[start : start + min(length, WINDOW)].ljust(WINDOW, b"\0"))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Network | None:
    """The network of a bounded sample of the rows whose language may be read; None if there are none with a letter.

    The rows of each language are counted first; a hash of id and text then takes about a
    quarter more than wanted of each, and those are cut to ``per_lang`` by their hash. So
    no task ever holds the rows of a language.
    """
    short_batches(df.sparkSession)
    known = df.select(F.col(id_col).cast("string").alias("own"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"), held_out(id_col).alias("out"))
    known = known.where("own IS NOT NULL AND lang IS NOT NULL AND NOT out AND text RLIKE '\\\\p{L}'")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("own", "text", F.lit(SEED)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    share = F.least(F.lit(1.0), (1.25 * per_lang + 50) / F.col("n"))
    counts = written(counts, "languages")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST else counts
    some = known.join(counts, "lang").withColumn("draw", draw).where(F.col("draw") < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "own", "text"))
    sample = some.withColumn("r", rank).where(F.col("r") <= per_lang)  # about 1.25 * per_lang rows a language
    cut = sample.select("lang", F.pmod(F.xxhash64("text", "own"), F.lit(1 << 31)).alias("seed"), "text").mapInArrow(lean(_drawn), "lang string, window binary")
    got = sorted((r["lang"], bytes(r["window"])) for r in written(cut, "language-sample").collect())
    if not got:
        return None
    langs = sorted({g[0] for g in got})
    y = np.array([langs.index(g[0]) for g in got])
    return train(np.frombuffer(b"".join(g[1] for g in got), np.uint8).reshape(-1, WINDOW), y, langs)


def predict(texts: pa.Array, net: Network, some: int = 4_096) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, score) of each text, from all its windows; a slice of windows at a time."""
    data, ends = _bytes(texts)
    size = np.diff(ends)
    n = np.maximum(1, -(-(size - WIDEST + 1) // STEP))
    owner = np.repeat(np.arange(len(size)), n)
    inside = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
    starts = ends[owner] + inside * STEP
    stops = np.minimum(starts + WINDOW, ends[owner + 1])
    total = np.zeros((len(size), len(net.langs)))
    for at in range(0, len(owner), some):
        cut = slice(at, at + some)
        w = np.maximum(stops[cut] - starts[cut], 1)
        logs = net.log_probabilities(windows_of(data, starts[cut], stops[cut])) * w[:, None]
        low, high = owner[cut][0], owner[cut][-1] + 1
        for j in range(total.shape[1]):
            total[low:high, j] += np.bincount(owner[cut] - low, logs[:, j], high - low)
    weight = np.bincount(owner, np.maximum(stops - starts, 1), len(size))[:, None]
    p = np.exp(total / weight - (total / weight).max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p.argmax(axis=1), p.max(axis=1)


def languages(df: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, held_out, lang_pred, score."""
    short_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), held_out(id_col).alias("out"), letter.alias("letter"), text_of(text_col).alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            known = b.column(2).to_numpy(zero_copy_only=False) if net is not None else np.zeros(b.num_rows, bool)
            lang, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            if known.any():
                at = np.flatnonzero(known)
                best, p = predict(b.column(3).take(pa.array(at)), net)
                score[at] = p
                for i, j in zip(at.tolist(), best.tolist(), strict=True):
                    lang[i] = net.langs[j]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(lean(run), f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """Fitted on the rows whose language may be read, applied to all."""
    return languages(df, fit(df, id_col, text_col, lang_col, **how), id_col, text_col)
