"""Quality rules with thresholds that follow the data.

Every text gives a few counts. Ratios of these counts enter mergeable quantile
sketches, one for each language and source; sketches of small groups merge into one
for the language, and those of small languages into one for all. A row's sketch sets
its limits. A ratio may lie ``spread`` interquartile ranges beyond a quartile, plus a
slack for what a single word does to a short text. Ratios that are zero in most texts
have quartiles of zero, so they also keep to the tail of their group: a high quantile,
plus only what one more word or line adds. Rows join their group's limits and are
judged. A fixed base rule for very short and very repetitive texts comes first.

Null texts have no words and fail the base rule. Null languages and sources are
groups of their own. Repeated rows are judged alike. An empty table gives an empty
table. Texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybox.llm.common import WordHash, window_hashes, words_of, written

#: Symbols, and the ASCII white space that divides words.
SYMBOLS, WHITE = "#*$%&|<>", " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RUN, SPREAD, LEAST = 5, 3.0, 200
#: Size of a sketch: ranks within 0.4 %, so that the quantiles of TAILS can be told from the largest values.
SKETCH = 800
#: ratio: (numerator, low limit too, slack, slack over the square root of the words)
RULES = {
    "chars_per_word": ("word_chars", True, 0.5, 6.0),
    "symbols_per_word": ("n_symbols", False, 0.1, 0.5),
    "dup_lines_per_word": ("n_dup_lines", False, 0.02, 0.2),
    "repeats_per_word": ("n_repeat_words", False, 0.15, 0.6),
}
#: ratio: (quantile, how many times its distance from the median may lie beyond it, counts that one more word, line or repeat adds).
#: Symbols take a lower quantile, as texts made of symbols can be a tenth of a group.
TAILS = {
    "symbols_per_word": (0.85, 3.0, 3),
    "dup_lines_per_word": (0.98, 0.0, 1),
    "repeats_per_word": (0.98, 0.0, 2 * RUN),
}


def repeat_words(h: np.ndarray, run: int = RUN) -> int:
    """Words inside runs of ``run`` words that occur twice or more, from the words' hashes."""
    w = window_hashes(h, run)
    if len(w) < 2:
        return 0
    _, at, n = np.unique(w, return_inverse=True, return_counts=True)
    if len(n) == len(w):
        return 0
    starts = np.flatnonzero(n[at] > 1)
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def count_text(text: str | None, hashes: WordHash) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = words_of(text)
    lines = Counter(x for x in text.split("\n") if x.strip(WHITE))
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        sum(lines.values()) - len(lines),
        repeat_words(hashes(words)),
    )


def count_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per row: id, the group columns as g0, g1 …, and COUNTS."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in it:
            found = [count_text(t.as_py(), hashes) for t in b.column(b.num_columns - 1)]
            own = [pa.array([f[k] for f in found], pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *own], [*b.schema.names[:-1], *COUNTS])

    keys = [F.col(c).alias(f"g{k}") for k, c in enumerate(group_cols)]
    kinds = [f"g{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(group_cols)]
    schema = ", ".join([f"id {df.schema[id_col].dataType.simpleString()}", *kinds, *(f"{c} bigint" for c in COUNTS)])
    return df.select(F.col(id_col).alias("id"), *keys, F.col(text_col).alias("text")).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _ratio(name: str) -> Column:
    return F.col(RULES[name][0]) / F.col("n_words")


def limits(counted: DataFrame, least: int = LEAST, spread: float = SPREAD) -> DataFrame:
    """One row per group of ``counted``: g0, g1, (low, high) quartile fences of every ratio, and the tail of those in TAILS.

    Only rows that pass the base rule enter the sketches. A group with fewer than
    ``least`` of them takes its language's sketch, and then that of all rows.
    """
    passed = F.when(~base_failed(), F.lit(1))
    own = counted.groupBy("g0", "g1").agg(F.count(passed).alias("n"), *(F.kll_sketch_agg_double(F.when(~base_failed(), _ratio(r)), SKETCH).alias(r) for r in RULES))
    own = written(own, "quality-sketches")
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(r, SKETCH).alias(r) for r in RULES)]
    lang, every = own.groupBy("g0").agg(*merged), own.agg(*merged)

    def wide(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{tag}_{c}") for c in df.columns))

    # one row per group, per language and in all: small beside the rows, and joined as Spark sees fit
    by = own.join(wide(lang, "l"), F.col("g0").eqNullSafe(F.col("l_g0"))).join(F.broadcast(wide(every, "e")), F.col("e_n") >= 0)
    pick = lambda c: F.when(F.col("n") >= least, F.col(c)).when(F.col("l_n") >= least, F.col(f"l_{c}")).otherwise(F.col(f"e_{c}"))
    used = by.select("g0", "g1", F.greatest("n", "l_n", "e_n").alias("n"), *(pick(r).alias(r) for r in RULES))
    ranks = {r: F.array(*map(F.lit, (0.25, 0.75, 0.5, TAILS[r][0] if r in TAILS else 0.75))) for r in RULES}
    out = used.select("g0", "g1", *(F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(r, ranks[r])).alias(r) for r in RULES))
    fences = []
    for r in RULES:
        low, high = F.col(r)[0], F.col(r)[1]
        fences += [(low - spread * (high - low)).alias(f"{r}_low"), (high + spread * (high - low)).alias(f"{r}_high")]
    for r, (_, beyond, _) in TAILS.items():
        middle, far = F.col(r)[2], F.col(r)[3]
        fences.append((far + beyond * (far - middle)).alias(f"{r}_tail"))
    return written(out.select("g0", "g1", *fences), "quality-limits")


def within() -> Column:
    """Whether a row's ratios keep to the limits joined to it."""
    ok = F.lit(True)
    for r, (_, low, slack, short) in RULES.items():
        room = slack + short / F.sqrt(F.col("n_words"))
        ok = ok & (_ratio(r) <= F.col(f"{r}_high") + room)
        if low:
            ok = ok & (_ratio(r) >= F.col(f"{r}_low") - room)
    for r, (_, _, more) in TAILS.items():
        ok = ok & (F.col(RULES[r][0]) <= F.col(f"{r}_tail") * F.col("n_words") + more + 1e-9)
    return ok


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, spread: float = SPREAD) -> DataFrame:
    """One row per row: id, the counts, base_failed, kept; see the module."""
    counted = written(count_rows(df, id_col, text_col, (lang_col, source_col)), "quality-counts")
    fenced = limits(counted, least, spread)
    fenced = fenced.select(*(F.col(c).alias(f"of_{c}" if c in ("g0", "g1") else c) for c in fenced.columns))
    rows = counted.join(fenced, F.col("g0").eqNullSafe(F.col("of_g0")) & F.col("g1").eqNullSafe(F.col("of_g1")), "left")
    verdict = F.when(base_failed(), F.lit(False)).otherwise(F.coalesce(within(), F.lit(False)))
    return rows.select(F.col("id").alias(id_col), *COUNTS, base_failed().alias("base_failed"), verdict.alias("kept"))
