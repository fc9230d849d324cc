"""Secret scan: fixed patterns plus sliding-window Shannon entropy over candidate strings.

Candidates are maximal runs of the characters that keys are written in; what base
patterns have found in them, and known placeholders, are cut out, and the rest is
scanned. A window
of fixed width slides over each candidate; character counts are updated by one
entering and one leaving character, and with them the sum of ``c * log2(c)``, so a
step costs the same whatever the width. Each character class has its own entropy
threshold. Windows over the threshold are joined into spans. An allow list suppresses
identifiers, digests of known form and words.

Nulls and empty texts have no spans. Rows are scanned on their own, so repeated
rows and ties give repeated results, and any other columns are ignored. An empty
table gives an empty table. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds, in the order in which ties are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")

ASSIGN_RE = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
# Runs of 20 and 24 characters or more: in a run the leftmost match is the longest, so
# asking for the length in the pattern equals matching first and dropping short ones.
ACCESS_RE = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX_RE = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE_RE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

#: Character class, bits a character that a window must reach; 1 to 2 % of random windows of 20 stay below.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+"), 2.9),
    ("alnum", re.compile(r"[A-Za-z0-9]+"), 3.65),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.7),
)
#: Forms that are not secrets. A part of a candidate that matches one whole is left out.
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUIDs
    r"|[0-9+/_=-]+"  # numbers, dates, phone numbers, rules
    r"|(?:sha(?:1|256|384|512)|md5)-[A-Za-z0-9+/=]+"  # integrity digests
)
#: Placeholders, cut out of candidates.
PLACEHOLDER = re.compile(r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|EXAMPLE|example|0123456789|abcdefghijklmnop|ABCDEFGHIJKLMNOP")
#: Words without a digit, cut where the case rises: names and paths have longer ones than keys.
CASED = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
WORD_LENGTH = 3.0
WINDOW = 20


@cache
def _terms(width: int) -> list[float]:
    """k * log2(k) for the counts that a window can hold."""
    return [0.0, *(k * math.log2(k) for k in range(1, width + 2))]


def entropy_spans(s: str, width: int, bits: float) -> list[tuple[int, int]]:
    """Unions of the windows of ``width`` characters with at least ``bits`` of entropy."""
    counts: dict[str, int] = {}
    terms = _terms(width)
    total, spans, full = 0.0, [], math.log2(width)
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += terms[k + 1] - terms[k]
        if i >= width:
            old = s[i - width]
            k = counts[old]
            counts[old] = k - 1
            total += terms[k - 1] - terms[k]
        if i >= width - 1 and full - total / width >= bits - 1e-9:
            start = i - width + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def _words(s: str) -> bool:
    """Whether a string has no digit and falls into words."""
    if any(map(str.isdigit, s)):
        return False
    own = CASED.findall(s)
    return not own or sum(map(len, own)) >= WORD_LENGTH * len(own)


def _parts(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of a stretch without the sorted spans taken, which don't overlap each other."""
    k = bisect_right(taken, (start, start))
    k -= k > 0 and taken[k - 1][1] > start
    while k < len(taken) and taken[k][0] < end:
        if taken[k][0] > start:
            yield start, taken[k][0]
        start = max(start, taken[k][1])
        k += 1
    if start < end:
        yield start, end


def scan(text: str | None, window: int = WINDOW) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, kind, end), sorted; code points, end exclusive."""
    if not text:
        return [], []
    base = [(m.start(), 0, m.end()) for m in ASSIGN_RE.finditer(text) if m.end(2) - m.start(2) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS_RE.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX_RE.finditer(text)]
    base.sort()
    taken: list[tuple[int, int]] = []
    for a, _, b in base:
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    more = []
    for m in CANDIDATE_RE.finditer(text):
        if ALLOWED.fullmatch(m[0]):
            continue
        out = sorted([*((m.start() + p.start(), m.start() + p.end()) for p in PLACEHOLDER.finditer(m[0]))])
        for x, y in _parts(m.start(), m.end(), taken):
            for a, b in _parts(x, y, out):
                s = text[a:b]
                if b - a < window or ALLOWED.fullmatch(s) or _words(s):
                    continue
                bits = next(bits for _, own, bits in CLASSES if own.fullmatch(s))
                more += [(a + i, 3, a + j) for i, j in entropy_spans(s, window, bits)]
    return base, sorted(base + more)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``df``: (id, base array<struct>, spans array<struct>); see the module."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [scan(t, window) for t in b.column(1).to_pylist()]
            both = [[[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f[i]] for f in found] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(both[0], span), pa.array(both[1], span)], ["id", "base", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    s = "array<struct<kind:string,start:bigint,end:bigint>>"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, base {s}, spans {s}").withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of a scan, as DataFrame expressions over its spans."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.format_string("%s:%d:%d", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col,
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
