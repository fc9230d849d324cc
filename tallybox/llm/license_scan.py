"""Licence scan: Dice coefficient over word bigrams against licence templates.

Each line of a text and the text as a whole are units. A unit is normalised (lower
case; runs of anything but letters and digits become one space), cut into words and
turned into its set of word bigrams. Only templates whose number of bigrams lies
within the bounds that the threshold allows are compared: for a Dice coefficient of
at least t, one size is at most (2 - t) / t times the other. A unit has at least as
many bigrams as distinct words less one, which rules long units out before their
bigrams are formed. DataFrame functions only; nothing is shuffled.

Between line and text there are passages: notices wrapped over lines of a longer text,
and sentences that share their line with others. What a matching line holds is set
aside, and the words of all other lines are read on. A template of which enough
bigrams occur there is laid on at each place of its anchors, so many of its longest
bigrams that a match must have one of them, and the window of its length is compared.
Windows that overlap are one passage, which takes its best template, the longer of
two that are equal. Work is in proportion to words. A text that matches as a whole
has no passages.

Null and empty texts match nothing. Repeated units of one text count once. The best
template has the highest coefficient, then the smallest name. An empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybox.llm.common import text_of

# Public licence notices and texts.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": "Released under the BSD 2-Clause License.",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-1.0": "Released into the public domain under CC0 1.0 Universal.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD = 0.8
SEPARATORS = r"[^\p{L}\p{N}]+"
BREAK = "|"  # not a word: no bigram of a template has it


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def _bounds(n: int, t: float) -> tuple[int, int]:
    return ceil(n * t / (2 - t) - 1e-9), floor(n * (2 - t) / t + 1e-9)


def _n_pairs(text: str) -> int:
    return len(re.sub(r"[\W_]+", " ", text.lower()).split()) - 1


def _anchors(text: str, t: float) -> dict[str, int]:
    """The longest bigrams of a template, so many that a match lacks not all of them, and the place where each first stands."""
    words, own = re.sub(r"[\W_]+", " ", text.lower()).split(), template_bigrams(text)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return {b: pairs.index(b) for b in sorted(own, key=lambda b: (-len(b), b))[: len(own) - _bounds(len(own), t)[0] + 1]}


def match_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: id, n_units, license_id, dice, licenses; see the module.

    n_units: distinct units that match, and passages. licenses: names of all templates matched,
    sorted, comma-joined. license_id is null and dice 0 where none matches.
    """
    known = {k: b for k, v in sorted(templates.items()) if (b := template_bigrams(v))}
    sizes = {k: _bounds(len(b), threshold) for k, b in known.items()}
    low, high = min(a for a, _ in sizes.values()), max(b for _, b in sizes.values())

    def words(unit: Column) -> Column:
        return F.split(F.trim(F.regexp_replace(F.lower(unit), SEPARATORS, " ")), " ")

    def bigrams(w: Column) -> Column:
        return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))

    def fit(w: Column) -> Column:
        return (F.size(w) > low) & (F.size(F.array_distinct(w)) <= high + 1)

    text = F.col("text")
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.select("id", F.transform(F.split(text, "\n"), words).alias("lines"), words(text).alias("whole"))
    units = F.filter(F.array_distinct(F.concat("lines", F.array("whole"))), fit)
    rows = rows.select("*", F.filter(F.transform(units, bigrams), lambda b: F.size(b).between(low, high)).alias("sets"))

    def scored(b: Column) -> Column:
        """Structs (coefficient, name) of the templates that fit a unit's size, null where not."""
        each = []
        for k, own in known.items():
            dice = F.size(F.array_intersect(b, F.array(*map(F.lit, own)))) * 2.0 / (F.size(b) + len(own))
            each.append(F.when(F.size(b).between(*sizes[k]), F.struct(dice.alias("dice"), F.lit(k).alias("name"))))
        return F.filter(F.array(*each), lambda m: m["dice"] >= threshold - 1e-12)

    def matched(w: Column) -> Column:
        return fit(w) & (F.size(scored(bigrams(w))) > 0)

    anchors = {k: _anchors(templates[k], threshold) for k in known}
    telling = F.array(*map(F.lit, sorted({max(a.split(), key=lambda w: (len(w), w)) for own in anchors.values() for a in own})))
    every = F.array(*map(F.lit, sorted({x for b in known.values() for x in b})))
    none = F.array().cast("array<string>")
    rest = F.flatten(F.transform("lines", lambda w: F.when(matched(w), F.array(F.lit(BREAK))).otherwise(w)))
    rest = F.when(F.arrays_overlap("whole", telling) & ~matched(F.col("whole")), F.filter(rest, lambda w: w != "")).otherwise(none)
    hits = rows.select("id", F.filter(F.transform("sets", scored), lambda h: F.size(h) > 0).alias("hits"), rest.alias("rest"))
    pairs = F.zip_with(F.slice("rest", 1, F.size("rest") - 1), F.slice("rest", 2, F.size("rest") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    hits = hits.select("id", "hits", F.when(F.size("rest") > 1, pairs).otherwise(none).alias("pairs"))
    hits = hits.select("*", F.array_intersect("pairs", every).alias("present"))

    def windows(k: str) -> Column:
        """Structs (start, end, low, less, name) of the places where the template may stand; low is the negative coefficient."""
        own, n = F.array(*map(F.lit, known[k])), _n_pairs(templates[k])
        marks, offsets = F.array(*map(F.lit, anchors[k])), F.array(*(F.lit(anchors[k][a]) for a in anchors[k]))

        def start(b: Column, i: Column) -> Column:
            at = F.array_position(marks, b)
            return F.when(at > 0, i - F.element_at(offsets, at.cast("int")))

        def window(s: Column) -> Column:
            held = F.array_distinct(F.slice("pairs", F.greatest(s, F.lit(0)) + 1, n + F.least(s, F.lit(0))))
            dice = F.size(F.array_intersect(held, own)) * 2.0 / (F.size(held) + len(known[k]))
            return F.struct(s.alias("start"), (s + n + 1).alias("end"), (-dice).alias("low"), F.lit(-n).alias("less"), F.lit(k).alias("name"))

        starts = F.array_distinct(F.filter(F.transform("pairs", start), lambda s: s.isNotNull()))
        enough = F.size(F.array_intersect("present", own)) >= _bounds(len(known[k]), threshold)[0]
        return F.when(enough, F.transform(starts, window)).otherwise(F.array().cast("array<struct<start:int,end:int,low:double,less:int,name:string>>"))

    found = F.flatten(F.array(*map(windows, known)))
    found = F.array_sort(F.filter(F.when(F.size("present") > 0, found), lambda m: m["low"] <= 1e-12 - threshold))

    def joined(so_far: Column, m: Column) -> Column:
        """One window more, by start: it joins the passage at hand or begins another."""
        rank = F.struct(m["low"].alias("low"), m["less"].alias("less"), m["name"].alias("name"))
        same = m["start"] < so_far["end"]
        return F.struct(
            F.greatest(so_far["end"], m["end"]).alias("end"), F.when(same, F.least(so_far["best"], rank)).otherwise(rank).alias("best"),
            F.when(same, so_far["n"]).otherwise(so_far["n"] + 1).alias("n"), F.when(same, so_far["done"]).otherwise(F.array_union(so_far["done"], F.array(so_far["best"]))).alias("done"),
        )

    ranked = "struct<low:double,less:int,name:string>"
    empty = F.struct(F.lit(-(10**9)).alias("end"), F.lit(None).cast(ranked).alias("best"), F.lit(0).alias("n"), F.array().cast(f"array<{ranked}>").alias("done"))
    passages = F.aggregate(F.coalesce(found, F.array().cast("array<struct<start:int,end:int,low:double,less:int,name:string>>")), empty, joined)
    hits = hits.select("id", "hits", passages.alias("passages"))
    more = F.filter(F.array_union("passages.done", F.array("passages.best")), lambda m: m.isNotNull())
    more = F.transform(more, lambda m: F.struct((-m["low"]).alias("dice"), m["name"].alias("name")))
    hits = hits.select("id", (F.size("hits") + F.col("passages.n")).cast("long").alias("n_units"), F.concat(F.flatten("hits"), more).alias("all"))
    best = F.array_min(F.transform("all", lambda m: F.struct((-m["dice"]).alias("low"), m["name"].alias("name"))))
    return hits.withColumn("best", best).select(
        F.col("id").alias(id_col), "n_units", F.col("best.name").alias("license_id"), F.coalesce(-F.col("best.low"), F.lit(0.0)).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("all", lambda m: m["name"]))), ",").alias("licenses"),
    )


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(k)}, [{', '.join(map(quoted, template_bigrams(v)))}])" for k, v in sorted(templates.items()))
    return rf"""
WITH t(name, own) AS (VALUES {rows}),
u AS (SELECT doc_id, unnest(list_append(string_split(coalesce(text, ''), chr(10)), coalesce(text, ''))) AS unit FROM documents),
w AS (SELECT DISTINCT doc_id, string_split(trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM u),
b AS (SELECT doc_id, w, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
m AS (SELECT doc_id, w, name, len(list_intersect(b, own)) * 2.0::DOUBLE / (len(b) + len(own)) AS dice FROM b JOIN t ON len(b) BETWEEN len(own) / 4 AND len(own) * 4),
h AS (SELECT * FROM m WHERE dice >= {threshold} - 1e-12),
g AS (SELECT doc_id, count(DISTINCT w) AS n_units, min_by(name, (-dice, name)) AS license_id, max(dice) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM h GROUP BY doc_id)
SELECT doc_id, coalesce(n_units, 0) AS n_units, license_id, coalesce(dice, 0.0)::DOUBLE AS dice, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN g USING (doc_id)
"""
