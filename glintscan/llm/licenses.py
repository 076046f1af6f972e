"""Licence scans, with DataFrame functions only.

Texts are normalised (lower case, everything but letters and digits is a space) and compared to licence
templates by the Dice coefficient of their sets of word bigrams. Compared are each line, each block of lines
between blank lines, and the whole text; and inside each of these the runs of as many words as a template has that
are placed where one of its marks (see below) would stand, so that a notice within a line or a header that touches
code is found. A coefficient of ``t`` bounds the size of a set to between
``t / (2 - t)`` and ``(2 - t) / t`` times the template's, so most templates are never compared; and at least
one of any ``b - ceil(t b / (2 - t)) + 1`` of a template's ``b`` bigrams must be there, so texts without a word
of those are not cut up at all. Neither bound loses a match.

A null or empty text has no match. Rows are scanned one by one; repeated rows have equal matches.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.functions.arrays import each

THRESHOLD = 0.8
#: Notices and short texts of public licences.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-2.0": "This program is licensed under the GNU General Public License, version 2",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def constant(grams: list[str]) -> Column:
    """The bigrams as a constant array; one literal is much quicker to plan than hundreds."""
    return F.split(F.lit("|".join(grams)), r"\|")


def marks(threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> list[str]:
    """Words or bigrams (as patterns) of which a text needs one to reach ``threshold`` with any template.

    Greedy cover: the word that stands in most of the bigrams still to be accounted for comes first. What words
    of six letters or more do not account for is added as whole bigrams.
    """
    left = []
    for text in (templates or TEMPLATES).values():
        grams = bigrams(text)
        left.append([set(grams), len(grams) - math.ceil(threshold * len(grams) / (2 - threshold) - 1e-9) + 1])
    found = []
    while any(need > 0 for _, need in left):
        gain: dict[str, int] = {}
        for grams, need in left:
            if need > 0:
                for w in {w for g in grams for w in g.split() if len(w) >= 6}:
                    gain[w] = gain.get(w, 0) + min(need, sum(w in g.split() for g in grams))
        if gain:
            word = max(gain, key=lambda w: (gain[w], w))
            found.append(word)
            hit = lambda g, w=word: w in g.split()
        else:
            gram = max((g for grams, need in left if need > 0 for g in grams), key=lambda g: (len(g), g))
            found.append(gram.replace(" ", "[^a-z0-9]+"))
            hit = lambda g, w=gram: g == w
        for row in left:
            row[1] -= sum(map(hit, row[0]))
            row[0] = {g for g in row[0] if not hit(g)}
    return found


def marked(lower: Column, threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> Column:
    """Whether a lower-cased text has a mark; the pattern is factored by first letter, so most places fail at once."""
    by: dict[str, list[str]] = {}
    for m in marks(threshold, templates):
        by.setdefault(m[0], []).append(m[1:])
    words = "|".join(f"{c}(?:{'|'.join(sorted(rest))})" for c, rest in sorted(by.items()))
    return lower.rlike(f"(?<![a-z0-9])(?:{words})(?![a-z0-9])")


def units(text: Column) -> Column:
    """Array of (line, unit): lines, blocks of lines and the whole text; ``line`` is the first line's number from 1."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("unit")))
    parts = F.split(text, r"\n[ \t\r]*\n")
    blocks = F.transform(F.filter(parts, lambda x: F.contains(x, F.lit("\n"))), lambda x: F.struct(F.lit(0).alias("line"), x.alias("unit")))
    whole = F.when(F.contains(text, F.lit("\n")), F.array(F.struct(F.lit(0).alias("line"), text.alias("unit")))).otherwise(F.expr("cast(array() as array<struct<line:int,unit:string>>)"))
    return F.concat(lines, blocks, whole)


def places(threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> list[tuple[str, str, int, int]]:
    """(template, word, its place, words of the template): where a template's words stand that a text is searched for."""
    single = {m for m in marks(threshold, templates) if "[" not in m}
    out = []
    for name, text in (templates or TEMPLATES).items():
        own = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
        rare = [i for i, w in enumerate(own) if w in single] or [0]
        out += [(name, own[i], i, len(own)) for i in rare]
    return out


def windows(words: Column, known: dict[str, list[str]], threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> Column:
    """The best (dice, license) among runs of words as long as a template, placed where one of its marks would stand; null under ``threshold``."""

    none = F.expr("cast(array() as array<struct<dice:double,license:string>>)")
    by: dict[str, list[tuple[str, int, int]]] = {}
    for name, word, at, length in places(threshold, templates):
        by.setdefault(word, []).append((name, at, length))

    def judge(i: Column, name: str, at: int, length: int) -> Column:
        grams = constant(known[name])
        own = F.slice(words, F.greatest(i - at, F.lit(1)), F.lit(length))
        pairs = F.array_distinct(F.zip_with(F.slice(own, F.lit(1), F.size(own) - 1), F.slice(own, F.lit(2), F.size(own) - 1), lambda a, b: F.concat_ws(" ", a, b)))
        return F.element_at(F.transform(F.array(pairs), lambda g: F.struct((2 * F.size(F.array_intersect(g, grams)) / (F.size(g) + F.size(grams))).alias("dice"), F.lit(name).alias("license"))), 1)

    def of(word: str) -> Column:
        where = F.filter(F.transform(words, lambda w, i: F.when(w == word, i + 1)), lambda i: i.isNotNull())
        told = F.flatten(F.transform(where, lambda i: F.array(*(judge(i, *place) for place in by[word]))))
        # to look for a word is much quicker than to number its places, and most are not there
        return F.when(F.array_contains(words, word), told).otherwise(none)

    found = [of(word) for word in by]
    return F.array_max(F.filter(F.concat(*found), lambda x: x["dice"] >= threshold))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, dice, line): the licences that a text holds, with the best coefficient and the first line that
    reaches it (0: a block or the whole text). A line or block counts for the template it is most like, and for the
    one that a run of its words is most like (ties: the last name)."""
    known = {k: g for k, v in (templates or TEMPLATES).items() if (g := bigrams(v))}
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = low * min(map(len, known.values())), high * max(map(len, known.values()))
    lower = F.lower(F.col(text).cast("string"))
    # as many words as bigrams, or more where bigrams repeat: only the lower bound holds for words
    rows = docs.filter(marked(lower, threshold, templates)).select(F.col(doc_id).alias("doc_id"), F.explode(units(lower)).alias("u")).select("doc_id", "u.line", F.explode(F.array(F.split(F.trim(F.regexp_replace("u.unit", "[^a-z0-9]+", " ")), " "))).alias("w"))
    rows = rows.filter(F.size("w") >= math.floor(least) + 1)
    pairs = F.array_distinct(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    # a single array that is exploded keeps the bigrams from being computed again for every template
    rows = rows.select("doc_id", "line", "w", F.explode(F.array(pairs)).alias("g")).filter(F.size("g") >= math.floor(least))
    judged = []
    for name, grams in known.items():
        fits = F.size("g").between(math.ceil(low * len(grams) - 1e-9), math.floor(high * len(grams) + 1e-9))
        dice = 2 * F.size(F.array_intersect("g", constant(grams))) / (F.size("g") + len(grams))
        judged.append(F.when(fits, F.struct(F.lit(name).alias("license"), dice.alias("dice"))))
    best = F.array_max(F.transform(F.filter(F.array(*judged), lambda x: x["dice"] >= threshold), lambda x: F.struct(x["dice"].alias("dice"), x["license"].alias("license"))))
    whole = F.when(F.size("g") <= math.ceil(most), best)
    hits = each(rows, F.array_compact(F.array(whole, windows(F.col("w"), known, threshold, templates))), "h", "doc_id", "line")
    return hits.groupBy("doc_id", F.col("h.license").alias("license")).agg(F.max("h.dice").alias("dice"), F.min_by("line", F.struct(-F.col("h.dice"), F.col("line") == 0, "line")).alias("line"))
