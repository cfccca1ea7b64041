"""Licence scan: Dice coefficient over word bigrams against licence templates.

A text is compared as a whole, by paragraphs and by lines; each unit is folded to
lower case with every run of other characters than letters and digits as one
space, and becomes the set of its word bigrams. With ``a`` and ``b`` bigrams the
coefficient is at most ``2 * min(a, b) / (a + b)``, so a threshold ``t`` admits
only templates with ``a * t / (2 - t) <= b <= a * (2 - t) / t``: the rest is never
compared. Of the templates that reach the threshold the best one counts, the first
by name among equals. Everything is a column expression over one row: nothing is
shuffled.

Nulls: a null text has no units, a null key stays null. Units of fewer than two
words have no bigrams and match nothing. Rows that repeat come back each. An empty
table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
OTHER = r"[^\p{L}\p{N}]+"
PARAGRAPH = r"\n[ \t\r]*\n"

# The notices by which works name their licence, and the short texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        " an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for"
        " the specific language governing permissions and limitations under the License.",
    ),
    ("BSD", "Released under the BSD License."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met:",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,"
        " and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def sized() -> list[tuple[str, list[str]]]:
    """Templates with their bigram sets."""
    return [(name, _bigrams(text)) for name, text in TEMPLATES]


def _once(value: Column, step) -> Column:
    """``step(value)`` with the value computed once, however often the step names it."""
    return F.element_at(F.transform(F.array(value), step), 1)


def _bigrams_of(words: Column) -> Column:
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.size(words) - 1),
        F.slice(words, F.lit(2), F.size(words) - 1),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.array_distinct(pairs)


def _scores(grams: Column) -> Column:
    """The best template of a unit as a struct of score and name; null if none is near."""
    a = F.size(grams)
    found = []
    for name, template in sized():
        b = len(template)
        fits = (a >= b * THRESHOLD / (2 - THRESHOLD)) & (a <= b * (2 - THRESHOLD) / THRESHOLD)
        both = F.size(F.array_intersect(grams, F.array(*map(F.lit, template))))
        found.append(F.when(fits, F.struct((-(2.0 * both) / (a + b)).alias("less"), F.lit(name).alias("licence"))))
    return F.array_min(F.filter(F.array(*found), lambda f: f.isNotNull() & (f.less <= -THRESHOLD)))


def _best(unit: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(unit), OTHER, " ")), " ")
    least = min(len(t) for _, t in sized()) * THRESHOLD / (2 - THRESHOLD)
    # A unit has no more bigrams than pairs of neighbours: too few are too few.
    return _once(words, lambda w: F.when(F.size(w) - 1 >= least, _once(_bigrams_of(w), _scores)))


def _units(text: Column) -> Column:
    """Lines, paragraphs if there are several, and the whole text if it has several lines."""
    kind = "array<struct<unit:string,place:int,text:string>>"

    def numbered(name: str, parts: Column) -> Column:
        return F.transform(parts, lambda p, i: F.struct(F.lit(name).alias("unit"), i.alias("place"), p.alias("text")))

    lines, paragraphs = F.split(text, "\n"), F.split(text, PARAGRAPH)
    none = F.array().cast(kind)
    return F.concat(
        numbered("line", lines).cast(kind),
        F.when(F.size(paragraphs) > 1, numbered("paragraph", paragraphs).cast(kind)).otherwise(none),
        F.when(F.size(lines) > 1, numbered("text", F.array(text)).cast(kind)).otherwise(none),
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per unit that states a licence: ``key, unit, place, licence, score``."""
    judged = F.transform(
        _units(F.col(text)), lambda u: F.struct(u.unit.alias("unit"), u.place.alias("place"), _best(u.text).alias("best"))
    )
    # The outer form: the plain one would add a filter that evaluates everything twice.
    found = docs.select(F.col(key), F.explode_outer(F.filter(judged, lambda u: u.best.isNotNull())).alias("u"))
    return found.where(F.col("u").isNotNull()).select(
        key, "u.unit", "u.place", F.col("u.best.licence").alias("licence"), F.round(-F.col("u.best.less"), 6).alias("score")
    )
