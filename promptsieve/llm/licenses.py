"""Licence scan: normalised text against licence templates by the Dice coefficient of word bigrams.

Units of a text are its lines, its paragraphs (parted by blank lines) and the whole. A unit is reduced to ASCII
letters and digits in lower case, one space between words, and to its set of word bigrams. The
Dice coefficient 2c / (a + b) can reach t only if a and b are within the factor (2 - t) / t of each
other, so units whose bigram count is out of reach of every template are dropped by counting their words,
before any bigram is made, and a unit meets only templates within its reach. Texts without any of the
words that a match must contain are passed over by plain substring search. The meeting is a join on
bigrams with the broadcast table of the templates' bigrams, a few hundred rows; only bigrams that a
template has survive it, so counting shared ones moves little, and a licence line that a third of
all documents repeat costs one row per document.

Defined results: null, empty and short texts have no bigrams and match nothing; equal units of one
document (a line that is repeated, a text of one line) are reported once each, by kind and number;
ties between templates are all reported.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8

# Licence notices, as published.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "mit": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
        "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "bsd": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."),
    "lgpl-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, "
        "or (at your option) any later version."),
    "agpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
        "to this work."),
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software."),
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "reserved": "All rights reserved.",
}


def normalised(text: Column) -> Column:
    """ASCII letters and digits in lower case, single spaces between."""
    return F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))


def bigrams(words: Column) -> Column:
    """Distinct word bigrams of an array of words, sorted by nothing."""
    return F.array_distinct(F.transform(
        F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"),
                     F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b")),
        lambda p: F.concat(p["a"], F.lit(" "), p["b"])))


def template_bigrams(templates: dict[str, str]) -> list[tuple[str, int, str]]:
    """(template, its number of bigrams, bigram) rows."""
    import re

    rows = []
    for name, text in templates.items():
        words = re.sub("[^A-Za-z0-9]+", " ", text).strip().lower().split(" ")
        found = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
        rows += [(name, len(found), b) for b in found]
    return rows


def required(rows: list[tuple[str, int, str]], least: float, shortest: int = 5) -> tuple[list[str], list[str]]:
    """Words and bigrams of which every unit that reaches ``least`` with any template contains one.

    Such a unit shares t / (2 - t) of the template's bigrams at least. So it has one of any words that
    leave fewer bigrams without them; they are chosen among words of ``shortest`` letters or more,
    long ones first, which prose rarely has. A template without enough such words is known by as many
    of its longest bigrams as leave too few others.
    """
    pairs: dict[str, list[str]] = {}
    for name, _, bigram in rows:
        pairs.setdefault(name, []).append(bigram)
    words: set[str] = set()
    bigrams_: set[str] = set()
    for every in pairs.values():
        left, need, chosen = [b.split(" ") for b in every], len(every) * least / (2 - least), []
        while len(left) >= need:
            counts = Counter(w for p in left for w in set(p) if len(w) >= shortest)
            if not counts:
                break
            chosen.append(max(counts, key=lambda w: (counts[w] * min(len(w), 8) ** 3, w)))
            left = [p for p in left if chosen[-1] not in p]
        if len(left) < need and len(every) > 12:
            words.update(chosen)
        else:
            missing = len(every) - math.ceil(need)
            bigrams_.update(sorted(every, key=lambda b: (-len(b), b))[:missing + 1])
    return sorted(words), sorted(bigrams_)


def _telling(text: Column, rows: list[tuple[str, int, str]], least: float) -> Column:
    """Whether a lower-case text has one of the required words or bigrams; words are looked for as substrings."""
    words, pairs = required(rows, least)
    tests = [text.contains(w) for w in words]
    for pair in pairs:
        a, b = pair.split(" ")
        tests.append(text.contains(max(a, b, key=len)) & text.rlike(f"{a}[^a-z0-9]+{b}"))
    return reduce(or_, tests)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST,
         templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(key, ``unit``, ``unit_no``, ``license``, ``n_bigrams``, ``shared``, ``dice``) of every unit that reaches
    ``least`` with a template; rows of the input that repeat are scanned each."""
    rows = template_bigrams(templates)
    table = F.broadcast(docs.sparkSession.createDataFrame(rows, "license string, theirs int, bigram string"))
    sizes = [n for _, n, _ in rows]
    reach = (2 - least) / least
    fewest, most = min(sizes) / reach, max(sizes) * reach
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def units(kind, parts):
        return F.transform(parts, lambda part, i: F.struct(F.lit(kind).alias("unit"), i.alias("unit_no"), part.alias("part")))

    telling = _telling(F.lower(whole), rows, least)
    # A unit of w words has w - 1 bigrams, equal ones included; so many distinct ones are needed at least.
    cut = docs.where(telling).select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.explode(F.concat(
        units("line", F.split(whole, r"\n")), units("paragraph", F.split(whole, r"\n[ \t\r]*\n")),
        units("text", F.array(whole)))).alias("u"))
    worded = cut.select("row", "key", "u.unit", "u.unit_no", F.split(normalised(F.col("u.part")), " ").alias("words")) \
        .filter(F.size("words") - 1 >= fewest)
    counted = worded.withColumn("bigrams", bigrams(F.col("words"))).withColumn("n_bigrams", F.size("bigrams")) \
        .filter(F.col("n_bigrams").between(fewest, most))
    met = counted.select("row", "key", "unit", "unit_no", "n_bigrams", F.explode("bigrams").alias("bigram")) \
        .join(table, "bigram").filter((F.col("n_bigrams") <= F.col("theirs") * reach) & (F.col("theirs") <= F.col("n_bigrams") * reach))
    shared = met.groupBy("row", "key", "unit", "unit_no", "n_bigrams", "license", "theirs").agg(F.count("*").alias("shared"))
    dice = 2 * F.col("shared") / (F.col("n_bigrams") + F.col("theirs"))
    return shared.withColumn("dice", dice).filter(F.col("dice") >= least).select(
        F.col("key").alias(key), "unit", "unit_no", "license", "n_bigrams", "shared", "dice")


def oracle(least: float = LEAST, templates: dict[str, str] = TEMPLATES) -> str:
    values = ", ".join(f"('{name}', {n}, '{b}')" for name, n, b in template_bigrams(templates))
    return rf"""
with templates(license, theirs, bigram) as (values {values}),
units as (
  select doc_id, 'line' as unit, unnest(range(len(p))) as unit_no, unnest(p) as part
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as p from documents)
  union all
  select doc_id, 'paragraph', unnest(range(len(p))), unnest(p)
  from (select doc_id, regexp_split_to_array(coalesce(text, ''), '\n[ \t\r]*\n') as p from documents)
  union all select doc_id, 'text', 0, coalesce(text, '') from documents),
worded as (
  select doc_id, unit, unit_no,
         string_split(trim(lower(regexp_replace(part, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') as words from units),
sets as (
  select doc_id, unit, unit_no,
         list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as bigrams
  from worded where len(words) > 1),
met as (
  select s.doc_id, s.unit, s.unit_no, len(any_value(bigrams)) as n_bigrams, t.license, any_value(theirs) as theirs, count(*) as shared
  from (select doc_id, unit, unit_no, bigrams, unnest(bigrams) as bigram from sets) s join templates t using (bigram)
  group by s.doc_id, s.unit, s.unit_no, t.license)
select doc_id, unit, cast(unit_no as integer) as unit_no, license, cast(n_bigrams as integer) as n_bigrams, shared,
       2 * shared / (n_bigrams + theirs) as dice
from met where 2 * shared / (n_bigrams + theirs) >= {least}"""
