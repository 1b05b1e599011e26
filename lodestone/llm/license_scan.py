"""Licence scans by Dice coefficient over word bigrams (operator 2), in DataFrame functions only.

Text is cut into segments: sentences of lines; sentences of paragraphs, whose lines are joined first, as notices are wrapped; whole paragraphs of several sentences or lines; and the
whole text, for licence files. A line without a letter or digit, such as an empty line of a comment, ends a paragraph. A segment is
normalised (lower case, runs of other than letters and digits become one blank, so comment marks go) and taken as the set of its word
bigrams A. For a template with bigrams B, Dice is 2 |A & B| / (|A| + |B|). It can reach ``t`` only if
|A| lies between t / (2 - t) and (2 - t) / t times |B|, and then at least t / (2 - t) |B| bigrams are common. The latter gives key words: so many of each template's bigrams,
short or long, hold one of them that a segment without any cannot reach ``t``. So no pair that reaches ``t`` is left out.
Texts and segments without key words are dropped by plain substring tests,
segments outside all templates' size bounds before their bigrams are exploded, and the join checks the bounds of each template. The join's small side is the template table (bounded by
``MAX_BIGRAMS``; more templates are scanned in blocks of that size), which is broadcast; after it only bigrams of licences are left to be shuffled.

Templates are short notices, SPDX tags, heads of licence files, and paragraphs and whole bodies of the short licences. A segment whose best templates belong to different licences,
as half a sentence that two versions share, is undecided: it counts as a segment but names no licence.

Defined cases: null and empty texts have no licence; null ids pass through; rows that share an id are judged by their own texts; of decided segments the one with the greatest
Dice counts, then the first; a text with undecided ones alone has no licence; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
MAX_BIGRAMS = 20_000
#: Short notices as projects write them, and openings of well-known licence texts.
NOTICES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: The texts of short licences, paragraph by paragraph. Each paragraph and each whole text is a template.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
BODIES = {
    "BSD-2-Clause": (*_BSD, _BSD_END),
    "BSD-3-Clause": (*_BSD, _BSD_3, _BSD_END),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
}
_TAGS = tuple((name, f"SPDX-License-Identifier: {name}{end}") for name in sorted({n for n, _ in NOTICES}) for end in (("", "-only", "-or-later") if "GPL" in name else ("",)))
TEMPLATES = (*NOTICES, *_TAGS, *((name, p) for name, body in BODIES.items() for p in (*body, " ".join(body))))


def bigrams(text: str) -> list[str]:
    """The sorted set of word bigrams of a template."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and largest |A| for a template of ``size``; the guard keeps what lies on a bound."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


#: For the SQL alone: it compares templates of more bigrams than ``SHORT`` only with segments that hold one of these words, a cut that ``scan`` does not make.
SHORT = 12
GATES = ("license", "permission", "redistribution", "copyright", "warrant", "mozilla")
#: Words that are tried first as key words, as they are rare outside licences.
PREFERRED = ("license", "creative", "unencumbered", "spdx", "gnu", "cc", "bsd", "mozilla")
#: Words that are tried last, as nearly every text holds them.
COMMON = frozenset("a all an and any are as at be by can do for from has if in is it may no not of on or other that the this to was with you".split())


def key_words(templates: tuple[tuple[str, str], ...], threshold: float) -> list[str]:
    """Few words of which every text that reaches ``threshold`` on some template holds one: those of five letters or more anywhere in it, shorter ones as whole words.

    A template is settled when its bigrams without a key are fewer than must be common. Common words are taken last.
    """
    grams = [g for _, text in templates if (g := bigrams(text))]
    having: dict[str, set[str]] = {}  # bigrams by their words
    for g in itertools.chain(*grams):
        for w in g.split():
            having.setdefault(w, set()).add(g)
    held = functools.cache(lambda k: set().union(*(g for w, g in having.items() if k in w)) if len(k) >= 5 else having.get(k, set()))
    keys: list[str] = []
    met: set[str] = set()
    for own in sorted(grams, key=len):
        words = sorted({w for g in own for w in g.split()}, key=lambda k: (k in COMMON, k not in PREFERRED, len(k) < 5, -len(k) if len(k) < 5 else 0, -len(held(k)), -len(k), k))
        for k in ["", *[p for p in PREFERRED if not held(p).isdisjoint(own)], *words]:
            if k and k not in keys and not held(k) <= met:
                keys.append(k)
                met |= held(k)
            if len(set(own) - met) < bounds(len(own), threshold)[0]:
                break
    return keys


def holds(gram: str, keys: list[str]) -> bool:
    return any(k in gram if len(k) >= 5 else k in gram.split() for k in keys)


def _has(low: Column, keys: tuple[str, ...] | list[str]) -> Column:
    """Whether a text in lower case holds a key; the substring test comes before the one for whole words."""
    whole = lambda k: low.contains(k) & low.rlike(rf"(?<![\p{{L}}\p{{N}}]){k}(?![\p{{L}}\p{{N}}])")
    return functools.reduce(Column.__or__, [low.contains(k) if len(k) >= 5 else whole(k) for k in keys])


#: What ends a paragraph, a line inside one, and a sentence.
PARAGRAPH, LINE, SENTENCE = r"\n[^\p{L}\p{N}\n]*\n", r"\n[^\p{L}\p{N}]*", r"([.!?])[ \t]+"


def segments(text: Column) -> Column:
    """Sentences of lines; sentences of paragraphs of several lines, with the lines joined; paragraphs of several sentences or lines; the whole text, if it has several paragraphs."""
    cut = lambda c: F.split(F.regexp_replace(c, SENTENCE, "$1\n"), "\n")
    paragraphs = F.split(text, PARAGRAPH)
    wrapped = F.filter(paragraphs, lambda p: p.contains("\n"))
    joined = F.flatten(F.transform(wrapped, lambda p: cut(F.regexp_replace(p, LINE, " "))))
    blocks = F.filter(paragraphs, lambda p: p.rlike(r"[.!?][ \t]|\n"))
    return F.concat(cut(text), joined, blocks, F.when(F.size(paragraphs) > 1, F.array(text)).otherwise(F.array().cast("array<string>")))


def _grams(segment: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(segment, r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)))


def _blocks(templates: tuple[tuple[str, str], ...], threshold: float) -> list[list[tuple]]:
    """Rows of templates (number, licence, bigram, size, bounds) in blocks of at most ``MAX_BIGRAMS``, a template of more by itself."""
    out: list[list[tuple]] = [[]]
    for i, (name, text) in enumerate(templates):
        own = bigrams(text)
        if out[-1] and len(out[-1]) + len(own) > MAX_BIGRAMS:
            out.append([])
        out[-1] += [(i, name, g, len(own), *bounds(len(own), threshold)) for g in own]
    return out


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, n_segments) of every document: the best template, and how many segments reach the threshold."""
    spark = docs.sparkSession
    blocks = _blocks(templates, threshold)
    sizes = [r[4:] for block in blocks for r in block]
    lo, hi = min(x for x, _ in sizes), max(x for _, x in sizes)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_key", F.xxhash64("text"))
    keys = key_words(templates, threshold)
    cut = own.select("doc_id", "text_key", F.lower("text").alias("low")).where(_has(F.col("low"), keys))
    cut = cut.select("doc_id", "text_key", F.posexplode(segments(F.col("low"))).alias("segment", "s")).where(_has(F.col("s"), keys))
    grams = cut.select("doc_id", "text_key", "segment", _grams(F.col("s")).alias("grams")).withColumn("a", F.size("grams")).where(F.col("a").between(lo, hi))
    flat = grams.select("doc_id", "text_key", "segment", "a", F.explode("grams").alias("gram"))
    tables = [spark.createDataFrame(rows, "template int, license string, gram string, b int, lo int, hi int") for rows in blocks]
    met = functools.reduce(DataFrame.unionByName, [flat.join(F.broadcast(t), "gram").where("a >= lo and a <= hi") for t in tables])
    # The grams of one segment are distinct; those of repeated rows are met once more each.
    shared = met.groupBy("doc_id", "text_key", "segment", "template", "license", "a", "b").agg(F.size(F.collect_set("gram")).alias("c"))
    close = shared.withColumn("dice", 2 * F.col("c") / (F.col("a") + F.col("b"))).where(F.col("dice") >= threshold)
    one = close.groupBy("doc_id", "text_key", "segment", "dice").agg(F.min("license").alias("license"), F.max("license").alias("other"))
    each = one.groupBy("doc_id", "text_key", "segment").agg(F.max_by(F.struct("license", "other"), "dice").alias("best"), F.max("dice").alias("dice"))
    each = each.withColumn("license", F.when(F.col("best.license") == F.col("best.other"), F.col("best.license")))
    rank = F.when(F.col("license").isNotNull(), F.struct("dice", -F.col("segment")))
    best = each.groupBy("doc_id", "text_key").agg(F.max_by(F.struct("license", "dice"), rank).alias("best"), F.count("*").alias("n_segments"))
    out = own.select("doc_id", "text_key").alias("o").join(best.alias("b"), F.col("o.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("o.text_key") == F.col("b.text_key")), "left")
    return out.select("o.doc_id", F.col("b.best.license").alias("license"), F.col("b.best.dice").alias("dice"), F.coalesce("b.n_segments", F.lit(0)).cast("long").alias("n_segments"))


def oracle() -> str:
    """The same result as SQL for DuckDB, over a view ``documents``; but it leaves out pairs of a template of more than ``SHORT`` bigrams and a segment without ``GATES``."""
    t = THRESHOLD
    values = ", ".join(f"({i}, '{name}', '{g}', {len(own)})" for i, (name, text) in enumerate(TEMPLATES) for own in [bigrams(text)] for g in own)
    sentences = rf"string_split(regexp_replace({{}}, '{SENTENCE}', '\1' || chr(10), 'g'), chr(10))"
    return rf"""
WITH templates(template, license, gram, b) AS (VALUES {values}),
cut AS (
  SELECT doc_id, unnest(segs) AS s, unnest(range(1, len(segs) + 1)) AS segment FROM (
    SELECT doc_id, list_concat(list_concat({sentences.format("low")}, flatten(list_transform(list_filter(ps, lambda x: contains(x, chr(10))), lambda x: {sentences.format(f"regexp_replace(x, '{LINE}', ' ', 'g')")}))),
      list_concat(list_filter(ps, lambda x: regexp_matches(x, '[.!?][ \t]|\n')), CASE WHEN len(ps) > 1 THEN [low] ELSE [] END)) AS segs
    FROM (SELECT doc_id, lower(text) AS low, regexp_split_to_array(lower(text), '{PARAGRAPH}') AS ps FROM documents))),
worded AS (SELECT doc_id, segment, {' OR '.join(f"contains(s, '{g}')" for g in GATES)} AS gate, string_split(trim(regexp_replace(s, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM cut),
grams AS (SELECT doc_id, segment, gate, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM worded WHERE len(w) > 1),
met AS (SELECT doc_id, segment, gate, len(g) AS a, unnest(g) AS gram FROM grams),
shared AS (SELECT m.doc_id, m.segment, t.template, t.license, m.a, t.b, count(*) AS c FROM met m JOIN templates t USING (gram) WHERE gate OR b <= {SHORT} GROUP BY ALL),
near AS (SELECT *, 2 * c / (a + b) AS dice FROM shared WHERE 2 * c / (a + b) >= {t}),
sums AS (SELECT doc_id, segment, dice, min(license) AS lo, max(license) AS hi FROM near GROUP BY ALL),
each AS (SELECT doc_id, segment, dice, CASE WHEN lo = hi THEN lo END AS license FROM sums QUALIFY row_number() OVER (PARTITION BY doc_id, segment ORDER BY dice DESC) = 1),
counted AS (SELECT doc_id, count(*) AS n_segments FROM each GROUP BY doc_id),
best AS (SELECT * FROM each WHERE license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, segment) = 1)
SELECT d.doc_id, b.license, b.dice, CAST(coalesce(n_segments, 0) AS BIGINT) AS n_segments FROM documents d LEFT JOIN best b USING (doc_id) LEFT JOIN counted USING (doc_id)
"""
