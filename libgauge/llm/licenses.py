"""Licence scan: normalised text against licence templates, in DataFrame expressions only.

Normalising lower-cases A-Z and turns every run of other ASCII characters than letters and digits
into one space.  Each line of a document, and the whole document if it has several lines, is a unit;
its bag of word bigrams is compared with each template's by the Dice coefficient
2 * common / (unit + template).  A unit of n words has n - 1 bigrams, so before any bigram is built
the bounds  t / (2 - t) <= unit / template <= (2 - t) / t  prune templates and units.

A notice may also begin and end anywhere: wrapped over lines, in the middle of a document or of a
line.  For each template the windows of consecutive words, across lines, that begin and end with one
of its bigrams are compared too.  A window has one of the template's less common words and, inside the
upper bound, as many of its bigrams as the lower bound says; other texts and places are passed over.
From each beginning the best window counts; windows that touch a line (or whole text) which matches
the template are not counted beside it, unless they span lines and match better than that line; of windows of one template that end at the same word only the best is, and then
of those that overlap.

Defined results: a null or empty text has no units and no licence; of several matches the greatest
coefficient counts, then the earliest unit (the whole text, -1, first; a window is numbered as the
line it begins in), then the first template;
repeated rows are scanned each on its own; an empty table gives an empty result; other columns are
ignored.  Texts of any length are taken whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import as_columns

THRESHOLD = 0.8

# Notices and short licence texts as their licences word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT-notice", "This project is licensed under the terms of the MIT license."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0-text", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher."),
    # Relatives that differ from the above, and from each other, in a word or two.
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-1.0-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."),
    ("GPL-2.0-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0-only-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0-only-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.0-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-header", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters other than letters and digits; other characters belong to words.
BREAKS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


#: Words too common to look a text up by.
COMMON = frozenset("a all an and any as at be by can do for from have if in is it may no not of on or that the this to was with you".split())


def template_words(text: str) -> list[str]:
    return re.sub(BREAKS, " ", text.translate(str.maketrans(UPPER, LOWER))).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def _tagged(bigrams: list[str]) -> list[str]:
    seen: Counter = Counter()
    out = []
    for b in bigrams:
        seen[b] += 1
        out.append(f"{b}#{seen[b]}")
    return out


MATCHES = "array<struct<dice:double,before:int,rank:int,license:string>>"


def _sought(bigrams: list[str], need: int) -> set[str]:
    """Words of which a text has at least one if it has ``need`` of the bigrams."""
    words = {w for b in bigrams for w in b.split(" ")}
    return words - COMMON if sum(COMMON.issuperset(b.split(" ")) for b in bigrams) < need else words


def _windows(hits: Column, matches: Column, rank: int, name: str, bigrams: list[str], lo: float, hi: float, threshold: float) -> Column:
    """The matches of one template that are windows; ``hits``: its bigrams in the text, by position."""
    need, most, often = math.ceil(lo), math.floor(hi), Counter(bigrams)
    many = sorted(b for b in often if often[b] > 1)
    times = lambda b: F.coalesce(*(F.when(b == x, often[x]) for x in many), F.lit(1))

    def ranked(h: Column, j: Column) -> Column:
        """A hit adds to what a window has in common unless ``full``, the hit that used its bigram up, is inside."""
        same = F.filter(F.slice(hits, F.greatest(j - most, F.lit(0)) + 1, F.least(j, F.lit(most))), lambda e: e["bigram"] == h["bigram"])
        full = F.when(F.size(same) >= times(h["bigram"]), same[F.size(same) - times(h["bigram"])]["at"]).otherwise(-1)
        return F.struct(h["at"].alias("at"), h["line"].alias("line"), h["end"].alias("end"), full.alias("full"))

    def best_from(seen: Column, s: Column, i: Column) -> Column:
        inside = F.filter(F.slice(seen, i + 1, most), lambda g: (g["at"] - s["at"] < most) & (g["full"] < s["at"]))
        dice = lambda g, r: F.lit(2.0) * (r + 1) / (g["at"] - s["at"] + F.lit(1 + len(bigrams))).cast("double")
        return F.array_min(F.transform(inside, lambda g, r: F.struct((-dice(g, r)).alias("less"), s["at"].alias("first"), g["at"].alias("last"), s["line"].alias("line"), g["end"].alias("end"))))

    def search(seen: Column) -> Column:
        dense = lambda s, i: F.coalesce(F.try_element_at(seen, i + need)["at"] - s["at"] < most, F.lit(False))
        starts = F.filter(F.transform(seen, lambda s, i: F.when(dense(s, i), best_from(seen, s, i))), lambda w: w.isNotNull() & (-w["less"] >= threshold))
        beaten = lambda m, w: (m["dice"] < -w["less"]) & (w["line"] < w["end"])
        taken = lambda w: F.exists(matches, lambda m: (m["rank"] == -rank) & ((m["before"] == 1) | (-m["before"]).between(w["line"], w["end"]) & ~beaten(m, w)))
        # Of the many beginnings of windows that end at one word the best is enough.
        by_end = F.array_sort(F.transform(F.filter(starts, lambda w: ~taken(w)), lambda w: F.struct(*(w[c].alias(c) for c in ("last", "less", "first", "line", "end")))))
        ends = F.transform(F.array(by_end), lambda all_: F.filter(all_, lambda w, i: (i == 0) | (F.get(all_, i - 1)["last"] != w["last"])))[0]
        free = F.array_sort(F.transform(ends, lambda w: F.struct(*(w[c].alias(c) for c in ("less", "first", "last", "line", "end")))))
        apart = F.aggregate(free, F.filter(free, lambda w: F.lit(False)), lambda acc, w: F.when(F.exists(acc, lambda a: (a["first"] <= w["last"]) & (w["first"] <= a["last"])), acc).otherwise(F.concat(acc, F.array(w))))
        return F.transform(apart, lambda w: F.struct((-w["less"]).alias("dice"), (-w["line"]).alias("before"), F.lit(-rank).alias("rank"), F.lit(name).alias("license")))

    near = F.exists(F.transform(hits, lambda h, i: F.try_element_at(hits, i + need)["at"] - h["at"] < most), lambda x: F.coalesce(x, F.lit(False)))
    return F.when(near, F.flatten(F.transform(F.array(F.transform(hits, ranked)), search))).otherwise(F.array().cast(MATCHES))


def scan(df: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license (null if none), dice, unit (line from 0, -1: whole text), n_matches."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    known = [(name, template_bigrams(text)) for name, text in templates]
    shapes = [(name, b, low * len(b) - 1e-9, high * len(b) + 1e-9) for name, b in known if b]
    least, most = min(s[2] for s in shapes), max(s[3] for s in shapes)
    sought = sorted(set().union(*(_sought(b, math.ceil(lo)) for _, b, lo, _ in shapes)))
    every, shortest = sorted({b for _, bigrams, *_ in shapes for b in bigrams}), min(len(s[1]) for s in shapes)

    words = lambda line: F.filter(F.split(F.translate(line, UPPER, LOWER), BREAKS), lambda w: w != "")
    heard = lambda w: F.exists(w, lambda x: x.isin(sought))
    fits = lambda n: ((n - 1) >= least) & ((n - 1) <= most)
    lines = df.select(*as_columns(id_col, text_col)).select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), words).alias("lines"))
    sized = lines.withColumn("total", F.aggregate("lines", F.lit(0), lambda acc, w: acc + F.size(w)))
    said = F.flatten(F.transform("lines", lambda w, i: F.transform(w, lambda x: F.struct(i.alias("line"), x.alias("word")))))
    sized = sized.withColumn("spoken", F.when(F.exists("lines", heard), said))
    nothing = F.array().cast("array<struct<unit:int,words:array<string>>>")
    whole = F.when((F.size("lines") > 1) & fits(F.col("total")), F.array(F.struct(F.lit(-1).alias("unit"), F.flatten("lines").alias("words")))).otherwise(nothing)
    units = sized.select("doc_id", "spoken", F.concat(whole, F.filter(F.transform("lines", lambda w, i: F.struct(i.alias("unit"), w.alias("words"))), lambda u: fits(F.size(u["words"])))).alias("units"))
    # a unit that matches has one of the sought words, as windows do
    units = units.withColumn("units", F.when(F.col("spoken").isNotNull(), F.filter("units", lambda u: heard(u["words"]))).otherwise(nothing))
    paired = units.select("doc_id", "spoken", F.transform("units", lambda u: F.struct(u["unit"].alias("unit"), F.zip_with(F.slice(u["words"], F.lit(1), F.size(u["words"]) - 1), F.slice(u["words"], F.lit(2), F.size(u["words"]) - 1), lambda a, b: F.concat(a, F.lit(" "), b)).alias("bigrams"))).alias("units"))
    # 2 * common >= threshold * (unit + template), and all that is common is among the templates' bigrams
    enough = lambda b: 2.0 * F.size(F.filter(b, lambda x: x.isin(every))) >= threshold * (F.size(b) + shortest) - 1e-9
    shared = paired.select("doc_id", "spoken", F.filter("units", lambda u: enough(u["bigrams"])).alias("units"))
    count = lambda bag, upto, x: F.size(F.filter(F.slice(bag, F.lit(1), upto + 1), lambda y: y == x))
    tagged = shared.select("doc_id", "spoken", F.transform("units", lambda u: F.struct(u["unit"].alias("unit"), F.transform(u["bigrams"], lambda x, i: F.concat(x, F.lit("#"), count(u["bigrams"], i, x).cast("string"))).alias("bigrams"))).alias("units"))

    def match(u: Column, rank: int, name: str, bigrams: list[str], lo: float, hi: float) -> Column:
        n = F.size(u["bigrams"])
        common = F.size(F.array_intersect(u["bigrams"], F.array(*map(F.lit, _tagged(bigrams)))))
        dice = F.when((n >= lo) & (n <= hi), F.lit(2.0) * common / (n + F.lit(len(bigrams))).cast("double")).otherwise(F.lit(0.0))
        return F.struct(dice.alias("dice"), (-u["unit"]).alias("before"), F.lit(-rank).alias("rank"), F.lit(name).alias("license"))

    found = tagged.select("doc_id", "spoken", F.filter(F.flatten(F.transform("units", lambda u: F.array(*(match(u, i, *s) for i, s in enumerate(shapes))))), lambda m: m["dice"] >= threshold).alias("matches"))
    pair = lambda a, b: F.struct(a["line"].alias("line"), b["line"].alias("end"), F.concat(a["word"], F.lit(" "), b["word"]).alias("bigram"))
    spans = F.zip_with(F.slice("spoken", F.lit(1), F.size("spoken") - 1), F.slice("spoken", F.lit(2), F.size("spoken") - 1), pair)
    placed = F.transform(spans, lambda x, i: F.struct(i.alias("at"), x["line"].alias("line"), x["end"].alias("end"), x["bigram"].alias("bigram")))
    hits = found.select("doc_id", "matches", F.when(F.col("spoken").isNotNull(), F.filter(placed, lambda h: h["bigram"].isin(sorted({b for _, bigrams, *_ in shapes for b in bigrams})))).alias("hits"))
    dealt = hits.select("doc_id", "matches", F.when(F.size("hits") > 0, F.array(*(F.filter("hits", lambda h: h["bigram"].isin(sorted(set(s[1])))) for s in shapes))).alias("hits"))  # noqa: B023
    spread = F.when(F.col("hits").isNotNull(), F.concat(*(_windows(F.col("hits")[i], F.col("matches"), i, *s, threshold) for i, s in enumerate(shapes)))).otherwise(F.array().cast(MATCHES))
    found = dealt.select("doc_id", F.concat("matches", spread).alias("matches"))
    best = found.withColumn("best", F.array_max("matches"))
    return best.select("doc_id", F.col("best.license").alias("license"), F.col("best.dice").alias("dice"), (-F.col("best.before")).alias("unit"), F.size("matches").cast("long").alias("n_matches"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    rows = ", ".join(f"({i}, '{name}', '{' '.join(template_words(text))}')" for i, (name, text) in enumerate(TEMPLATES))
    longest = math.floor((2 - THRESHOLD) / THRESHOLD * max(len(template_bigrams(text)) for _, text in TEMPLATES)) + 1
    breaks = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
    return rf"""
WITH templates(rank, license, words) AS (VALUES {rows}),
tb AS (SELECT rank, license, w[i] || ' ' || w[i + 1] AS bigram, count(*) AS n, any_value(len(w) - 1) AS size
  FROM (SELECT rank, license, w, unnest(range(1, len(w))) AS i FROM (SELECT rank, license, string_split(words, ' ') AS w FROM templates)) GROUP BY ALL),
lines AS (SELECT doc_id, row_number() OVER () AS row_id, string_split(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), chr(10)) AS l FROM documents),
parts AS (SELECT row_id, unnest(range(len(l))) AS unit, unnest(l) AS line FROM lines
  UNION ALL SELECT row_id, -1, array_to_string(l, ' ') FROM lines WHERE len(l) > 1),
units AS (SELECT row_id, unit, list_filter(regexp_split_to_array(line, '{breaks}'), lambda x: x <> '') AS w FROM parts),
small AS (SELECT * FROM units WHERE len(w) >= 3 AND len(w) <= {longest}),
ub AS (SELECT row_id, unit, w[i] || ' ' || w[i + 1] AS bigram, count(*) AS n, any_value(len(w) - 1) AS size
  FROM (SELECT row_id, unit, w, unnest(range(1, len(w))) AS i FROM small) GROUP BY ALL),
m AS (SELECT row_id, unit, rank, license, 2.0::DOUBLE * sum(least(ub.n, tb.n))::DOUBLE / (any_value(ub.size) + any_value(tb.size))::DOUBLE AS dice
  FROM ub JOIN tb USING (bigram) GROUP BY row_id, unit, rank, license HAVING 10 * sum(least(ub.n, tb.n)) >= 4 * (any_value(ub.size) + any_value(tb.size))),
best AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dice DESC, unit, rank) AS k, count(*) OVER (PARTITION BY row_id) AS n_matches FROM m)
SELECT doc_id, license, dice, unit::INTEGER AS unit, coalesce(n_matches, 0)::BIGINT AS n_matches
FROM lines LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (row_id)
"""


OP5_SQL = _sql()
