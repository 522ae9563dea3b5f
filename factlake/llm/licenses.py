"""Licence scans: Dice coefficient over word bigrams against licence templates, in DataFrame functions only."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIMILARITY = 0.8

# Licence notices and texts as their licences word them.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited."),
]

_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {2}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "

#: Full texts of licences of which TEMPLATES has a part.
FULL_TEXTS: list[tuple[str, str]] = [("BSD-3-Clause", _BSD.format("1. ", "2. ", "3. " + _NAMES)), ("BSD-2-Clause", _BSD.format("1. ", "2. ", ""))]


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a normalised text, in order: the rule that the DataFrame functions below follow too."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(" ".join(x) for x in zip(words, words[1:])))


def template_rows(templates: list[tuple[str, str]], least: float) -> list[dict]:
    """Per template its bigrams, their number and the numbers that a text of at least that coefficient can have."""
    out = []
    for name, text in templates:
        own = bigrams_of(text)
        out.append({"name": name, "own": own, "n": len(own), "lo": ceil(least / (2 - least) * len(own) - 1e-9), "hi": floor((2 - least) / least * len(own) + 1e-9)})
    return out


def signal_bigrams(rows: list[dict], least: float) -> list[str]:
    """Bigrams of which every match of any template has one: a match shares least / (2 - least) of a template's bigrams at
    least, so it has one of any n - that + 1 of them, and these are chosen with the longest words."""
    out = set()
    for t in rows:
        own = sorted(t["own"], key=lambda b: (-min(map(len, b.split())), -len(b), b))
        out.update(own[: t["n"] - t["lo"] + 1])
    return sorted(out)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: what a lambda names more than once is computed each time otherwise."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def _bigrams(unit: Column) -> Column:
    return F.array_distinct(_let(F.filter(F.split(unit, " "), lambda w: w != ""), _pairs))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_matches (units that match a template), license and dice (the best match; equal
    ones by name), licenses (all matched, sorted, comma-joined).

    Units are a text's lines, its paragraphs and the whole of it, each once. Texts are lower-cased, and what isn't a-z or 0-9
    parts words. Null and empty texts, and those with no match, have 0, null, null and an empty string; repeated rows give repeated
    rows, an empty table none; other columns aren't read. There is no shuffle: all is decided in the row. Texts, and then units, that hold
    none of the signal bigrams go no further than that test, whose cost follows the length of the text."""
    rows = template_rows(templates or TEMPLATES, least)
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<name:string,own:array<string>,n:int,lo:int,hi:int>>")
    clean = F.regexp_replace(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "[^a-z0-9\n]+", " ")
    whole = F.translate("clean", "\n", " ")
    low, high = min(t["lo"] for t in rows), max(t["hi"] for t in rows)
    signals = signal_bigrams(rows, least)
    signs = F.from_json(F.lit(json.dumps(signals)), "array<string>")
    # first by words, of which each signal has two, then by the bigrams of the whole text: a unit's are among them
    firsts = F.from_json(F.lit(json.dumps(sorted({max(b.split(), key=len) for b in signals}))), "array<string>")
    some = _let(F.split(whole, " "), lambda words: F.arrays_overlap(words, firsts) & F.arrays_overlap(_let(F.filter(words, lambda w: w != ""), _pairs), signs))
    units = F.array_distinct(F.transform(
        F.concat(F.split("clean", "\n"), F.split("clean", "\n ?\n[ \n]*"), F.array(F.col("clean"))), lambda u: F.trim(F.regexp_replace(F.translate(u, "\n", " "), " +", " "))
    ))
    sized = F.filter(F.transform(units, _bigrams), lambda b: (F.size(b) >= max(low, 1)) & (F.size(b) <= high) & F.arrays_overlap(b, signs))

    def scores(b: Column) -> Column:
        fit = F.filter(table, lambda t: (F.size(b) >= t["lo"]) & (F.size(b) <= t["hi"]))
        dice = F.transform(fit, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(b, t["own"])) / (F.size(b) + t["n"])).alias("dice"), t["name"].alias("name")))
        return F.filter(dice, lambda s: s["dice"] >= least)

    none = F.array().cast("array<array<struct<dice:double,name:string>>>")
    hits = F.when(some, F.filter(F.transform(sized, scores), lambda s: F.size(s) > 0)).otherwise(none)
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), clean.alias("clean")).select("doc_id", hits.alias("hits")).select("doc_id", "hits", F.flatten("hits").alias("flat"))
    best = F.element_at(F.array_sort(F.transform("flat", lambda s: F.struct((-s["dice"]).alias("less"), s["name"].alias("name")))), 1)
    found = found.select("doc_id", F.size("hits").cast("long").alias("n_matches"), F.when(F.size("flat") > 0, best).alias("best"), F.array_join(F.array_sort(F.array_distinct(F.transform("flat", lambda s: s["name"]))), ",").alias("licenses"))
    return found.select("doc_id", "n_matches", F.col("best.name").alias("license"), (-F.col("best.less")).alias("dice"), "licenses")


def scan_passages(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs, as scan_licenses gives it, but over all runs of words of template size wherever they begin
    and end: licences of several paragraphs inside a longer text, and notices within a line or wrapped over lines of prose.
    n_matches counts templates with such a run. By default also full licence texts are templates.

    A text goes on to a template only if it has enough of its bigrams for a match. Another of them beside a run never makes its
    coefficient smaller, so the best run begins and ends where a stretch of the template's bigrams does, and
    only those are scored: one stretch alone at any length, several together up to the template's upper size in words."""
    rows = template_rows(templates or TEMPLATES + FULL_TEXTS, least)
    for t, (_, text) in zip(rows, templates or TEMPLATES + FULL_TEXTS):
        t["long"] = floor((2 - least) / least * (len(re.sub("[^a-z0-9]+", " ", text.lower()).split()) - 1) + 1e-9)
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<name:string,own:array<string>,n:int,lo:int,hi:int,long:int>>")
    every = F.array(*map(F.lit, sorted({b for t in rows for b in t["own"]})))
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    n = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", F.lit(1), n), F.slice("words", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))

    def best(pairs: Column, t: Column) -> Column:
        def over(at: Column) -> Column:  # places of the template's bigrams, from 1 on
            begins = F.filter(at, lambda p, k: (k == 0) | (F.get(at, k - 1) != p - 1))
            ends = F.filter(at, lambda p, k: (k == F.size(at) - 1) | (F.get(at, k + 1) != p + 1))
            return _let(begins, lambda begins: _let(ends, lambda ends: spans(begins, ends)))

        def spans(begins: Column, ends: Column) -> Column:
            def from_(a: Column, k: Column) -> Column:
                near = F.filter(F.slice(ends, k + 1, t["long"]), lambda e: (e - a + 1 >= t["lo"]) & ((e - a + 1 <= t["long"]) | (e == F.get(ends, k))))
                return F.transform(near, lambda e: _let(F.slice(pairs, a, e - a + 1), lambda own: F.lit(2.0) * F.size(F.array_intersect(own, t["own"])) / (F.size(F.array_distinct(own)) + t["n"])))

            return F.array_max(F.flatten(F.transform(begins, from_)))

        at = F.filter(F.transform(pairs, lambda b, i: F.when(F.array_contains(t["own"], b), i + 1).otherwise(0)), lambda p: p > 0)
        return F.struct(_let(at, over).alias("dice"), t["name"].alias("name"))

    def scores(pairs: Column) -> Column:
        def fit(some: Column) -> Column:
            return F.filter(table, lambda t: (F.size(some) >= t["lo"]) & (F.size(F.array_intersect(some, t["own"])) >= t["lo"]))

        return F.filter(F.transform(_let(F.array_intersect(pairs, every), fit), lambda t: best(pairs, t)), lambda s: s["dice"] >= least)

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words")).select("doc_id", _let(pairs, scores).alias("flat"))
    first = F.element_at(F.array_sort(F.transform("flat", lambda s: F.struct((-s["dice"]).alias("less"), s["name"].alias("name")))), 1)
    found = found.select("doc_id", F.size("flat").cast("long").alias("n_matches"), F.when(F.size("flat") > 0, first).alias("best"), F.array_join(F.array_sort(F.array_distinct(F.transform("flat", lambda s: s["name"]))), ",").alias("licenses"))
    return found.select("doc_id", "n_matches", F.col("best.name").alias("license"), (-F.col("best.less")).alias("dice"), "licenses")


def oracle(templates: list[tuple[str, str]] | None = None, least: float = SIMILARITY) -> str:
    """The same in plain SQL over all units and templates."""
    rows = template_rows(templates or TEMPLATES, least)
    values = ", ".join(f"({k}, '{t['name']}', {t['n']}, [{', '.join(repr(b) for b in t['own'])}])" for k, t in enumerate(rows))
    return f"""
    WITH t(k, name, n, own) AS (VALUES {values}),
    c AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') AS clean FROM documents),
    u AS (SELECT DISTINCT r, trim(regexp_replace(replace(unit, chr(10), ' '), ' +', ' ', 'g')) AS unit FROM
          (SELECT r, unnest(list_concat(string_split(clean, chr(10)), list_concat(regexp_split_to_array(clean, '\n ?\n[ \n]*'), [clean]))) AS unit FROM c)),
    w AS (SELECT r, unit, list_filter(string_split(unit, ' '), lambda x: x <> '') AS words FROM u),
    b AS (SELECT r, unit, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS own FROM w WHERE len(words) > 1),
    s AS (SELECT b.r, b.unit, t.name, 2.0::DOUBLE * len(list_intersect(b.own, t.own)) / (len(b.own) + t.n) AS dice FROM b, t
          WHERE len(b.own) >= {least} / (2 - {least}) * t.n - 1e-9 AND len(b.own) <= (2 - {least}) / {least} * t.n + 1e-9),
    h AS (SELECT * FROM s WHERE dice >= {least}),
    g AS (SELECT r, count(DISTINCT unit) AS n_matches, arg_min(name, (-dice, name)) AS license, max(dice) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM h GROUP BY r)
    SELECT c.doc_id, coalesce(g.n_matches, 0)::BIGINT AS n_matches, g.license, g.dice, coalesce(g.licenses, '') AS licenses FROM c LEFT JOIN g USING (r)
    """
