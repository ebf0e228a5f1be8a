"""Licence scan: texts, paragraphs and lines compared to licence templates by the Dice coefficient of their word-bigram sets.

Normal form: A-Z lower-cased, every other ASCII character than letters and digits a blank, "licence" spelled "license". A unit
of a document (the whole text, a paragraph between blank lines, a line) is compared only to templates whose bigram count lies
within the size bounds that the threshold allows: 2 * min(a, b) / (a + b) must reach it. A document whose own bigrams meet those
of no template is passed over, since a unit's bigrams are among its document's.

A null or empty text matches nothing, nor does a unit of fewer than two words. Of equal scores the first template by name wins.
Every row of the table gives a row, with null or repeated doc_id too; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallycell.llm.common import LOWER, slices, texts

THRESHOLD = 0.9

# Wording of public licences and of their usual notices.
TEMPLATES: dict[str, str] = {
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

_KEPT = LOWER.translate(bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)))
_PARAGRAPH = re.compile(rb"\n[ \t]*\n")


def words(data: bytes) -> list[bytes]:
    found = data.translate(_KEPT).split()
    return [b"license" if w == b"licence" else w for w in found] if b"licence" in found else found


def bigrams(found: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(found, found[1:], strict=False))


class Matcher:
    def __init__(self, templates: dict[str, str], threshold: float):
        made = sorted((len(b), name, b) for name, text in templates.items() if (b := bigrams(words(text.encode()))))
        self.sizes, self.names, self.sets = [x[0] for x in made], [x[1] for x in made], [x[2] for x in made]
        self.all = set().union(*self.sets)
        self.threshold = threshold

    def best(self, unit: set[tuple[bytes, bytes]]) -> tuple[float, str] | None:
        """Score and name of the template that fits best, if any reaches the threshold."""
        t, n, found = self.threshold, len(unit), None
        if n:
            # One more on either side than the bounds say: rounding may not shut out a template.
            low, high = bisect_left(self.sizes, n * t / (2 - t) - 1), bisect_right(self.sizes, n * (2 - t) / t + 1)
            for size, name, own in zip(self.sizes[low:high], self.names[low:high], self.sets[low:high], strict=True):
                dice = 2 * len(unit & own) / (n + size)
                if dice >= t and (found is None or (-dice, name) < (-found[0], found[1])):
                    found = dice, name
        return found

    def scan(self, data: bytes) -> list[tuple[str, int, str, float]]:
        """(scope, number of the unit, template, score) of every unit that matches; numbers count from 0."""
        whole = bigrams(words(data))
        if whole.isdisjoint(self.all):
            return []
        units = [("text", 0, whole)]
        units += [("paragraph", i, bigrams(words(x))) for i, x in enumerate(_PARAGRAPH.split(data))]
        units += [("line", i, bigrams(words(x))) for i, x in enumerate(data.split(b"\n"))]
        return [(scope, i, found[1], found[0]) for scope, i, unit in units if (found := self.best(unit))]


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _run(shape: Callable, templates: dict[str, str], threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in slices(batches):
            yield shape(batch.column("doc_id"), [matcher.scan(x) for x in texts(batch)])
    return run


def _spread(ids: pa.Array, found: list[list[tuple[str, int, str, float]]]) -> pa.RecordBatch:
    rows = [(i, *x) for i, xs in zip(ids.to_pylist(), found, strict=True) for x in xs]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "scope", "unit", "licence", "dice"])


def _summary(ids: pa.Array, found: list[list[tuple[str, int, str, float]]]) -> pa.RecordBatch:
    best = [min(((-x[3], x[2]) for x in xs), default=(0.0, None)) for xs in found]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([x[1] for x in best], pa.string()), pa.array([-x[0] + 0.0 for x in best], pa.float64()), pa.array([len(x) for x in found], pa.int64())],
        ["doc_id", "licence", "dice", "n_units"])


def licence_units(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, scope (text, paragraph or line), unit, licence, dice for every unit that matches a template."""
    return _plain(docs).mapInArrow(_run(_spread, templates, threshold), "doc_id long, scope string, unit long, licence string, dice double")


def licence_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence (best match or null), dice (0 without one), n_units (matching units) for every row of ``docs``."""
    return _plain(docs).mapInArrow(_run(_summary, templates, threshold), "doc_id long, licence string, dice double, n_units long")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_words(column: str) -> str:
    return (f"list_transform(regexp_extract_all(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: CASE WHEN w = 'licence' THEN 'license' ELSE w END)")


def _sql_bigrams(column: str) -> str:
    return f"list_distinct(list_transform(range(1, len({column})), lambda i: {column}[i] || ' ' || {column}[i + 1]))"


#: DuckDB twin of the registered query.
SQL = f"""
WITH t AS (SELECT name, {_sql_bigrams('w')} AS b FROM (SELECT name, {_sql_words('text')} AS w FROM (VALUES
  {', '.join(f'({_literal(n)}, {_literal(x)})' for n, x in TEMPLATES.items())}) v(name, text))),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT doc_id, text FROM d UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) FROM d
  UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))) FROM d),
b AS (SELECT doc_id, {_sql_bigrams('w')} AS b FROM (SELECT doc_id, {_sql_words('text')} AS w FROM u) WHERE len(w) > 1),
s AS (SELECT doc_id, name, 2.0::DOUBLE * len(list_intersect(b.b, t.b)) / (len(b.b) + len(t.b)) AS dice, b.b AS unit
  FROM b JOIN t ON 2.0 * least(len(b.b), len(t.b)) >= ({THRESHOLD} - 0.001) * (len(b.b) + len(t.b))),
m AS (SELECT doc_id, max(dice) AS dice FROM s WHERE dice >= {THRESHOLD} GROUP BY doc_id),
best AS (SELECT doc_id, min(name) AS licence FROM s JOIN m USING (doc_id, dice) GROUP BY doc_id),
units AS (SELECT doc_id, count(*) AS n_units FROM b WHERE EXISTS (SELECT 1 FROM t WHERE
  2.0::DOUBLE * len(list_intersect(b.b, t.b)) / (len(b.b) + len(t.b)) >= {THRESHOLD}) GROUP BY doc_id)
SELECT doc_id, licence, coalesce(dice, 0.0::DOUBLE) AS dice, coalesce(n_units, 0) AS n_units
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN units USING (doc_id)"""
