"""Operator 4: licence scans by Dice coefficient over word bigrams.

DataFrame functions only. A unit of text is normalised to lower-case words (so
comment marks and line breaks are gone); its distinct word bigrams A are compared
with those of every template T of comparable size: ``2 |A and T| / (|A| + |T|) >= t``
can hold only if ``|T| t / (2 - t) <= |A| <= |T| (2 - t) / t``, and if A and T share
``|T| t / (2 - t)`` bigrams. Units are each line, each block between blank lines,
the whole document, and windows: as many consecutive words as the template has,
from any of its bigrams on. The templates are constants of the plan: one
narrow pass, no join and no shuffle.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import text_of

DICE = 0.75

#: fixed values: notices by which works state their licence, and short licence texts
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                         "GNU General Public License as published by the Free Software Foundation, either version 3 of "
                         "the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the "
                         "GNU General Public License as published by the Free Software Foundation; either version 2 of "
                         "the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
            "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
            "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
            "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
            "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
            "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
            "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
            "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
            "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met: 1. Redistributions of source code must retain the "
                     "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions "
                     "in binary form must reproduce the above copyright notice, this list of conditions and the "
                     "following disclaimer in the documentation and/or other materials provided with the distribution. "
                     "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
                     "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
                     "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
                     "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
                     "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
                     "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
                     "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
                     "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met: 1. Redistributions of source code must retain the "
                     "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions "
                     "in binary form must reproduce the above copyright notice, this list of conditions and the "
                     "following disclaimer in the documentation and/or other materials provided with the distribution. "
                     "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
                     "endorse or promote products derived from this software without specific prior written permission. "
                     "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
                     "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
                     "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
                     "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
                     "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
                     "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
                     "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
                     "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
                   "language governing permissions and limitations under the License."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                         "GNU General Public License as published by the Free Software Foundation, either version 3 of "
                         "the License, or (at your option) any later version. This program is distributed in the hope "
                         "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                         "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
                         "more details. You should have received a copy of the GNU General Public License along with "
                         "this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the "
                         "GNU General Public License as published by the Free Software Foundation; either version 2 of "
                         "the License, or (at your option) any later version. This program is distributed in the hope "
                         "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                         "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
                         "more details. You should have received a copy of the GNU General Public License along with "
                         "this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth "
                         "Floor, Boston, MA 02110-1301 USA."),
]

#: words of ordinary prose: a text is not looked at closely for one of them if rarer words do
COMMON = frozenset("a all an and any as at be but by can copy for found free from have if in is it more not of on or other out "
                   "see the this that to under use was will with without work you your".split())

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a template, sorted."""
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def size_bounds(size: int, dice: float) -> tuple[float, float]:
    """Sizes of bigram sets that can reach ``dice`` with a template of ``size``."""
    return size * dice / (2 - dice), size * (2 - dice) / dice


def telling_words(bigrams: list[str], dice: float) -> list[str]:
    """Words of which any text that reaches ``dice`` holds one. Such a text has at
    least ``size * dice / (2 - dice)`` of the template's bigrams (by the lower size
    bound), so it cannot miss all of more bigrams than the rest; words that touch
    so many are taken, rare and long ones and those that touch most first."""
    spare, left, out = len(bigrams) * (1 - dice / (2 - dice)), set(bigrams), []
    words = {w: {b for b in bigrams if w in b.split(" ")} for w in {w for b in bigrams for w in b.split(" ")}}
    while len(bigrams) - len(left) <= spare + 1e-9:
        w = min((w for w in words if words[w] & left),
                key=lambda w: (w in COMMON or w.isdigit(), len(w) < 6, -len(words[w] & left), -len(w), w))
        out.append(w)
        left -= words[w]
    return out


def template_rows(templates=None) -> list[tuple[int, str, list[str]]]:
    """(number, licence, bigrams) of the templates that have a bigram."""
    rows = [(k, name, bigrams_of(t)) for k, (name, t) in enumerate(TEMPLATES if templates is None else templates)]
    return [r for r in rows if r[2]]


def widths(templates=None) -> dict[int, int]:
    """Words of each template by its number."""
    return {k: len(re.sub("[^a-z0-9]+", " ", t.lower()).split())
            for k, (_, t) in enumerate(TEMPLATES if templates is None else templates)}


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def scan(docs: DataFrame, dice: float = DICE, templates=None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per unit and template that reach ``dice``: ``doc_id, unit`` ("line",
    "block", "document" or "window"), ``unit_no`` (from 0; of a window the place
    of its first word), ``template`` (number), ``license, dice``. Blocks are told
    only in texts with a blank line, the document only in texts of several lines.
    Of the windows of a text that reach ``dice`` with a template, the best is told,
    the first among equals; a window is shorter only at the end of the text. A text
    often reaches several templates (a licence with and without its disclaimer):
    all are told.

    Null, empty and blank texts give no row, nor does an empty table; repeated
    rows give theirs each; ties between templates are all told; other columns
    are not looked at.
    """
    if not 0 < dice <= 1:
        raise ValueError("0 < dice <= 1 is needed")
    rows = template_rows(templates)
    made = "doc_id long, unit string, unit_no int, template int, license string, dice double"
    own = docs.select(F.col(key).alias("doc_id"), text_of(docs, text).alias("_text"))
    if not rows:
        return own.where("false").select("doc_id", *[F.lit(None).cast(t).alias(n) for n, t in
                                                     (x.split() for x in made.split(", ")[1:])])
    width, shared = widths(templates), {k: max(1, math.ceil(size_bounds(len(b), dice)[0] - 1e-9)) for k, _, b in rows}
    some = sorted({w for _, _, b in rows for w in telling_words(b, dice)}, key=lambda w: (-len(w), w))
    telling = f"(?i)(?<![a-z0-9])(?:{'|'.join(some)})(?![a-z0-9])"
    own = own.where(F.col("_text").rlike(telling))
    lines = F.split("_text", "\n", -1)
    pieces = F.split("_text", "\n[ \t\r]*\n", -1)

    def units(kind: str, parts: Column) -> Column:
        return F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("unit_no"), x.alias("body")))

    none = F.filter(units("", lines), lambda x: F.lit(False))
    every = F.concat(units("line", lines), F.when(F.size(pieces) > 1, units("block", pieces)).otherwise(none),
                     F.when(F.size(lines) > 1, units("document", F.array("_text"))).otherwise(none),
                     units("window", F.array("_text")))
    out = own.select("doc_id", F.inline(every)).where(F.col("body").rlike(telling))
    norm = F.trim(F.regexp_replace(F.translate("body", _UPPER, _LOWER), "[^a-z0-9]+", " "))
    out = out.withColumn("words", F.split(norm, " ", -1)).where(F.size("words") > min(shared.values())).drop("body")
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    out = out.withColumn("pairs", pairs).drop("words")
    known = _quoted(sorted({x for _, _, b in rows for x in b}))
    out = out.withColumn("hits", F.expr(
        f"filter(transform(pairs, (b, i) -> struct(i AS at, b AS b)), h -> h.b IN ({known}))"))
    found = F.array(*[F.struct(
        F.lit(k).alias("template"), F.lit(name).alias("license"), F.lit(len(b)).alias("size"),
        F.lit(width[k]).alias("width"), F.lit(shared[k]).alias("shared"),
        F.expr(f"filter(hits, h -> h.b IN ({_quoted(b)}))").alias("found")) for k, name, b in rows])
    out = out.where(F.size("hits") >= min(shared.values())).withColumn(
        "n", F.when(F.col("unit") != "window", F.size(F.array_distinct("pairs"))))
    n = F.col("n")
    within = F.filter(found, lambda t: (F.size(F.array_distinct(t["found"]["b"])) >= t["shared"]) & (n.isNull() | (
        (t["size"] * (dice / (2 - dice)) <= n) & (n <= t["size"] * ((2 - dice) / dice)))))
    out = out.select("doc_id", "unit", "unit_no", "pairs", "n", F.inline(within))
    # windows that start at a shared bigram and hold enough of them
    starts = F.expr("""transform(found, (h, i) -> CASE WHEN i + shared <= size(found)
      AND try_element_at(found, i + shared).at <= h.at + width - 2 THEN struct(
        CAST(2.0D * size(array_distinct(filter(slice(found, i + 1, width), x -> x.at <= h.at + width - 2).b))
          / (size(array_distinct(slice(pairs, h.at + 1, width - 1))) + size) AS DOUBLE) AS dice, -h.at AS unit_no) END)""")
    whole = F.struct((F.lit(2.0) * F.size(F.array_distinct("found.b")) / (n + F.col("size"))).alias("dice"),
                     (-F.col("unit_no")).alias("unit_no"))
    best = F.when(F.col("unit") == "window", F.array_max(starts)).otherwise(whole)
    out = out.select("doc_id", "unit", "template", "license", F.inline(F.array(best)))
    return out.where(F.col("dice") >= dice).select("doc_id", "unit", (-F.col("unit_no")).alias("unit_no"), "template",
                                                   "license", "dice")


def duckdb_sql(dice: float = DICE, templates=None, table: str = "documents") -> str:
    """The same scan for DuckDB, over every window that starts at a bigram of the template."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    width = widths(templates)
    values = ", ".join(f"({k}, {quote(name)}, {width[k]}, [{', '.join(map(quote, b))}])"
                       for k, name, b in template_rows(templates))
    return f"""
WITH templates(template, license, width, bigrams) AS (VALUES {values}),
lines AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS p,
  coalesce(text, '') AS body FROM {table}),
blocks AS (SELECT doc_id, regexp_split_to_array(body, '\\n[ \\t\\r]*\\n') AS p FROM lines),
units AS (
  SELECT NULL AS r, doc_id, 'line' AS unit, unnest(range(len(p))) AS unit_no, unnest(p) AS body FROM lines
  UNION ALL SELECT NULL, doc_id, 'block', unnest(range(len(p))), unnest(p) FROM blocks WHERE len(p) > 1
  UNION ALL SELECT NULL, doc_id, 'document', 0, body FROM lines WHERE len(p) > 1
  UNION ALL SELECT r, doc_id, 'window', 0, body FROM lines),
norm AS (SELECT r, doc_id, unit, unit_no, string_split(trim(regexp_replace(translate(body, '{_UPPER}', '{_LOWER}'),
  '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
grams AS (SELECT r, doc_id, unit, unit_no,
  list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM norm WHERE len(w) > 1),
places AS (SELECT r, unnest(b) AS g, unnest(range(len(b))) AS place FROM grams WHERE unit = 'window'),
starts AS (SELECT r, template, place FROM places JOIN (SELECT template, unnest(bigrams) AS g FROM templates) USING (g)),
windows AS (SELECT r, doc_id, place, template, license, bigrams, list_distinct(b[place + 1:place + width - 1]) AS b
  FROM starts JOIN grams USING (r) JOIN templates USING (template)),
spans AS (SELECT r, doc_id, place, template, license,
  2.0 * len(list_intersect(b, bigrams)) / (len(b) + len(bigrams)) AS dice FROM windows),
scored AS (SELECT doc_id, unit, unit_no, template, license,
  2.0 * len(list_intersect(b, bigrams)) / (len(b) + len(bigrams)) AS dice
  FROM (SELECT doc_id, unit, unit_no, list_distinct(b) AS b FROM grams WHERE unit <> 'window'), templates
  WHERE len(b) BETWEEN len(bigrams) * {dice / (2 - dice)!r} AND len(bigrams) * {(2 - dice) / dice!r}
  UNION ALL SELECT doc_id, 'window', place, template, license, dice FROM spans
  QUALIFY row_number() OVER (PARTITION BY r, template ORDER BY dice DESC, place) = 1)
SELECT doc_id, unit, CAST(unit_no AS INTEGER) AS unit_no, CAST(template AS INTEGER) AS template, license,
  CAST(dice AS DOUBLE) AS dice FROM scored WHERE dice >= {dice!r}"""
