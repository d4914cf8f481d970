"""License scans (operator 3): canonical digest lookup.

Each whole text, each paragraph (text between blank lines) and each line is normalised (case,
punctuation, copyright lines, equivalent spellings) and its digest hash-joined to the digests of known
licence texts. The known texts are a fixed list in this module, so their side of the join is small
whatever the corpus.

Defined results: a null or empty text, and one that normalises to nothing, match no licence. Rows that
repeat an id and a text are each returned, with the same matches. A very long text is scanned whole: only its units
that hold a word of ``MARKERS`` are digested. A unit that is several licences' text is reported under each. Other
columns are not read, so their names may clash. An empty table gives no rows.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_key
from .line_dedup import LOWER, UPPER

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def _gnu(name: str, version: str, subject: str = "program") -> str:
    """The short notice of a GNU licence."""
    return _GPL3.replace("This program", f"This {subject}").replace("this program", f"this {subject}").replace("GNU General Public License", f"GNU {name}").replace("version 3 of the License", f"version {version} of the License")


def _bsd(name: str, count: int) -> list[tuple[str, str]]:
    """The texts of a BSD licence: clauses in one paragraph or several, numbered or not."""
    out = []
    for numbered in (True, False):
        clauses = [f"{k}. {c}" if numbered else f"* {c}" for k, c in enumerate(_BSD_CLAUSES[:count], 1)]
        terms = "\n".join([_BSD_START, *clauses])
        # alone, the terms of two clauses in several paragraphs are also the start of three
        out += [(name, terms), (name, terms + "\n\n" + _BSD_END), ("BSD", _BSD_START)]
        out += [(name, c) for c in clauses[2:]]
    return out


def _full(name: str) -> str:
    return (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text(encoding="utf-8")


def _families() -> tuple[tuple[str, str], ...]:
    """Full texts, short notices and statements, each with the paragraph that identifies it among other text."""
    bodies = [("MIT", _MIT), ("ISC", _ISC), ("Apache-2.0", _APACHE), ("GPL-3.0", _GPL3), ("BSL-1.0", _BOOST), ("Unlicense", _UNLICENSE), ("MPL-2.0", _MPL)]
    bodies += [("GPL-2.0", _gnu("General Public License", "2")), ("AGPL-3.0", _gnu("Affero General Public License", "3"))]
    bodies += [(f"LGPL-{v}", _gnu("Lesser General Public License", n, subject)) for v, n in (("2.1", "2.1"), ("3.0", "3")) for subject in ("program", "library")]
    full = [("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("Apache-2.0", "Apache-2.0")]
    bodies += [(name, _full(file)) for name, file in full]
    out = [x for name, text in bodies for x in ((name, text), (name, re.split(r"\n[\x20\x09-\x0D]*\n", text.strip())[0]))]
    out += [("Unlicense", "For more information, please refer to <https://unlicense.org>"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007")]
    out += _bsd("BSD-2-Clause", 2) + _bsd("BSD-3-Clause", 3)
    titles = {
        "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "BSL-1.0": ["Boost Software License, Version 1.0"], "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"], "Unlicense": ["Unlicense"],
        "GPL-2.0": ["GNU General Public License, version 2"], "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"], "LGPL-3.0": ["GNU Lesser General Public License, version 3"], "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    }
    for name, known in titles.items():
        out += [(name, f"{start} the {t}.") for t in known for start in ("Licensed under", "Released under", "This work is licensed under")]
        out += [(name, f"SPDX-License-Identifier: {x}") for x in ([f"{name}-only", f"{name}-or-later"] if "GPL" in name else [name])]
    return tuple(out)


#: (licence, text): licence texts and the usual statements that name a licence.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC), ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", _GPL3), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    *_families(),
)
#: Spellings that mean the same, as (pattern, replacement), after lower-casing. In this order.
EQUIVALENT = (("licence", "license"), ("licenced", "licensed"), ("non-?infringement", "noninfringement"), ("copyright holders?", "copyright holder"), ("sub-license", "sublicense"), ("merchantibility", "merchantability"), ("https://", "http://"), (r"version (\d)", "v$1"), (r"\bv\.? ?(\d)", "v$1"))
#: Words of which each known text holds one, whatever its spelling: units without any are no licence.
MARKERS = r"(?i)licen[sc]e|permission|redistribut|free software|warrant|spdx|unencumbered"


def canonical(text: Column) -> Column:
    """Copyright lines removed, lower case, equivalent spellings, letters and digits joined by single blanks."""
    out = F.translate(text, UPPER, LOWER)
    out = F.regexp_replace(out, r"(?m)^[^a-z0-9\n]*(copyright\b|\(c\)|©|all rights reserved)[^\n]*$", " ")
    for pattern, put in EQUIVALENT:
        out = F.regexp_replace(out, pattern, put)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(canonical(text).cast("binary"), 256))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    rows = spark.createDataFrame(list(known), "license string, known string")
    return rows.select("license", digest(F.col("known")).alias("digest")).distinct()


def license_matches(docs: DataFrame, known=KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_ax_id, _ax_text, unit, license): each licence found in a text, and whether it is the whole text, a paragraph or a line.

    Units without any of ``MARKERS`` need no digest, as long as each known text holds one.
    """
    spark = docs.sparkSession
    marked = all(re.search(MARKERS, text) for _, text in known)
    may_match = (lambda c: c.rlike(MARKERS)) if marked else (lambda c: c.isNotNull())
    text = F.col(text_col)
    base = docs.filter(may_match(text)).select(F.col(id_col).alias("_ax_id"), text_key(text_col).alias("_ax_text"), text.alias("_ax_whole"))
    parts = {"paragraph": r"\n[\x20\x09-\x0D]*\n", "line": r"\n"}
    tagged = lambda unit: lambda body: F.struct(F.lit(unit).alias("unit"), body.alias("body"))
    units = base.select(
        "_ax_id", "_ax_text",
        F.explode(F.concat(
            F.array(F.struct(F.lit("text").alias("unit"), F.col("_ax_whole").alias("body"))),
            *(F.transform(F.split("_ax_whole", cut), tagged(unit)) for unit, cut in parts.items()),
        )).alias("u"),
    ).filter(may_match(F.col("u.body")))
    hashed = units.select("_ax_id", "_ax_text", "u.unit", digest(F.col("u.body")).alias("digest"))
    # a fixed list of this module (or of the caller's own): its size is checked before it is sent to every task
    side = known_digests(spark, known)
    return hashed.join(F.broadcast(side) if len(known) <= 10_000 else side, "digest").select("_ax_id", "_ax_text", "unit", "license").distinct()


def scan_licenses(docs: DataFrame, known=KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``licenses`` (sorted), ``whole_text`` (the text as a whole is a licence), ``n_matches``."""
    found = license_matches(docs, known, id_col, text_col).groupBy("_ax_id", "_ax_text").agg(
        F.array_sort(F.collect_set("license")).alias("licenses"), F.max(F.expr("unit = 'text'")).alias("whole_text"), F.count("*").alias("n_matches"))
    d = docs.select(id_col, text_key(text_col).alias("_ax_key"))
    return d.join(found, d[id_col].eqNullSafe(found["_ax_id"]) & (d["_ax_key"] == found["_ax_text"]), "left").select(
        id_col, F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("whole_text", F.lit(False)).alias("whole_text"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"))


def license_result(docs: DataFrame) -> DataFrame:
    s = scan_licenses(docs)
    return s.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "whole_text", "n_matches", (F.size("licenses") > 0).alias("has_license"))


def sql(known=KNOWN) -> str:
    """DuckDB SQL for license_result over the view documents."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"

    def clean(c: str) -> str:
        out = f"translate({c}, '{UPPER}', '{LOWER}')"
        out = f"regexp_replace({out}, '(?m)^[^a-z0-9\\n]*(copyright\\b|\\(c\\)|©|all rights reserved)[^\\n]*$', ' ', 'g')"
        for pattern, put in EQUIVALENT:
            out = f"regexp_replace({out}, {quote(pattern)}, {quote(put.replace('$1', chr(92) + '1'))}, 'g')"
        return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    rows = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in known)
    return f"""
WITH known AS (SELECT DISTINCT license, {clean('t')} AS c FROM (VALUES {rows}) v(license, t)),
units AS (SELECT doc_id, 'text' AS unit, text AS body FROM documents UNION ALL SELECT doc_id, 'paragraph', unnest(string_split_regex(text, '\\n[\\x20\\x09-\\x0D]*\\n')) FROM documents UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents),
hits AS (SELECT DISTINCT doc_id, unit, license FROM units JOIN known ON c = {clean('body')})
SELECT d.doc_id, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses, coalesce(bool_or(unit = 'text'), false) AS whole_text, count(license) AS n_matches, count(license) > 0 AS has_license
FROM documents d LEFT JOIN hits h ON h.doc_id = d.doc_id GROUP BY d.doc_id
"""
