"""License scans by canonical digest lookup.

A text is brought to a canonical form, small letters, without copyright lines, with one of
several equivalent spellings, without punctuation, words one space apart, and its SHA-256 is
joined with the digests of known licence texts and notices. Looked up are the whole text of a
document and each of its lines by itself, so a notice of one line inside a document is found as
well as a document that is a licence. All of it is DataFrame functions.

The known texts are a table (license_id, kind, text) given at run time: ``read_texts`` makes one of a
folder of licence files (such as a copy of a public licence list), to which ``known_texts`` adds short
permissive licences in full, the notices that source files carry, and one-line notices built from a few patterns.

Defined cases: null and empty texts and lines without a letter or digit match nothing; repeated
rows of a document count once; documents without a match have no row; known texts of one
canonical form belong to the first license_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import STOPWORDS

# Equivalent spellings, and the wording of licences and notices.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("sub-license", "sublicense"), ("sub-licensed", "sublicensed"), ("non-commercial", "noncommercial"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("favour", "favor"), ("organisation", "organization"), ("organisations", "organizations"), ("behaviour", "behavior"), ("fulfil", "fulfill"),
    ("https", "http"), ("whilst", "while"), ("wilful", "willful"), ("analogue", "analog"), ("programme", "program"), ("recognise", "recognize"), ("initialise", "initialize"), ("judgement", "judgment"),
)
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|<|\[|by )|\(c\)[ \t]*[0-9<]|©|all rights reserved)[^\n]*"
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPL-3.0"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD License", "BSD-3-Clause"),
    "ISC": ("ISC License", "ISC"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    **{f"CC-{k}-{v}": (f"CC {k} {v}", f"CC-{k}-{v}", f"Creative Commons {long} {v}", f"Creative Commons {long} {v} International License")
       for v in ("3.0", "4.0")
       for k, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
}
NOTICES = (
    "Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
    "Distributed under the {}.", "This file is licensed under the {}.", "This project is licensed under the {}.", "This software is licensed under the {}.", "Available under the {}.", "Published under the {}.", "SPDX-License-Identifier: {}",
)
MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
GNU_NOTICE = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
    "You should have received a copy of the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
    "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
    "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>"
)


def _bsd(clauses: int) -> tuple[str, ...]:
    """The licence with or without its title, its clauses numbered or starred."""
    parts = [BSD_SOURCE, BSD_BINARY, BSD_NAME][:clauses]
    bodies = [" ".join([BSD_START, *[f"{m} {p}" for m, p in zip(marks, parts)], BSD_END]) for marks in (("1.", "2.", "3."), ("*", "*", "*"))]
    return tuple(f"{title}{b}" for b in bodies for title in (f"BSD {clauses}-Clause License\n\n", f"The {clauses}-Clause BSD License\n\n", ""))


TEXTS = {
    "MIT": ("MIT License\n\n" + MIT_BODY, "The MIT License (MIT)\n\n" + MIT_BODY, MIT_BODY),
    "ISC": (f"ISC License\n\n{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {ISC_END}", f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {ISC_END}"),
    "0BSD": (f"BSD Zero Clause License\n\n{ISC_GRANT}. {ISC_END}", f"{ISC_GRANT}. {ISC_END}"),
    "BSD-2-Clause": _bsd(2),
    "BSD-3-Clause": _bsd(3),
    "Apache-2.0": (APACHE_NOTICE,),
    "MPL-2.0": (MPL_NOTICE,),
    **{i: tuple(GNU_NOTICE.format(what=w, name=n, version=v) for w in ("program", "file", "software", "library")) for i, n, v in (
        ("GPL-2.0-or-later", "GNU General Public License", 2), ("GPL-3.0-or-later", "GNU General Public License", 3), ("LGPL-3.0-or-later", "GNU Lesser General Public License", 3), ("AGPL-3.0-or-later", "GNU Affero General Public License", 3),
    )},
    "Zlib": (ZLIB, "zlib License\n\n" + ZLIB),
    "Unlicense": (UNLICENSE,),
}


def known_texts(spark: SparkSession) -> DataFrame:
    """(license_id, kind, text): full texts and one-line notices, fewer than two thousand."""
    rows = [(i, "text", t) for i, texts in TEXTS.items() for t in texts]
    rows += [(i, "notice", n.format(name)) for i, names in NAMES.items() for name in names for n in NOTICES]
    return spark.createDataFrame(rows, "license_id string, kind string, text string")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(license_id, kind, text) of a folder of licence texts, each named by its id (``GPL-3.0-only.txt``)."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1)
    return spark.read.text(folder, wholetext=True).select(name.alias("license_id"), F.lit("text").alias("kind"), F.col("value").alias("text"))


def canonical(text: Column) -> Column:
    """Most texts have no copyright line and none of the spellings; one look tells, and they skip the replacements."""
    small = F.lower(text)
    marked = reduce(lambda a, b: a | b, [F.contains(small, F.lit(x)) for x in ("copyright", "(c)", "©", "all rights reserved")])
    plain = F.when(marked, F.regexp_replace(small, COPYRIGHT_LINE, "$1")).otherwise(small)
    spelt = reduce(lambda t, pair: F.regexp_replace(t, rf"\b{pair[0]}\b", pair[1]), SPELLINGS, plain)
    plain = F.when(F.rlike(small, F.lit(rf"\b({'|'.join(a for a, _ in SPELLINGS)})\b")), spelt).otherwise(plain)
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null if that is empty."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


#: Known texts up to which words are looked for that every one of them holds one of.
SIFTED_TEXTS = 5_000


def sieve(known: DataFrame) -> list[str] | None:
    """Strings of which any text with a known canonical form holds one, in small letters; None if there are too many known texts.

    Canonical forms only drop characters and replace spellings, so a word of a form is in the
    text itself, or one of the spellings that become it. Words are taken greedily, each the one
    of most forms without a word so far.
    """
    forms = [r[0] for r in known.select(canonical(F.col("text"))).where("text is not null").distinct().limit(SIFTED_TEXTS + 1).collect()]
    if len(forms) > SIFTED_TEXTS:
        return None
    phrases = {w for a, b in SPELLINGS for x in (a, b) if " " in x for w in x.split()} | {*STOPWORDS, "without", "work", "file", "version"}  # and words of any text
    left = [{w for w in f.split() if w not in phrases} for f in forms if f]
    chosen: list[str] = []
    while left:
        counts: dict[str, int] = {}
        for words in left:
            for w in words:
                counts[w] = counts.get(w, 0) + 1
        if not counts or any(not words for words in left):
            return None
        best = max(counts, key=lambda w: (counts[w] * min(len(w), 6), w))
        chosen.append(best)
        left = [words for words in left if best not in words]
    strings = {x for w in chosen for x in [w, *[a for a, b in SPELLINGS if b == w]]}
    return sorted(x for x in strings if not any(y != x and y in x for y in strings))


#: Known texts up to which their digests are sent to every task; a larger table is joined by a shuffle.
BROADCAST_TEXTS = 50_000


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, license_id, kind, scope, n_places, first_line); lines count from 1, a whole text is line 0.

    Only texts and lines that hold a string of the ``sieve`` are brought to the canonical form; no
    other can match. Every whole text is searched for those strings.
    """
    known = known_texts(docs.sparkSession) if known is None else known
    digests = known.select("license_id", "kind", digest(F.col("text")).alias("digest")).where("digest is not null").groupBy("digest").agg(F.min_by(F.struct("license_id", "kind"), F.struct("license_id", "kind")).alias("k")).select("digest", "k.*")
    small = known.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    strings = sieve(known)
    may = (lambda c: reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(x)) for x in strings])) if strings else (lambda _: F.lit(True))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), lambda u: may(u["text"]))
    units = docs.where(may(F.col("text"))).select("doc_id", F.posexplode(F.concat(F.array(F.struct(F.lit(0).alias("line"), F.col("text"))), lines)).alias("p", "u"))
    hits = units.select("doc_id", F.col("u.line").alias("line"), digest(F.col("u.text")).alias("digest")).join(F.broadcast(digests) if small else digests, "digest")
    # A document of one line matches as a whole and as that line.
    scope = F.when(F.col("line") == 0, F.lit("document")).otherwise(F.lit("line"))
    return (
        hits.withColumn("scope", scope).select("doc_id", "license_id", "kind", "scope", "line").distinct()
        .groupBy("doc_id", "license_id", "kind", "scope").agg(F.count("*").alias("n_places"), F.min("line").alias("first_line"))
    )


def scan_sql() -> str:
    """The same scan in SQL, over the view ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(column: str) -> str:
        out = f"regexp_replace(lower({column}), {quote(COPYRIGHT_LINE)}, '\\1', 'g')"
        for a, b in SPELLINGS:
            out = f"regexp_replace({out}, {quote(rf'\b{a}\b')}, {quote(b)}, 'g')"
        return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"

    rows = [(i, "text", t) for i, texts in TEXTS.items() for t in texts] + [(i, "notice", n.format(name)) for i, names in NAMES.items() for name in names for n in NOTICES]
    values = ", ".join(f"({quote(i)}, {quote(k)}, {quote(t)})" for i, k, t in rows)
    return f"""
WITH known(license_id, kind, text) AS (VALUES {values}),
forms AS (SELECT license_id, kind, {form('text')} AS form FROM known),
digests AS (SELECT sha256(form) AS digest, min(struct_pack(a := license_id, b := kind)) AS k FROM forms WHERE form <> '' GROUP BY 1),
units AS (
  SELECT DISTINCT doc_id, 0 AS line, text FROM documents WHERE text IS NOT NULL
  UNION SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL),
found AS (SELECT DISTINCT doc_id, line, k.a AS license_id, k.b AS kind FROM (SELECT doc_id, line, {form('text')} AS form FROM units) u JOIN digests d ON sha256(u.form) = d.digest WHERE u.form <> '')
SELECT doc_id, license_id, kind, CASE WHEN line = 0 THEN 'document' ELSE 'line' END AS scope, count(*) AS n_places, min(line)::INTEGER AS first_line FROM found GROUP BY ALL"""
