"""Licence scans by canonical digests, in DataFrame functions only.

A text's canonical form is ASCII lower case without copyright lines, with every
other sign than letters and digits as one space and equivalent spellings made
alike. Its SHA-256 is joined with the digests of known licence texts. Entire
texts are compared: the whole document, and each of its lines as a text of its
own, which is how short licence notices stand in documents. A known text is
listed with and without its usual titles, so titles cost a scan nothing.

Defined results: a null text is empty; an empty canonical form has no digest
and matches nothing. Null ids and repeated rows are kept, a document's notices
are told apart by its text, not its id. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Licence id and text; short public licences and usual notices.
LICENSES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Clauses of the BSD licences, which files number or not.
_BSD = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _bsd(clauses: int) -> list[str]:
    numbered = [[f"{k + 1}. {c}" for k, c in enumerate(_BSD[:clauses])], _BSD[:clauses]]
    return [" ".join([_BSD_HEAD, *lines, _BSD_TAIL.format(who)]) for lines in numbered for who in ("HOLDER", "OWNER")]


LICENSES += [("BSD-2-Clause", t) for t in _bsd(2)] + [("BSD-3-Clause", t) for t in _bsd(3)]
#: Titles that files of a licence start with.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "The BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "The BSD 3-Clause License", "BSD License"],
}
#: Digests of the canonical forms of long licences as their publishers print them; to be made
#: anew by canonical_text() when the canonical form changes. Further ones of a licence are its text without
#: what follows "END OF TERMS AND CONDITIONS", for the Apache licence also without that line.
FULL_TEXTS = [
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Apache-2.0", "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"),
    ("CC0-1.0", "0c3e4ca5ed7ced6289d3f5d9a83e4100f9f34d87983b17dc5865376a8a0a98f3"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "9672a697b80e59f5b1b0201e64d65dee8762b193cdd934dc5bcf2b57350a2ead"),
]
#: Spellings that count as the same word.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("organisation", "organization"), ("authorised", "authorized"), ("merchantibility", "merchantability"), ("non commercial", "noncommercial"), ("sub license", "sublicense"), ("v", "version"), ("https", "http")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that states a copyright (with a sign or a year); its words are no part of a licence.
COPYRIGHT = r"(^|\n)[^a-z0-9\n]*(copyright[^\n]*([0-9]{4}|\(c\)|©)|\(c\)[^\n]*[0-9]{4}|©|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    """The canonical form of a text, in Spark functions."""
    t = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    t = F.regexp_replace(t, COPYRIGHT, "$1")
    t = F.concat(F.lit(" "), F.regexp_replace(t, "[^a-z0-9]+", " "), F.lit(" "))
    t = F.regexp_replace(t, " +", " ")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


def canonical_text(text: str) -> str:
    """The same for one text, for the digests of known licences."""
    t = re.sub(COPYRIGHT, r"\1", text.translate(str.maketrans(_UPPER, _LOWER)))
    t = re.sub(" +", " ", " " + re.sub("[^a-z0-9]+", " ", t) + " ")
    for a, b in SPELLINGS:
        t = t.replace(f" {a} ", f" {b} ")
    return t.strip(" ")


def digest(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def digests(licenses: list[tuple[str, str]] = LICENSES, full_texts: list[tuple[str, str]] = FULL_TEXTS, titles: dict[str, list[str]] = TITLES) -> list[tuple[str, str]]:
    """(digest, licence id), one for each canonical text; texts with a title on a line before them count as well."""
    titled = [(i, f"{title}\n\n{t}") for i, t in licenses for title in titles.get(i, [])]
    return sorted({**{d: i for i, d in full_texts}, **{digest(t): i for i, t in [*titled, *licenses]}}.items())


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """(id, text_digest, license_id, notices): the licence that the whole text is, and those that single lines are.

    known: digest and license_id of known texts. It is broadcast up to
    broadcast_rows rows; a larger list is joined by a shuffle. notices: ids in
    order, joined by a comma, empty if there is none.
    """
    spark = docs.sparkSession
    if known is None:
        known = spark.createDataFrame(digests(), "digest string, license_id string")
    known = known.groupBy("digest").agg(F.min("license_id").alias("license_id")).filter("digest IS NOT NULL AND license_id IS NOT NULL")
    small = known.limit(broadcast_rows + 1).count() <= broadcast_rows
    side = F.broadcast(known) if small else known
    form = canonical(F.col("text"))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.sha2("text", 256).alias("key")
    lines = base.select(key, F.explode(F.split(F.translate("text", "\r", "\n"), "\n")).alias("line")).filter(F.col("line").rlike("[a-zA-Z]"))
    lines = lines.select("key", F.sha2(canonical(F.col("line")), 256).alias("digest")).join(side, "digest")
    lines = cut(lines.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices")))  # one row a text, however many copies
    out = base.select("id", key, form.alias("form")).select("id", "key", F.when(F.length("form") > 0, F.sha2("form", 256)).alias("text_digest"))  # a form is made once
    out = out.join(side.withColumnRenamed("digest", "text_digest"), "text_digest", "left").join(lines, "key", "left")
    return out.select(F.col("id").alias(id_col), "text_digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def oracle() -> str:
    """DuckDB SQL for scan() of documents with the known texts of this module."""

    def form(x: str) -> str:
        t = f"regexp_replace(translate({x}, '{_UPPER}', '{_LOWER}'), '{COPYRIGHT}', '\\1', 'g')"
        t = f"regexp_replace(' ' || regexp_replace({t}, '[^a-z0-9]+', ' ', 'g') || ' ', ' +', ' ', 'g')"
        for a, b in SPELLINGS:
            t = f"replace({t}, ' {a} ', ' {b} ')"
        return f"trim({t}, ' ')"

    values = ", ".join(f"('{d}', '{i}')" for d, i in digests())
    return f"""
WITH known(digest, license_id) AS (VALUES {values}),
d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, {form("body")} AS form FROM d),
l AS (SELECT doc_id, sha256({form("line")}) AS digest FROM (SELECT doc_id, unnest(string_split(translate(body, chr(13), chr(10)), chr(10))) AS line FROM d) WHERE regexp_matches(line, '[a-zA-Z]')),
n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM l JOIN known USING (digest) GROUP BY doc_id)
SELECT w.doc_id, CASE WHEN form <> '' THEN sha256(form) END AS text_digest, k.license_id, coalesce(n.notices, '') AS notices
FROM w LEFT JOIN known k ON k.digest = sha256(form) AND form <> '' LEFT JOIN n ON n.doc_id = w.doc_id
"""
