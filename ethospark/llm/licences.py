"""Licence scan by canonical digests.

A text is brought to a canonical form (lower case, no copyright lines, one spelling of equivalent words, no punctuation), and the
SHA-256 digest of the whole form is looked up among those of known licences. The units of a document are its whole text,
its blocks (between blank lines), runs of as many blocks as a known licence has, and its lines, so a licence is found as a
document, as a part or as a notice of one line. Units without any of the ``ANCHORS``, one of which is in every known form, can't be
known and aren't brought to the form.

Known here: whole texts of short licences, the notices that files of the long ones carry, and sentences that name a licence. Texts of
one's own come as a table (``known``), with ``digest_rows``.

All is done with DataFrame functions; the table of known digests is broadcast, own ones up to ``BROADCAST_ROWS``.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that the canonical form treats as equal, as space-separated words without punctuation.
EQUIVALENT = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("favour", "favor"), ("fulfil", "fulfill"), ("modelled", "modeled"), ("noncommercial", "non commercial"), ("organisation", "organization"), ("per cent", "percent"), ("programme", "program"),
    ("wilful", "willful"), ("judgement", "judgment"), ("behaviour", "behavior"), ("https", "http"), ("gnu gpl", "gnu general public license"), ("gnu lgpl", "gnu lesser general public license"), ("gnu agpl", "gnu affero general public license"),
]
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}]+"
VERSION = r" (?:version |ver |v ?)([0-9])"

# Whole licences.
GRANT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR '
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_ITEMS = [
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n'
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License."
)
MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.\n\n"
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details.\n\n"
    "You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
WHOLE = {
    "BSD-2-Clause": ["\n\n".join([BSD_HEAD, *BSD_ITEMS[:2], BSD_AS_IS]), "\n\n".join(["BSD 2-Clause License", BSD_HEAD, *BSD_ITEMS[:2], BSD_AS_IS])],
    "BSD-3-Clause": ["\n\n".join([BSD_HEAD, *BSD_ITEMS, BSD_AS_IS]), "\n\n".join(["BSD 3-Clause License", BSD_HEAD, *BSD_ITEMS, BSD_AS_IS])],
    "Apache-2.0": [APACHE_NOTICE],
    "MPL-2.0": [MPL_NOTICE],
    "GPL-3.0": [GNU_NOTICE.format("", "3")],
    "GPL-2.0": [GNU_NOTICE.format("", "2")],
    "AGPL-3.0": [GNU_NOTICE.format("Affero ", "3")],
    "LGPL-3.0": [GNU_NOTICE.format("Lesser ", "3")],
    "MIT": [f"{MIT_GRANT}\n\n{GRANT_NOTICE}\n\n{AS_IS}", f"MIT License\n\n{MIT_GRANT}\n\n{GRANT_NOTICE}\n\n{AS_IS}", f"The MIT License (MIT)\n\n{MIT_GRANT}\n\n{GRANT_NOTICE}\n\n{AS_IS}"],
    "ISC": [f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_AS_IS}", f"ISC License\n\n{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_AS_IS}"],
    "0BSD": [f"{ISC_GRANT}.\n\n{ISC_AS_IS}", f"BSD Zero Clause License\n\n{ISC_GRANT}.\n\n{ISC_AS_IS}"],
    "LicenseRef-all-rights-reserved": ["All rights reserved."],
}

# Names in notices, and the sentences that they stand in.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "the Apache 2.0 license", "Apache-2.0"],
    "MIT": ["the MIT License", "MIT license", "MIT"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the New BSD License", "BSD-3-Clause"],
    "ISC": ["the ISC License", "ISC"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "MPL-2.0"],
    "EPL-2.0": ["the Eclipse Public License, version 2.0", "EPL-2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "GNU GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["the GNU General Public License, version 3", "GNU GPL v3", "GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL-2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "the Creative Commons Zero v1.0 Universal"],
    "Unlicense": ["the Unlicense"],
}
CC_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
CC_KINDS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
CC_VERSIONS = ["2.0", "2.5", "3.0", "4.0"]
#: One of these is in every known form, and in what stands for it in a text.
ANCHORS = "licen[cs]|under|permission|permitted|reserved"
BROADCAST_ROWS = 200_000
BLANK = r"\n[ \t\r]*\n\s*"
VERBS = ["Licensed", "Released", "Distributed", "Published", "Available"]
SUBJECTS = ["work", "software", "file", "program", "document", "project"]


def names() -> dict[str, list[str]]:
    """The names in notices by licence id, those of the Creative Commons by their rule."""
    out = {k: list(v) for k, v in NAMES.items()}
    for kind in CC_KINDS:
        for version in CC_VERSIONS:
            long = "Creative Commons " + "-".join(CC_PARTS[p] for p in kind.split("-")) + f" {version}"
            kinds = [long, f"{long} License", f"{long} International", f"{long} International License", f"CC {kind} {version}", f"CC {kind} {version} license"]
            out[f"CC-{kind}-{version}"] = kinds + [f"{a} {k}" for k in kinds if k.lower().endswith("license") for a in ("a", "the")]
    return out


def known_texts() -> list[tuple[str, str]]:
    """(licence id, text) of all known licences and notices."""
    out = [(k, t) for k, texts in WHOLE.items() for t in texts]
    for licence, written in names().items():
        for name in written:
            for verb in VERBS:
                out.append((licence, f"{verb} under {name}."))
            out.append((licence, f"Licensed under the terms of {name}."))
            out += [(licence, f"This {s} is licensed under {name}.") for s in SUBJECTS]
        out.append((licence, f"SPDX-License-Identifier: {licence}"))
    return out


def canonical(text: str) -> str:
    """The canonical form in Python, for the known texts; ``canonical_column`` is the same for columns."""
    out = re.sub(COPYRIGHT_LINE, "", text.lower())
    out = " " + re.sub(r"[\W_]+", " ", out).strip() + " "
    for a, b in EQUIVALENT:
        out = out.replace(f" {a} ", f" {b} ")
    return re.sub(VERSION, r" \1", out).strip()


def canonical_column(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, PUNCTUATION, " ")), F.lit(" "))
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.regexp_replace(out, VERSION, " $1"))


def digest_rows(texts: list[tuple[str, str]]) -> list[tuple[str, str, int]]:
    """(digest, licence id, blocks) of (licence id, text), one row for each distinct form and number of blocks."""
    found = {(hashlib.sha256(canonical(t).encode()).hexdigest(), len(re.split(BLANK, t.strip()))): k for k, t in reversed(texts)}
    return sorted((d, k, n) for (d, n), k in found.items())


def block_counts(rows: list[tuple[str, str, int]]) -> list[int]:
    return sorted({n for _, _, n in rows if n > 1})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows (doc_id, unit, position, licence, digest) for each unit of a document that is a known licence as a whole.

    ``unit`` is text, block, blocks (a run of several) or line and ``position`` its number in the document, from 0 (of a run, its first
    block's). A unit that is the whole document is given as text, one that is a whole block as block. Null, empty and blank texts have no
    units; rows with equal ids are scanned each by itself. ``known`` adds (licence id, text) of one's own; one that holds none of ``ANCHORS`` is refused.
    """
    spark: SparkSession = docs.sparkSession
    if lacking := [k for k, t in known or [] if not re.search(ANCHORS, t.lower())]:
        raise ValueError(f"without any of the anchors, and so never found: {', '.join(lacking)}")
    listed = digest_rows([*known_texts(), *(known or [])])
    if len(listed) > BROADCAST_ROWS:
        raise ValueError("too many known texts for one pass")
    text = F.col("text")
    blocks, lines = F.split(text, BLANK), F.split(text, r"\n")
    none = F.array().cast("array<struct<unit:string,position:bigint,part:string>>")
    unit = lambda kind, parts: F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("position"), x.alias("part")))
    several = F.when(F.size(blocks) > 1, F.filter(unit("block", blocks), lambda u: F.instr(u["part"], "\n") > 0)).otherwise(none)
    single = F.when(F.size(lines) > 1, unit("line", lines)).otherwise(none)

    def runs_of(n: int) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size("blocks") - n + 1), lambda i: F.array_join(F.slice("blocks", i, F.lit(n)), "\n\n"))
        return F.when(F.size("blocks") > n, unit("blocks", joined)).otherwise(none)

    runs = [runs_of(n) for n in block_counts(listed)]
    units = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.lower(F.col(text_col)).rlike(ANCHORS)).withColumn("blocks", blocks)
    units = units.select("doc_id", F.explode(F.concat(unit("text", F.array(text)), several, single, *runs)).alias("u")).select("doc_id", "u.*").where(F.lower("part").rlike(ANCHORS))
    digests = units.withColumn("form", canonical_column(F.col("part"))).where("form <> ''").select("doc_id", "unit", "position", F.sha2(F.col("form").cast("binary"), 256).alias("digest"))
    named = F.broadcast(spark.createDataFrame(sorted({d: k for d, k, _ in reversed(listed)}.items()), "digest string, licence string"))  # bounded above
    return digests.join(named, "digest").select("doc_id", "unit", "position", "licence", "digest")


def oracle() -> str:
    """DuckDB SQL for ``scan`` on ``documents``: every unit is brought to its form."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"' ' || trim(regexp_replace(regexp_replace(lower(part), {quoted(COPYRIGHT_LINE)}, '', 'g'), {quoted(PUNCTUATION)}, ' ', 'g')) || ' '"
    for a, b in EQUIVALENT:
        form = f"replace({form}, {quoted(f' {a} ')}, {quoted(f' {b} ')})"
    form = f"trim(regexp_replace({form}, {quoted(VERSION)}, ' \\1', 'g'))"
    listed = digest_rows(known_texts())
    known = ", ".join(f"({quoted(d)}, {quoted(x)})" for d, x in sorted({d: k for d, k, _ in reversed(listed)}.items()))
    runs = "".join(
        f"\n  UNION ALL SELECT doc_id, 'blocks', i - 1, array_to_string(blocks[i:i + {n - 1}], chr(10) || chr(10)) FROM docs, LATERAL (SELECT unnest(generate_series(1, len(blocks) - {n - 1})) AS i) WHERE len(blocks) > {n}" for n in block_counts(listed)
    )
    return f"""
WITH known(digest, licence) AS (VALUES {known}),
docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n\\s*') AS blocks FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, 'text' AS unit, 0::BIGINT AS position, text AS part FROM docs
  UNION ALL SELECT doc_id, 'line', i - 1, lines[i] FROM docs, LATERAL (SELECT unnest(generate_series(1, len(lines))) AS i) WHERE len(lines) > 1
  UNION ALL SELECT doc_id, 'block', i - 1, blocks[i] FROM docs, LATERAL (SELECT unnest(generate_series(1, len(blocks))) AS i) WHERE len(blocks) > 1 AND contains(blocks[i], chr(10)){runs}),
forms AS (SELECT doc_id, unit, position, {form} AS form FROM units)
SELECT doc_id, unit, position, licence, digest FROM (SELECT *, sha256(form) AS digest FROM forms WHERE form <> '') JOIN known USING (digest)"""
