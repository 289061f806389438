"""Licence texts found by the digest of their canonical form.

The canonical form of a text drops copyright lines, case, punctuation and line breaks and, where it speaks of licences or
permission, the word "the", and writes equivalent spellings one way.  A copyright line carries a sign or a year after the
word, or opens a paragraph with the word; "copyright holders ..." within a paragraph stays, wherever its lines break.  The digests of a table of known licences are hash-joined with the digest of
each whole text and of each of its lines, which are where a notice stands as an entire text of its own.
DataFrame functions only.

Edge cases: null texts are empty; the empty form matches nothing; repeated rows keep a row each; a text with
several known lines lists each licence once, in the order of the names; an empty table gives an empty result.
Columns beside id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import texts
from shelfcast.sources.scratch import stored

# Equivalent spellings, as replacements in this order.
COPYRIGHT = (
    # A line with a sign or a year, or the reservation alone; (c) needs a year, since it also marks items of a list.
    r"(?m)^[ \t#*/;-]*((all rights reserved\.?[ \t\r]*)|(copyright[ \t,:]*(\(c\)|©)[^\n]*)"
    r"|((copyright|\(c\))[ \t,:]*(by[ \t]+)?[0-9]{4}[^\n]*)|(©[^\n]*))$",
    # A line that opens a paragraph with the word.
    r"(^[ \t\r\n]*|\n[ \t\r]*\n)[ \t#*/;-]*copyright[ \t][^\n]*",
)
SPELLINGS = (
    (r"\blicence", "license"),
    (r"\bsub license", "sublicense"),
    (r"\bnon commercial\b", "noncommercial"),
    (r"\b(version|ver) ([0-9])", "v$2"),
    (r"\bv([0-9]+) 0\b", "v$1"),
    (r"\bcreative commons\b", "cc"),
    (r"\battribution\b", "by"),
    (r"\bgnu general public license\b", "gpl"),
    (r"\bthe\b", " "),
)

# Names of licences and the openings of a notice.
NAMES = {
    "MIT License": "MIT",
    "MIT license terms": "MIT",
    "Apache License, Version 2.0": "Apache-2.0",
    "Apache License 2.0": "Apache-2.0",
    "GNU General Public License, version 3": "GPL-3.0",
    "GNU General Public License, version 2": "GPL-2.0",
    "GNU Lesser General Public License, version 3": "LGPL-3.0",
    "GNU Affero General Public License, version 3": "AGPL-3.0",
    "Mozilla Public License, version 2.0": "MPL-2.0",
    "BSD 2-Clause License": "BSD-2-Clause",
    "BSD 3-Clause License": "BSD-3-Clause",
    "ISC License": "ISC",
    "CC BY 4.0": "CC-BY-4.0",
    "CC BY-SA 4.0": "CC-BY-SA-4.0",
    "CC BY-NC 4.0": "CC-BY-NC-4.0",
    "CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
    "CC BY-ND 4.0": "CC-BY-ND-4.0",
    "CC0 1.0": "CC0-1.0",
}
OPENINGS = (
    "Licensed under",
    "Released under",
    "Distributed under",
    "This work is licensed under",
    "This work is released under",
    "This software is licensed under",
    "This software is released under",
    "This project is licensed under",
    "This file is licensed under",
    "SPDX-License-Identifier:",
)
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
WHOLE = (
    ("MIT", MIT, ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)")),
    ("ISC", ISC, ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)")),
    ("BSD-2-Clause", BSD_2 + BSD_END, ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License")),
    ("BSD-3-Clause", BSD_2 + BSD_3 + BSD_END, ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License")),
)


def known_texts() -> list[tuple[str, str]]:
    """Licence and text of everything that is recognised by default."""
    notices = [(spdx, f"{o} {n}") for o in OPENINGS for n, spdx in NAMES.items()]
    tags = [(spdx, f"SPDX-License-Identifier: {spdx}") for spdx in sorted(set(NAMES.values()))]
    whole = [(spdx, text) for spdx, text, _ in WHOLE]
    whole += [(spdx, f"{heading}\n\n{text}") for spdx, text, headings in WHOLE for heading in headings]
    return sorted(set(notices + tags + whole))


def canonical(text: Column) -> Column:
    """One line of lower-case words, without what does not tell licences apart."""
    lower = F.lower(text)
    for sign in ("copyright", "(c)", "©", "all rights reserved"):
        found = F.contains(lower, F.lit(sign))
        seen = found if sign == "copyright" else seen | found
    # The rules look only at texts that hold what they are about.
    bare = lower
    for pattern in COPYRIGHT:
        # Lines end at a line feed only, as in SQL.
        bare = F.regexp_replace(bare, "(?d)" + pattern, "")
    kept = F.when(seen, bare).otherwise(lower)
    words = F.regexp_replace(kept, r"[^\p{L}\p{N}]+", " ")

    def spelled(plain: Column) -> Column:
        out = plain
        for pattern, to in SPELLINGS:
            out = F.regexp_replace(out, pattern, to)
        out = F.regexp_replace(out, " +", " ")
        return F.when(F.contains(plain, F.lit("licen")) | F.contains(plain, F.lit("permission")), out).otherwise(plain)

    return F.trim(F.get(F.transform(F.array(words), spelled), F.lit(0)))


def digest(text: Column) -> Column:
    """The digest of the canonical form; null where nothing is left of the text."""
    form = canonical(text)
    return F.when(form != "", F.md5(form))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest and licence of each known text."""
    rows = spark.createDataFrame(known or known_texts(), "licence string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per row of ``documents``: doc_id, digest, licence (of the whole text), notices (of its lines)."""
    known = stored(known if known is not None else known_digests(documents.sparkSession), "known-digests")
    rows = texts(documents).withColumn("text_hash", F.xxhash64("text"))
    whole = rows.select("doc_id", "text_hash", digest(F.col("text")).alias("digest"))
    lines = (
        rows.select("doc_id", "text_hash", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
        .filter(F.length("line") > 0)
        .select("doc_id", "text_hash", digest(F.col("line")).alias("digest"))
    )
    table = known.select("digest", "licence")
    notices = (
        lines.join(table, "digest")
        .groupBy("doc_id", "text_hash")
        .agg(F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("notices"))
    )
    found = notices.select(F.col("doc_id").alias("n_id"), F.col("text_hash").alias("n_hash"), "notices")
    return (
        whole.join(table, "digest", "left")
        .join(found, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("text_hash") == F.col("n_hash")), "left")
        .select("doc_id", "digest", "licence", "notices")
    )
