"""Operator 2: licence scans by digests of canonical text.

A text is brought into one canonical form: lower case; copyright lines (with whatever comment signs stand
before them) dropped; everything but letters and digits turned into single spaces; equivalent spellings
made one. The SHA-256 of that form is looked up among the digests of known texts by a hash join.

Two scopes are looked up alike: the whole text of a row, and each of its lines (short notices stand on a
line of their own). The known texts are a parameter; the built-in ones are a few complete licences and
usual notices. The known side is small and broadcast up to a checked size; beyond it, digests are joined
by key.

Defined results: null and empty texts, and texts of copyright lines only, have the empty form and match
nothing; known texts with the same form count as one (smallest name); repeated rows come back repeated; an
empty table gives an empty result; helper columns clash with none of the table's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewatch.llm.common import lookup_side

_SIGNS = r"^[\s/*#;!.\-]*"
#: A copyright line: the word or sign with a sign, year or "by" behind it.
COPYRIGHT = _SIGNS + r"(copyright\s*(\(c\)|©|[:,]|by\b|[0-9]{4}|$)|\(c\)\s*(copyright\b|©|[0-9]{4})|©|all rights reserved)"
#: Or with a name behind it, the whole of a short line; but not a sentence that goes on from the line before.
NAMED = _SIGNS + r"copyright\s+\S+(\s+\S+){0,5}\s*$"
GOES_ON = _SIGNS + (r"copyright\s+(holders?|owners?|notices?|laws?|licen[sc]es?|statements?|protections?|interests?|treat(y|ies)|and|or|in|of|is|are|"
                    r"to|for|the|this|that|which|as|with|on|at|may|shall|must|not)\b")
#: Spellings that count as the same, in canonical form; applied in this order.
SPELLINGS = (("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
             ("merchantibility", "merchantability"), ("organisation", "organization"), ("authorisation", "authorization"),
             ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("honour", "honor"), ("fulfilment", "fulfillment"),
             ("whilst", "while"), ("per cent", "percent"))

_AS_IS = ("the software is provided as is without warranty of any kind express or implied including but not limited to the "
          "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
          "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or "
          "otherwise arising from out of or in connection with the software or the use or other dealings in the software")
_BSD_HEAD = ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
             "following conditions are met 1 redistributions of source code must retain the above copyright notice this list of "
             "conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice "
             "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
             "distribution ")
_BSD_THIRD = ("3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission ")
_BSD_TAIL = ("this software is provided by the copyright holders and contributors as is and any express or implied warranties "
             "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
             "disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental "
             "special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
             "loss of use data or profits or business interruption however caused and on any theory of liability whether in "
             "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this "
             "software even if advised of the possibility of such damage")
_ISC = ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted{} the "
        "software is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or "
        "consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of "
        "contract negligence or other tortious action arising out of or in connection with the use or performance of this software")
_MIT = ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the software ")
#: Known texts: fixed values, public licences and usual one-line notices.
KNOWN = (
    ("MIT", "mit license " + _MIT + _AS_IS), ("MIT", "the mit license " + _MIT + _AS_IS), ("MIT", _MIT + _AS_IS),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("ISC", _ISC.format(" provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", _ISC.format("")),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"), ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _notice(line: Column) -> Column:
    """Whether a line (in lower case) is a copyright line."""
    return F.rlike(line, F.lit(COPYRIGHT)) | (F.rlike(line, F.lit(NAMED)) & ~F.rlike(line, F.lit(GOES_ON)))


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines, copyright lines and empty ones left out."""
    lines = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\r\n|\n|\r"), lambda x: ~_notice(x))

    def form(x: Column) -> Column:
        return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.transform(lines, form), lambda x: x != "")


def respelled(form: Column) -> Column:
    for a, b in SPELLINGS:
        form = F.replace(form, F.lit(a), F.lit(b))
    return form


def digest(form: Column) -> Column:
    return F.when(form != "", F.sha2(respelled(form).cast("binary"), 256))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """licence, digest; from pairs or a table of (licence, text)."""
    table = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "licence string, text string")
    forms = table.select("licence", digest(F.array_join(canonical_lines(F.col("text")), " ")).alias("digest"))
    return forms.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known=KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_digest, licence of the whole text (else null), n_notices (lines that are a known text),
    notices (their licences, sorted)."""
    names = lookup_side(known_digests(docs.sparkSession, known))
    rows = docs.select(F.col(id_col), canonical_lines(F.col(text_col)).alias("lines_"), F.monotonically_increasing_id().alias("row_"))
    whole = rows.select(id_col, "row_", digest(F.array_join("lines_", " ")).alias("text_digest"))
    lines = (rows.select("row_", F.explode(F.transform("lines_", digest)).alias("digest")).join(names, "digest")
             .groupBy("row_").agg(F.count(F.lit(1)).alias("n_"), F.array_sort(F.collect_set("licence")).alias("notices_")))
    return (whole.join(names.withColumnsRenamed({"digest": "digest_", "licence": "licence_"}), F.col("text_digest") == F.col("digest_"), "left")
            .join(lines, "row_", "left")
            .select(id_col, "text_digest", F.col("licence_").alias("licence"), F.coalesce("n_", F.lit(0)).cast("long").alias("n_notices"),
                    F.coalesce("notices_", F.array().cast("array<string>")).alias("notices")))
