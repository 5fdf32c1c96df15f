"""Licence scan by canonical digests, in DataFrame functions only.

A text is normalised: lower case, copyright notices removed (lines that
begin with "copyright" or "(c)" followed by a year, a place for one or a (c) sign, with "©", or are "all rights
reserved"; other lines that begin with "copyright" are text), a title line of the known whole texts before further
lines dropped, equivalent spellings mapped to one form, everything but
letters and digits turned into single spaces. The SHA-256 of what is left is hash-joined to the digests of known
licence texts and notices. Units looked up per document: the whole text, and every line as a whole (a notice inside
other text is a unit of its own). Equality of digests is equality of entire normalised units, never of a prefix.

The known list is a parameter ``(license_id, text)``; it is normalised by the same plan. Nulls and empty texts match
nothing. A notice found in a third of all rows is one hot digest: the known side is broadcast when a count shows at
most ``broadcast_rows`` rows, and beyond that AQE splits the hot digest's partition (the digests are written first, so
neither side is tied to a partitioning). Row numbers are fixed by that written table, so repeated rows stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.common import write_table
from textlake.session import broadcast_if_small

# Short public licence texts and the usual notices that name one.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
            "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
            "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
            "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
            "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
            "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
            "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
            "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
            "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]

# Spellings that licence matching guidelines treat as equal, as whole words.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("authorised", "authorized"),
    ("authorisation", "authorization"), ("organisation", "organization"), ("favour", "favor"),
    ("merchantibility", "merchantability"), ("noncommercial", "non commercial"), ("sublicence", "sublicense"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("per cent", "percent"),
    ("while", "whilst"), ("wilful", "willful"), ("analogue", "analog"), ("v", "version"),
]

_YEAR = r"(?:\d{4}\b|[<\[{(]*(?:yyyy|years?)\b)"
COPYRIGHT = (r"(?m)^[ \t]*(?:©|copyright[ \t:,]*(?:\(c\)|©|" + _YEAR + r")|\(c\)[ \t]*(?:copyright\b|©|" + _YEAR + r"))"
              r".*$|^[ \t]*all rights reserved[ \t.!]*$")
TITLE = r"\A\s*(?:the )?(?:mit|expat|isc) licen[sc]e(?: \((?:mit|expat|isc)\))?[ \t:.]*(?:\r\n|\n|\r)(?=\s*\S)"


def normalise(text: Column) -> Column:
    """Canonical form of a unit: see the module text. Empty when nothing but copyright notices or punctuation is left."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    t = F.regexp_replace(t, TITLE, " ")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")
    t = F.concat(F.lit(" "), F.trim(t), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null when it is empty."""
    canon = normalise(text)
    return F.when(F.length(canon) > 0, F.sha2(canon, 256))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """``(digest, license_id)``, one row per digest (smallest id where two known texts normalise alike)."""
    known = spark.createDataFrame(KNOWN, "license_id string, text string") if known is None else known
    return (known.select(digest(F.col("text")).alias("digest"), "license_id")
            .where("digest is not null and license_id is not null").groupBy("digest")
            .agg(F.min("license_id").alias("license_id")))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """``(doc_id, digest, license_id, notices)`` per row of ``docs (doc_id, text)``.

    ``license_id``: the known licence that the whole text is, else null. ``notices``: the lines that are a known text,
    as an array of ``(line, license_id)`` in line order (line from 1). A licence list of at most ``broadcast_rows``
    rows goes to every task; a larger one is shuffled with the units.
    """
    spark = docs.sparkSession
    names = broadcast_if_small(known_digests(spark, known), broadcast_rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    units = F.filter(F.transform(F.split(text, "\r\n|\n|\r"),
                                 lambda u, i: F.struct((i + 1).alias("line"), digest(u).alias("digest"))),
                     lambda u: u["digest"].isNotNull())
    base = write_table(docs.select("doc_id", F.monotonically_increasing_id().alias("_row"),
                                   digest(text).alias("digest"), units.alias("units")), "license_units")
    lines = base.select("_row", F.inline("units"))
    hits = lines.join(names, "digest").groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("line", "license_id"))).alias("notices"))
    whole = base.select("doc_id", "_row", "digest")
    return (whole.join(names, "digest", "left").join(hits, "_row", "left")
            .select("doc_id", "digest", "license_id",
                    F.coalesce("notices", F.array().cast("array<struct<line:int,license_id:string>>")).alias("notices")))
