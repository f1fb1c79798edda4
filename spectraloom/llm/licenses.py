"""License scans by canonical digest lookup.

A text is brought into a canonical form (lower case, copyright lines dropped,
equivalent spellings unified, punctuation and white space to single blanks) and
looked up by digest among the canonical forms of known texts. The looked-up
units are the whole document and each of its lines, each as an entire text: a
notice inside a longer line does not count.

Null text is empty text and matches nothing; a row is a document even if its id
is null or repeated (equal rows count once). Other columns are ignored. Known
texts with an equal canonical form all match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.common import lines_of, row_key

# fixed values: equivalent spellings, and short notices by the identifier of their license
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("organisation", "organization"), ("authorised", "authorized"), ("favour", "favor"), ("fulfil", "fulfill"), ("merchantability", "merchantability"),
    ("modernise", "modernize"), ("utilisation", "utilization"), ("whilst", "while"), ("sub-license", "sublicense"), ("per cent", "percent"), ("https", "http"), ("centre", "center"), ("judgement", "judgment"),
)
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = (
    ("MIT", MIT), ("MIT", "The MIT License\n" + MIT), ("MIT", "MIT License\n" + MIT), ("ISC", ISC), ("ISC", "ISC License\n" + ISC),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This work is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Released under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), ("BSD-3-Clause", "Released under the BSD 3-Clause License."), ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."), ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."), ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Proprietary", "All rights reserved. Redistribution without permission is prohibited."),
)
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"
#: known texts up to this number go to every task; more of them are joined by a shuffle
BROADCAST_ROWS = 20_000


def canonical(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for other, usual in SPELLINGS:
        if other != usual:
            t = F.regexp_replace(t, rf"\b{other}\b", usual)
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def known_licenses(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    return spark.createDataFrame(list(known), "license string, text string")


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per document and license found: doc_id, license, whole (the document is that text), n_lines."""
    known = known_licenses(docs.sparkSession) if known is None else known
    known = known.select("license", F.md5(canonical(F.col("text"))).alias("digest"), (canonical(F.col("text")) == "").alias("_no")).where("not _no").select("license", "digest").distinct()
    known = F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known
    rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a line that is the whole text is one unit
    single = ~F.col("text").contains("\n")
    units = rows.select("key", "doc_id", F.explode(F.when(single, F.array(F.struct(F.lit(True).alias("whole"), F.lit(1).alias("lines"), F.col("text").alias("unit")))).otherwise(
        F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.lit(0).alias("lines"), F.col("text").alias("unit"))), F.transform(lines_of(), lambda x: F.struct(F.lit(False).alias("whole"), F.lit(1).alias("lines"), x.alias("unit"))))
    )).alias("u")).select("key", "doc_id", "u.*")
    found = units.withColumn("digest", F.md5(canonical(F.col("unit")))).join(known, "digest")
    # equal rows of documents give equal units: max over them, sum over lines
    per_line = found.groupBy("key", "doc_id", "license").agg(F.max("whole").alias("whole"), F.sum("lines").alias("n"))
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return per_line.join(copies, "key", "left").select("doc_id", "license", "whole", (F.col("n") / F.coalesce("copies", F.lit(1))).cast("long").alias("n_lines"))
