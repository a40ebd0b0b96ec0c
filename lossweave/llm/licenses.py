"""License scan by canonical digest lookup.

A text is normalised (case, copyright lines, equivalent spellings, punctuation, white space) and its SHA-256
is hash-joined to the digests of known licence texts, which go through the same expressions. Whole texts
are matched, as the method asks; short standard notices that stand on a line of their own are looked
up the same way, so that a document which carries a notice is reported too.

``scanned`` takes further known texts as a table ``(license, text)`` of any size; ``license_files`` makes one of a folder. A text known
under several names is reported under all of them. A line is a copyright line if it starts with the word or sign, unless the word goes on as in
"copyright notice" or "copyright holders", where a wrapped sentence may have put it.

Null and empty texts have the digest of the empty text and match nothing; repeated rows are reported alike; an empty table gives an
empty result; very long texts and lines are normalised whole, inside the JVM; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossweave.session import lookup_join

from .common import text_of

# Equivalent spellings, each (pattern, replacement), in the order in which they are applied.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("non-commercial", "noncommercial"),
    ("per cent", "percent"),
    ("https", "http"),
)
COPYRIGHT = r"(?m)^[ \t]*(copyright\b(?![ \t]+(?:notices?|holders?|owners?|laws?|and|or|licen[cs]es?)\b)|\(c\)|©)[^\n]*$"

# Public licence texts and standard notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
KNOWN = (
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC),
    ("0BSD", ZERO_BSD), ("0BSD", "Zero-Clause BSD\n\n" + ZERO_BSD),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("reserved", "All rights reserved."),
)


def canonical(text: Column) -> Column:
    """The normal form: words of letters and digits with single spaces, without copyright lines."""
    c = F.regexp_replace(F.lower(text), F.lit(COPYRIGHT), F.lit(""))
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(c, F.lit(r"[^\p{L}\p{N}]+"), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def license_files(spark: SparkSession, path: str) -> DataFrame:
    """(license, text) of the files of a folder that all executors can read, named by the files."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("license"), F.col("value").alias("text"))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license) of the built-in texts and those of ``known``, made by the same expressions; each digest once."""
    rows = spark.createDataFrame(list(KNOWN), "license string, text string")
    if known is not None:
        rows = rows.unionByName(known.select("license", "text"))
    named = rows.select(digest(F.col("text")).alias("digest"), "license").where(F.col("digest") != digest(F.lit("")))
    return named.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("license"))


def scanned(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, canonical_sha256, license (of the entire text, else null) and notices (licences of whole lines, sorted).

    The table of known texts is counted and broadcast only within the bound of ``lookup_join``. Lines are looked up in the built-in list,
    which is short and fixed, inside their own row, whatever their length.
    """
    spark = docs.sparkSession
    by_digest = F.create_map(*[F.lit(x) for r in sorted(known_digests(spark).collect()) for x in r])
    marked = F.regexp_extract_all(F.lower(text_of()), F.lit(r"(?m)^[^\n]*(?:licen[cs]e|rights reserved)[^\n]*$"), F.lit(0))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(marked, lambda x: F.try_element_at(by_digest, digest(x))), lambda x: x.isNotNull())))
    rows = docs.select("doc_id", digest(text_of()).alias("canonical_sha256"), found.alias("notices"))
    matched = lookup_join(rows, known_digests(spark, known).withColumnRenamed("digest", "canonical_sha256"), ["canonical_sha256"])
    return matched.select("doc_id", "canonical_sha256", "license", F.array_join("notices", ",").alias("notices"))
