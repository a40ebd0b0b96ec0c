"""Readers, writers and file checks around the engine's tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SOURCE_COLUMNS

BLOCK = 8 * 1024 * 1024
SERIES_DOCUMENT = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("Results", T.StructType([
        T.StructField("series", T.ArrayType(T.StructType([
            T.StructField("seriesID", T.StringType()),
            T.StructField("data", T.ArrayType(T.StructType([
                T.StructField("year", T.StringType()), T.StructField("period", T.StringType()),
                T.StructField("value", T.StringType()),
            ]))),
        ]))),
    ])),
])


def read_snapshot(spark: SparkSession, path: str | list[str], columns: Sequence[str] = SOURCE_COLUMNS, multi_line: bool = False) -> DataFrame:
    """Named columns of wide CSV files as strings, blanks kept as ``''``, with the file of origin.

    Each path of a list has a header of its own, whose columns may come in any order. Files below one path must
    share their header, else the job fails: Spark would read them by position. Doubled quotes are one quote.
    ``multi_line`` allows line breaks inside quotes; such files cannot be split among tasks.
    """
    reader = spark.read.options(header=True, inferSchema=False, enforceSchema=False, escape='"', multiLine=multi_line)
    blanks = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns]
    found = [reader.csv(p).select(*blanks, F.col("_metadata.file_name").alias("source_file")) for p in ([path] if isinstance(path, str) else path)]
    return reduce(DataFrame.unionByName, found)


def write_text_table(df: DataFrame, path: str, header: bool = True) -> None:
    """CSV that keeps leading and trailing blanks of values."""
    writer = df.write.option("header", header).option("emptyValue", "").option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_panel(df: DataFrame, path: str, by: str = "year") -> None:
    """Partitioned for pruning; every task writes its own files, so landing needs no shuffle."""
    df.write.partitionBy(by).parquet(path)


def read_quarterly(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``state, year, q, hpi`` with the integer quarter index."""
    schema = "state string, year int, q int, hpi double"
    rows = spark.read.schema(schema).option("header", False).csv(path)
    return rows.withColumn("quarter", F.col("year") * 4 + F.col("q") - 1)


def read_crosswalk(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """``(series_id, state)`` pairs of a pipe-delimited text table; any other number of pairs is an error."""
    line = r"^\|\s*([A-Z0-9]+)\s*\|\s*([A-Za-z0-9]+)\s*\|\s*$"
    text = spark.read.text(path)
    pairs = text.select(
        F.regexp_extract("value", line, 1).alias("series_id"), F.regexp_extract("value", line, 2).alias("state")
    ).where("series_id <> ''")
    found = pairs.select("series_id").distinct().count()
    if found != expected:
        raise ValueError(f"crosswalk holds {found} series, expected {expected}")
    return pairs


def flatten_series(documents: DataFrame, crosswalk: DataFrame, years: tuple[int, int]) -> DataFrame:
    """``(state, month, u, series)`` from nested series documents.

    Period ``M13`` (the annual mean) is dropped; an observation outside the authorised years
    fails the job. The crosswalk has one row per state and is small by construction.
    """
    series = documents.select(F.explode("Results.series").alias("s"))
    points = series.select(F.col("s.seriesID").alias("series"), F.explode("s.data").alias("o"))
    months = points.where(F.col("o.period").rlike("^M(0[1-9]|1[0-2])$"))
    year = F.col("o.year").cast("int")
    allowed = F.when(year.between(*years), year).otherwise(
        F.raise_error(F.concat(F.lit("unauthorised year "), F.col("o.year"), F.lit(" in "), F.col("series")))
    )
    index = allowed * 12 + F.substring("o.period", 2, 2).cast("int") - 1
    named = months.select("series", index.alias("month"), F.col("o.value").try_cast("double").alias("u"))
    return named.join(crosswalk.withColumnRenamed("series_id", "series"), "series").select("state", "month", "u", "series")


def read_series_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(SERIES_DOCUMENT).option("multiLine", multi_line).json(path)


def with_row_id(landed: DataFrame) -> DataFrame:
    """``file:row`` from the file metadata of a landed Parquet table."""
    meta = F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    return landed.select("*", meta.alias("file_row_id"))


def identity_report(df: DataFrame, key: str) -> DataFrame:
    """Rows and distinct ids. Ids are grouped, then counted, so no task holds them all."""
    groups = df.groupBy(key).agg(F.count("*").alias("_n"))
    return groups.agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_ids"), F.count_if(F.col("_n") > 1).alias("repeated_ids"))


def save_result(df: DataFrame, path: str) -> None:
    """A small aggregate as one CSV file."""
    df.coalesce(1).write.option("header", True).mode("errorifexists").csv(path)


def load_result(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A saved result under its declared schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def finite_or_null(column: Column) -> Column:
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        out = []
        for path in batch["path"]:
            store, name = fs.FileSystem.from_uri(path)
            digest, size = hashlib.sha256(), 0
            with store.open_input_stream(name) as stream:
                while block := stream.read(BLOCK):
                    digest.update(block)
                    size += len(block)
            out.append((path, digest.hexdigest(), size))
        yield pd.DataFrame(out, columns=["path", "sha256", "bytes"])


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(file, sha256, bytes)``, files named by their path below ``path``. Only names are listed by Spark; each task streams its files in blocks."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    names = listing.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length")
    spread = names.repartition(F.col("path")).select("path")
    digests = spread.mapInPandas(_digests, "path string, sha256 string, bytes long")
    root = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", path.rstrip("/"))
    below = F.substring("path", F.instr("path", root) + len(root) + 1, F.length("path"))
    name = F.when((F.instr("path", root) > 0) & (below != ""), below).otherwise(F.element_at(F.split("path", "/"), -1))
    return digests.select(name.alias("file"), "sha256", "bytes")


def verify_files(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """Full comparison with the manifest: missing, extra and altered files all fail."""
    want = manifest.select("file", F.col("sha256").alias("expected_sha256"), F.col("bytes").alias("expected_bytes"))
    both = inventory.join(want, "file", "full_outer")
    same = (F.col("sha256") == F.col("expected_sha256")) & (F.col("bytes") == F.col("expected_bytes"))
    return both.withColumn("passed", F.coalesce(same, F.lit(False)))


def require_passed(checks: DataFrame) -> None:
    failed = checks.where("not passed").limit(5).collect()
    if failed:
        raise ValueError(f"verification failed: {[r.asDict() for r in failed]}")


def _prefix_digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        out = []
        for path, size, want in zip(batch["path"], batch["bytes"], batch["sha256"]):
            store, name = fs.FileSystem.from_uri(path)
            digest, left = hashlib.sha256(), int(size)
            with store.open_input_stream(name) as stream:
                while left and (block := stream.read(min(BLOCK, left))):
                    digest.update(block)
                    left -= len(block)
            out.append((path, left == 0 and digest.hexdigest() == want))
        yield pd.DataFrame(out, columns=["path", "passed"])


def verify_prefixes(manifest: DataFrame) -> DataFrame:
    """For append-only files: the first ``bytes`` bytes of ``path`` still hash to ``sha256``."""
    return manifest.repartition(F.col("path")).mapInPandas(_prefix_digest, "path string, passed boolean")
