"""What the operators of this subpackage share: table access, Arrow passes, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrow_pass(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """One narrow pass over whole rows in short Arrow batches, so that very long texts stay within a worker's memory."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts as bytes; null is the empty text. ``bytes.split()`` cuts at exactly the white space of ``SPACE``."""
    return [b"" if v is None else v for v in batch.column(name).cast(pa.binary()).to_pylist()]


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(column: Column) -> Column:
    return F.array_remove(F.split(column, f"{SPACE}+"), "")


def n_words(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo: what decides whether a document is held out."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus
