"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

The shard of a key follows from the key and the number of shards; there is no ring table. With one
more shard, a row either stays or moves into the new one. Slots number the rows of a shard without
gaps: shards are cut into hash blocks, numbered inside a block and shifted by the rows of lower blocks,
so no task ever holds a shard.

Null keys share one shard; null texts have no bytes and the CRC of the empty text; repeated rows get
slots of their own; an empty table gives an empty result; further columns are kept by ``with_shard``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

MULTIPLIER = 2862933555777941757  # fixed value: the generator of the published algorithm
LOW32, LOW16 = (1 << 32) - 1, (1 << 16) - 1
ROWS_PER_BLOCK = 4096
ROW_BYTES = 16


def _advance(state: Column) -> tuple[Column, Column]:
    """One step of the 64-bit linear congruential generator in two halves, none of whose sums can overflow."""
    high, low = state["high"], state["low"]
    m_high, m_mid, m_low = MULTIPLIER >> 32, (MULTIPLIER >> 16) & LOW16, MULTIPLIER & LOW16
    mid = low * F.lit(m_mid)
    total = low * F.lit(m_low) + F.shiftleft(mid.bitwiseAND(F.lit(LOW16)), 16) + F.lit(1)
    upper = (
        F.shiftright(total, 32)
        + F.shiftright(mid, 16)
        + (low * F.lit(m_high)).bitwiseAND(F.lit(LOW32))
        + (high * F.lit(m_low)).bitwiseAND(F.lit(LOW32))
        + F.shiftleft((high * F.lit(m_mid)).bitwiseAND(F.lit(LOW16)), 16)
    )
    return upper.bitwiseAND(F.lit(LOW32)), total.bitwiseAND(F.lit(LOW32))


def jump(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1 of a 64-bit key.

    The expected number of jumps is logarithmic; a row that needs more than the short loop goes on in a
    loop of ``shards`` steps, which always suffice.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def step(state: Column, _: Column) -> Column:
        high, low = _advance(state)
        unit = F.lit(float(1 << 31)) / (F.shiftright(high, 1) + F.lit(1)).cast("double")
        after = F.struct(
            high.alias("high"), low.alias("low"), state["at"].alias("shard"),
            F.floor((state["at"] + F.lit(1)).cast("double") * unit).cast("long").alias("at"),
        )
        return F.when(state["at"] < F.lit(shards), after).otherwise(state)

    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(LOW32)).alias("low"),
        F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("at"),
    )
    short = 4 * max(shards.bit_length(), 4) + 8
    ended = F.aggregate(F.sequence(F.lit(1), F.lit(short)), start, step)
    if short < shards:
        rest = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), ended, step)
        ended = F.when(ended["at"] < F.lit(shards), rest).otherwise(ended)
    return ended["shard"].cast("int")


def with_shard(docs: DataFrame, shards: int, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """The rows with their shard; stable keys of any type, hashed to 64 bits first."""
    return docs.withColumn(name, jump(F.xxhash64(F.col(key)), shards))


def with_slot(rows: DataFrame, shards: int, keys: DataFrame, order: list[str], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Adds ``slot``, gapless from 0 inside ``shard``. ``keys``: a cheap frame with the same ids and shards, for counting."""
    blocks = max(1, math.ceil(keys.count() / (shards * rows_per_block)))
    block = F.pmod(F.xxhash64(F.lit("block"), F.col(order[0])), F.lit(blocks)).cast("int")
    counted = keys.select("shard", block.alias("_block")).groupBy("shard", "_block").count()
    below = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("shard", "_block", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard", "_block").orderBy(*order)
    numbered = rows.withColumn("_block", block).withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(base, ["shard", "_block"]).withColumn("slot", F.col("_base") + F.col("_at")).drop("_block", "_at", "_base")


def assignments(docs: DataFrame, shards: int) -> DataFrame:
    """One digest row per document: size, checksum, shard, slot, and the shard if there were one more."""
    digest = docs.select(
        "doc_id",
        (F.octet_length(text_of()) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text_of()).alias("text_crc32"),
    )
    keys = with_shard(docs.select("doc_id"), shards)
    placed = with_slot(with_shard(digest, shards), shards, keys, ["doc_id", "text_crc32", "size"])
    return with_shard(placed, shards + 1, name="grown_shard")


def write_shards(docs: DataFrame, shards: int, path: str, rows_per_file: int = 1 << 20) -> None:
    """Writes whole rows into one folder per shard; a shard is spread over as many tasks as it has blocks of rows."""
    parts = max(1, math.ceil(docs.count() / (shards * rows_per_file)))
    part = F.pmod(F.xxhash64(F.lit("file"), F.col("doc_id")), F.lit(parts))
    with_shard(docs, shards).repartition(shards * parts, "shard", part).write.partitionBy("shard").parquet(path)
