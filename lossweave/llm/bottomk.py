"""Document fingerprints as bottom-k sketches of word shingles, in DataFrame functions only.

A sketch holds the k smallest different hashes of a text's shingles, ascending. Sketches of parts merge
into the sketch of the whole. Two of them give resemblance and containment; one gives the number of
different shingles (exact below k).

A text with fewer words than a shingle is one shingle; one without words, and a null text, has the empty
sketch, which resembles only itself. Repeated rows have equal sketches. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossweave.operators.ordered import with_bucket

from .common import text_of, words_of

SHINGLE, K = 5, 128
ROWS_PER_BUCKET, MOST_BUCKETS = 500, 16_384


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    words = words_of(text)

    def hashes(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) >= width, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    # one binding of the words: the split is not repeated where they are used
    return F.get(F.transform(F.array(words), hashes), 0)


def sketch(text: Column, width: int = SHINGLE, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of common shingles among all shingles of two texts, estimated from the k smallest of the union."""
    both = merged(a, b, k)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(common / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Number of different shingles: exact while the sketch is not full, else (k - 1) over the k-th smallest hash as a share of the range."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of the shingles of the first text that the second has too."""
    r, union = resemblance(a, b, k), distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), r * union / distinct_shingles(a, k)))


def encoded(a: Column) -> Column:
    """The sketch as text: 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_sketch(docs: DataFrame, width: int = SHINGLE, k: int = K, name: str = "sketch") -> DataFrame:
    return docs.withColumn(name, sketch(text_of(), width, k))


def merge_by(parts: DataFrame, keys: list[str], k: int = K, name: str = "sketch") -> DataFrame:
    """Sketches of groups from those of their parts: hashes are deduplicated before and ranked after one shuffle.

    A group of any size only sends each partition's different hashes; the ranking keeps k of them per group.
    """
    hashes = parts.select(*keys, F.explode(name).alias("_h")).distinct()
    ranked = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(name))


def with_next(docs: DataFrame, k: int = K, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, text and sketch of every document, with those of the next one by id (after the last: the first).

    Rows of equal id follow each other by the hash of their texts; rows without an id come first. Ids are
    cut into buckets by splitters; the first document of each bucket also visits the bucket before, so a
    bucket knows all its neighbours and texts are shuffled once.
    """
    ids = docs.select("doc_id")
    buckets = min(max(math.ceil(ids.count() / rows_per_bucket), 1), MOST_BUCKETS)
    lows = with_bucket(ids, ["doc_id"], buckets).groupBy("_bucket").agg(F.min(F.struct("doc_id")).alias("_low"))
    firsts = lows.withColumn("_before", F.lag("_bucket").over(Window.orderBy("_bucket")))
    last = F.max("_bucket").over(Window.partitionBy(F.lit(0)))
    firsts = firsts.withColumn("_last", last).select(F.col("_low.doc_id").alias("_low"), F.coalesce("_before", "_last").alias("_before"))
    rows = with_bucket(docs.select("doc_id", text_of().alias("text")), ["doc_id"], buckets)
    # at most one row for each bucket: bounded by MOST_BUCKETS
    rows = rows.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("_low")), "left")
    own, visit = F.struct("_bucket", F.lit(0).alias("guest")), F.struct(F.col("_before").alias("_bucket"), F.lit(1).alias("guest"))
    spots = F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, visit)))
    seated = rows.select("doc_id", "text", spots.alias("_s")).select("doc_id", "text", "_s._bucket", "_s.guest").repartition("_bucket")
    line = Window.partitionBy("_bucket").orderBy("guest", "doc_id", "_h")
    known = with_sketch(seated.withColumn("_h", F.xxhash64("text")), k=k)
    return (
        known.withColumn("next_text", F.lead("text").over(line)).withColumn("next_sketch", F.lead("sketch").over(line))
        .where("guest = 0").select("doc_id", "text", "sketch", "next_text", "next_sketch")
    )


def edited(text: Column, other: Column) -> Column:
    """The text with its last half replaced by as many of the first code points of the other (or all of it)."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (F.char_length(text) - half).cast("int")), F.substring(other, F.lit(1), half))
