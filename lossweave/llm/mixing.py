"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source gets a target in words, at most ``MOST_PASSES`` times its size; what a capped source leaves
is shared again by weight. A source's documents are dealt into hash blocks; each pass over the source takes
the blocks in an order of its own. Whole passes take all blocks; the last one takes blocks while they fit, and
from the next block the documents that fill the rest. The block quotas of the sources are split among the output
shards by a binary tree: a node hands its left half a multivariate-hypergeometric draw from what it holds,
seeded by the node, so any shard can work out its own counts again. Shards then draw consecutive, disjoint runs
of the permuted blocks and shuffle locally.

A null source is a source of its own, the last one. Null texts have no words and are never taken. Rows that are
repeated are taken one by one; rows that share an id or have none are dealt by their texts too. An empty table gives an empty result.
The driver holds a few numbers for each source, never documents or blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossweave.session import lookup_join, staged

from .common import n_words, text_of

WEIGHTS, SHARE, MOST_PASSES = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK_ROWS, SHARDS, SEED = 1024, 64, 20_240
MOST_BITS = 1 << 17  # of the exact filling: words, or units of a wide room
MOST_DRAWN = 900_000_000  # block draws in all: numpy's exact hypergeometric draw holds up to a billion
SOURCE, CONTENT = "_source", "_content"


def source_key(column: str = "source") -> Column:
    """Text that tells a null source from every named one."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("~"))


def targets(sizes: dict[str, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> dict[str, float]:
    """Words for each source key: by weight, capped, the rest shared again until no source is above its cap."""
    order = sorted(sizes, key=lambda k: (k == "~", k))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    goal, open_ = {}, list(order)
    rest = share * sum(sizes.values())
    while open_:
        total = sum(weight[k] for k in open_)
        over = [k for k in open_ if rest * weight[k] / total > most * sizes[k]]
        if not over:
            goal |= {k: rest * weight[k] / total for k in open_}
            break
        for k in over:
            goal[k] = most * sizes[k]
            rest -= goal[k]
        open_ = [k for k in open_ if k not in goal]
    return goal


def _node_rng(seed: int, lo: int, hi: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{lo}:{hi}".encode()).digest()[:8], "little"))


def shard_path(quota: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each source that ``shard`` gets, and how many of them the shards before it get."""
    lo, hi, held, before = 0, shards, quota.copy(), np.zeros_like(quota)
    total = int(quota.sum())
    edge = lambda k: total * k // shards  # noqa: E731  blocks of the first k shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(held, edge(mid) - edge(lo), _node_rng(seed, lo, hi))
        if shard < mid:
            held, hi = left, mid
        else:
            before, held, lo = before + left, held - left, mid
    return held, before


def split(held: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate-hypergeometric draw as a chain of hypergeometric ones, each from the sources that are left."""
    out, rest = np.zeros_like(held), int(held.sum())
    for i, n in enumerate(held.tolist()):
        rest -= n
        if take and n:
            out[i] = rng.hypergeometric(n, rest, take)
            take -= int(out[i])
    return out


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", n_words(text_of())).withColumn(SOURCE, source_key()).withColumn(CONTENT, F.xxhash64("text"))


def plan(digest: DataFrame, shards: int = SHARDS, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``digest`` (a written table of doc_id, size, content hash, source key) with its block, source size and target, and the draws.

    Draws: (source key, block, pass, shard, rank, whole): which pass over a source takes a block for which shard.
    """
    spark = digest.sparkSession
    stats = digest.groupBy(SOURCE).agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()
    words = {r[SOURCE]: r.words for r in stats}
    goal = targets(words)
    # above 3 x 10^11 documents blocks get longer, so that all draws stay exact
    block_rows = max(block_rows, math.ceil(sum(r.rows for r in stats) * (MOST_PASSES + 1) / MOST_DRAWN))
    blocks = {r[SOURCE]: max(1, math.ceil(r.rows / block_rows)) for r in stats}
    passes = {k: int(goal[k] // words[k]) if words[k] else 0 for k in words}
    table = [(k, words[k], float(goal[k]), blocks[k], passes[k], float(goal[k] - passes[k] * words[k])) for k in sorted(words)]
    info = spark.createDataFrame(table, f"{SOURCE} string, source_size long, target double, _blocks long, _passes int, _rest double")
    rows = lookup_join(digest, info, [SOURCE])
    rows = staged(rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", CONTENT), F.col("_blocks"))))

    sums = staged(rows.groupBy(SOURCE, "_block", "_blocks", "_passes", "_rest").agg(F.sum("size").alias("_words")))
    order = lambda p: F.xxhash64(F.lit(seed), p, SOURCE, "_block")
    line = Window.partitionBy(SOURCE, "_pass").orderBy(order(F.col("_pass")), "_block")
    passed = sums.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("_passes"))))
    ranked = passed.withColumn("_rank", F.row_number().over(line) - 1).withColumn("_upto", F.sum("_words").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    full = F.col("_pass") < F.col("_passes")
    draws = ranked.withColumn("_room", F.col("_rest") - (F.col("_upto") - F.col("_words"))).where(full | (F.col("_room") > 0))
    draws = draws.withColumn("_whole", full | (F.col("_words") <= F.col("_room")))
    # numbered over what there is: a hash block may be empty
    item = F.row_number().over(Window.partitionBy(SOURCE).orderBy("_pass", "_rank")).cast("long") - 1
    draws = staged(draws.withColumn("_item", item).select(SOURCE, "_block", "_pass", "_item", "_room", "_whole"))

    quota = {r[SOURCE]: r.n for r in draws.groupBy(SOURCE).agg(F.count("*").alias("n")).collect()}
    names = sorted(quota)
    counts = np.array([quota[k] for k in names], np.int64)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                held, before = shard_path(counts, shards, shard, seed)
                at = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], pa.string()), pa.array(before[at]), pa.array(held[at]), pa.array(np.full(len(at), shard, np.int32))], names=[SOURCE, "first", "n", "_shard"])

    shares = spark.range(shards).mapInArrow(runs, f"{SOURCE} string, first long, n long, _shard int")
    items = shares.select(SOURCE, "_shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("_item"))
    return rows, draws.join(items, [SOURCE, "_item"])


def fill(size: np.ndarray, order: np.ndarray, room: float, open_end: int = 16) -> np.ndarray:
    """Which sizes to take so that their sum comes close to, and not above, ``room``.

    Sizes are taken in the given order while they fit; then the last few of them are given back and the room is
    filled as well as the sizes not taken can: the reachable sums are the bits of one integer. It has at most
    ``MOST_BITS``; a wider room is counted in units of several words, sizes rounded up, and what rounding
    leaves is filled in order once more. So the work is bounded however long the texts are.
    """
    taken, left = np.zeros(len(size), bool), int(room)
    fits = []

    def take_in_order() -> None:
        nonlocal left
        for i in order:
            if not taken[i] and 0 < size[i] <= left:
                taken[i], left = True, left - int(size[i])
                fits.append(i)

    take_in_order()
    for i in fits[-open_end:]:
        taken[i], left = False, left + int(size[i])
    unit = -(-(left + 1) // MOST_BITS)
    wide = left // unit
    reach, mask, last = 1, (1 << wide + 1) - 1, np.zeros(wide + 1, np.int64)
    for i in order:
        step = -(-int(size[i]) // unit)
        if taken[i] or not 0 < step <= wide or reach >> wide & 1:
            continue
        fresh = (reach << step) & mask & ~reach
        if fresh:
            reach |= fresh
            bits = np.frombuffer(fresh.to_bytes(wide // 8 + 1, "little"), np.uint8)
            last[np.flatnonzero(np.unpackbits(bits, bitorder="little"))] = i
    total = reach.bit_length() - 1
    while total:
        i = last[total]
        taken[i], left, total = True, left - int(size[i]), total + int(size[i]) // -unit
    take_in_order()
    return taken


def fitting(draws: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents taken from the one block of each source that is not drawn whole. A block is a bounded group."""
    part = rows.join(draws.where("not _whole").select(SOURCE, "_block", "_room"), [SOURCE, "_block"])

    def choose(table: pa.Table) -> pa.Table:
        size, key = table.column("size").to_numpy(), table.column("_key").to_numpy()
        taken = fill(size, np.lexsort((size, key)), table.column("_room")[0].as_py())
        return pa.table({"_row": table.column("_row").filter(pa.array(taken))})

    keyed = part.select("_row", "size", "_room", SOURCE, "_block", F.xxhash64(F.lit("fit"), "doc_id", CONTENT).alias("_key"))
    return keyed.groupBy(SOURCE, "_block").applyInArrow(choose, "_row long")


def mixed(docs: DataFrame, shards: int = SHARDS, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and draws (pass, shard), one for each time it is taken."""
    return _drawn(staged(sized(docs).select("doc_id", "size", SOURCE, CONTENT).withColumn("_row", F.monotonically_increasing_id())), shards, block_rows, seed).drop("_row")


def _drawn(digest: DataFrame, shards: int, block_rows: int, seed: int) -> DataFrame:
    rows, draws = plan(digest, shards, block_rows, seed)
    draws = staged(draws)
    lists = draws.groupBy(SOURCE, "_block").agg(F.array_sort(F.collect_list(F.struct("_pass", "_shard", "_whole"))).alias("_draws"))
    some = fitting(draws, rows).withColumn("_fits", F.lit(True))
    whole = rows.join(lists, [SOURCE, "_block"], "left").join(some, "_row", "left")
    taken = F.filter(F.coalesce("_draws", F.array().cast("array<struct<_pass:int,_shard:int,_whole:boolean>>")), lambda d: (d["_whole"] | F.col("_fits").isNotNull()) & (F.col("size") > 0))
    out = whole.withColumn("draws", F.transform(taken, lambda d: F.struct(d["_pass"].alias("pass"), d["_shard"].alias("shard"))))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws", "_row")


def sampled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mixed documents, each as often as it is taken, shuffled locally inside their shards; columns as given.

    Rows are numbered in a written copy, so that the plan fits the rows it is applied to.
    """
    held = staged(sized(docs.select([F.col(c).alias(f"d_{c}") for c in docs.columns] + ["text", "source", "doc_id"])).withColumn("_row", F.monotonically_increasing_id()).drop("text", "source"))
    drawn = _drawn(held.select("doc_id", "size", SOURCE, CONTENT, "_row"), shards, BLOCK_ROWS, seed).where(F.size("draws") > 0).select("_row", F.explode("draws").alias("_d"))
    rows = held.join(drawn, "_row").select("_row", "_d.shard", "_d.pass", *[F.col(f"d_{c}").alias(f"d_{c}") for c in docs.columns])
    local = F.xxhash64(F.lit(seed), "shard", "pass", "_row")
    return rows.repartition("shard", F.pmod(local, F.lit(8))).sortWithinPartitions("shard", local).select([F.col(f"d_{c}").alias(c) for c in docs.columns])
