"""Exact order statistics without a global sort in one task.

A total order over all rows is cut into buckets by splitters drawn from a bounded hash sample
of the keys. Running totals are taken inside each bucket and shifted by the totals of the lower
buckets (one short row per bucket). Because the ordering key may contain tie-breakers, a score
shared by a third of all rows is spread over many buckets; because buckets are a pure function
of the key, a recomputed task puts every row where it was before.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, lookup_join, staged

SAMPLE_PER_BUCKET = 16
CUTS = 64


def bucket_count(df: DataFrame) -> int:
    """As many buckets as the session shuffles into, so buckets shrink as the cluster grows."""
    return min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16), 4096)


def splitters(df: DataFrame, order: Sequence[str], buckets: int) -> DataFrame:
    """One row: evenly spaced keys of a deterministic bounded sample, in blocks for a two-step search."""
    width = max(int(buckets**0.5), 1)
    key = F.struct(*order)
    sample = df.select(key.alias("_k")).orderBy(F.xxhash64("_k"), "_k").limit(SAMPLE_PER_BUCKET * buckets)
    pool = sample.agg(F.sort_array(F.collect_set("_k")).alias("_s"))
    step = F.greatest((F.size("_s") / buckets).cast("int"), F.lit(1))
    cuts = pool.select(F.filter("_s", lambda _, i: i % step == 0).alias("_c"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_c"), F.lit(1)), F.lit(width))
    return cuts.select(
        F.struct(
            F.filter("_c", lambda _, i: i % width == 0).alias("heads"),
            F.transform(starts, lambda i: F.slice("_c", i, width)).alias("blocks"),
        ).alias("_cuts")
    )


def with_bucket(df: DataFrame, order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Adds ``_bucket``, non-decreasing in ``order``."""
    buckets = buckets or bucket_count(df)
    width = max(int(buckets**0.5), 1)
    key = F.struct(*order)
    cut = df.withColumn("_cuts", splitters(df, order, buckets).scalar())
    head = cut.withColumn("_h", F.size(F.filter("_cuts.heads", lambda c: c <= key)) - 1)
    block = F.get("_cuts.blocks", F.col("_h"))
    inside = F.size(F.filter(block, lambda c: c <= key))
    bucket = F.when(F.col("_h") < 0, F.lit(0)).otherwise(F.col("_h") * width + inside)
    # never NULL: otherwise joins on the bucket push a null check, with the whole search in it,
    # below the aggregations that feed this operator
    return head.withColumn("_bucket", F.coalesce(bucket, F.lit(0))).drop("_cuts", "_h")


def running_totals(
    df: DataFrame, order: Sequence[str], sums: dict[str, str], buckets: int | None = None
) -> DataFrame:
    """For each ``name: column`` adds ``name`` = inclusive running sum of ``column`` in ``order``.

    ``order`` must identify rows; pass combined rows and only the columns needed. Sums of
    integers are exact.
    """
    df = staged(df)  # read three times below
    marked = with_bucket(df, order, buckets)
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy("_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    # a bounded number of buckets: one short window, then a broadcast of the same size
    offsets = totals.select(
        "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(below), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    local = marked.select("*", *[F.sum(c).over(inside).alias(f"_l_{n}") for n, c in sums.items()])
    joined = local.join(F.broadcast(offsets), "_bucket")
    shifted = [(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]
    return joined.select(*df.columns, *shifted)


def ranked(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """One-based position of every row in the total order."""
    return running_totals(df.withColumn("_one", F.lit(1)), order, {name: "_one"}).drop("_one")


def _literal(values: Sequence[object], order: Sequence[str]) -> Column:
    return F.struct(*[F.lit(v).alias(c) for v, c in zip(values, order, strict=True)])


def kth_key(df: DataFrame, order: Sequence[str], k: int, small: int = 10_000) -> tuple:
    """The ``k``-th smallest key. Each round counts rows between splitters and keeps one interval.

    The driver sees splitters, bucket counts and at last a short list, never the rows.
    """
    key, rest, buckets = F.struct(*order), df, 64
    while True:
        blocks = splitters(rest, order, buckets).first()[0].blocks
        cuts = [c for block in blocks for c in block]
        inside = F.size(F.filter(F.array(*[_literal(c, order) for c in cuts]), lambda c: c <= key))
        counts = dict(rest.groupBy(inside.alias("b")).agg(F.count("*").alias("n")).collect())
        bucket, below = 0, 0
        while below + counts.get(bucket, 0) < k:
            below += counts.get(bucket, 0)
            bucket += 1
        k -= below
        if bucket:
            rest = rest.where(key >= _literal(cuts[bucket - 1], order))
        if bucket < len(cuts):
            rest = rest.where(key < _literal(cuts[bucket], order))
        if counts[bucket] <= small or len(cuts) < 2:
            return tuple(rest.select(*order).orderBy(*order).limit(k).agg(F.max(key)).first()[0])


def boundary_keys(df: DataFrame, order: Sequence[str], fraction: float, by: Sequence[str], small: int = 10_000) -> DataFrame:
    """``(_g, _last)``: for every group the key of its ``floor(fraction * n)``-th row; groups with no such row are left out.

    All groups are narrowed down together. A round draws a bounded sample of keys from each group that is still large, counts
    the intervals between them and keeps one interval a group, so the number of passes follows the largest group and not
    the number of groups. Keys equal to a cut are an interval of their own. Only keys are written; nulls in ``by`` are a group.
    """
    rest = staged(df.select(F.struct(*[F.col(c) for c in by]).alias("_g"), F.struct(*order).alias("_k")))
    sizes = rest.groupBy("_g").agg(F.count("*").alias("_n"))
    wanted = staged(sizes.select("_g", F.floor(F.lit(float(fraction)) * F.col("_n")).alias("_want")).where("_want > 0"))
    rest, turn, most = rest.join(wanted.select("_g"), "_g", "left_semi"), 0, BROADCAST_ROWS // CUTS
    run = F.sum("count").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))

    def holding(counts: DataFrame) -> DataFrame:
        """The interval of each group that holds the wanted row, and the position of the row inside it."""
        placed = counts.withColumn("_run", run).join(wanted, "_g")
        return placed.where("_run >= _want and _run - count < _want").select("_g", "_b", (F.col("_want") - F.col("_run") + F.col("count")).alias("_want"))

    while True:
        ends = rest.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))
        large = staged(ends.where((F.col("_n") > small) & (F.col("_lo") < F.col("_hi"))).select("_g", "_n"))
        if large.isEmpty():
            break
        share = F.lit(float(SAMPLE_PER_BUCKET * CUTS)) / F.col("_n")
        drawn = lookup_join(rest, large, ["_g"], "inner").where(F.pmod(F.xxhash64(F.lit(turn), "_k"), F.lit(1 << 30)) < share * float(1 << 30))
        pool = drawn.groupBy("_g").agg(F.sort_array(F.collect_set("_k")).alias("_s"))
        step = F.greatest(F.ceil(F.size("_s") / CUTS).cast("int"), F.lit(1))
        cuts = pool.select("_g", F.filter("_s", lambda _, i: i % step == 0).alias("_c"))
        marked = lookup_join(rest, cuts, ["_g"], "left", most)
        spot = F.size(F.filter("_c", lambda c: c < F.col("_k"))) + F.size(F.filter("_c", lambda c: c <= F.col("_k")))
        marked = marked.select("_g", "_k", F.when(F.col("_c").isNull(), 0).otherwise(spot).alias("_b"))
        kept = staged(holding(marked.groupBy("_g", "_b").count()))
        rest = staged(lookup_join(marked, kept.select("_g", "_b"), ["_g", "_b"], "inner").select("_g", "_k"))
        wanted, turn = kept.select("_g", "_want"), turn + 1
    return holding(rest.groupBy("_g", F.col("_k").alias("_b")).count()).select("_g", F.col("_b").alias("_last"))


def lowest_fraction(df: DataFrame, order: Sequence[str], fraction: float, by: Sequence[str] = (), small: int = 10_000) -> DataFrame:
    """Exactly ``floor(fraction * n)`` rows, of the table or of every group, lowest in ``order`` first; ``order`` must identify rows.

    Once the boundary key is known, acceptance is a filter: no sort and no shuffle of the table. ``df`` is read twice, for its
    keys and for the result, so it should come from a written table.
    """
    if by:
        group = F.struct(*[F.col(c) for c in by])
        marked = lookup_join(df.withColumn("_g", group), boundary_keys(df, order, fraction, by, small), ["_g"], "inner")
        return marked.where(F.struct(*order) <= F.col("_last")).select(*df.columns)
    keys = staged(df.select(*order))
    k = math.floor(fraction * keys.count())
    if k == 0:
        return df.where(F.lit(False))
    last = kth_key(keys, order, k, small)
    return df.where((F.col(order[0]) <= F.lit(last[0])) & (F.struct(*order) <= _literal(last, order)))


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = (), name: str = "quantiles"
) -> DataFrame:
    """Linear-interpolation quantiles per group as an array, from value counts and running totals.

    Repeated values are combined before the shuffle and groups of any size are spread over
    buckets. NULL values are ignored; keys in ``by`` must not be NULL.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_totals(counts, [*by, "_v"], {"_cum": "_n"})
    marker = by or [F.lit(1).alias("_all")]
    sizes = placed.groupBy(*marker).agg(F.sum("_n").alias("_size"), F.min(F.col("_cum") - F.col("_n")).alias("_start"))
    if by:
        rows = placed.join(sizes, by)
    else:
        whole = sizes.select(F.struct("_size", "_start").alias("s"))
        rows = placed.withColumn("_w", whole.scalar()).select(*placed.columns, "_w._size", "_w._start")
    # one aggregate picks, per probability, the two neighbouring order statistics (0-based rank k
    # lies in the value whose running count first exceeds k)
    pick = "max(case when _cum - _start - _n <= {rank} and {rank} < _cum - _start then _v end)"
    picks, blends = [], []
    for i, q in enumerate(probabilities):
        spot = f"({float(q)!r}D * (_size - 1))"
        picks += [F.expr(pick.format(rank=f"floor({spot})") + f" as _lo{i}"), F.expr(pick.format(rank=f"ceil({spot})") + f" as _hi{i}"),
                  F.expr(f"max({spot} - floor({spot})) as _f{i}")]
        blends.append(f"_lo{i} + (_hi{i} - _lo{i}) * _f{i}")
    found = rows.groupBy(*by).agg(*picks)
    return found.select(*by, F.expr(f"array({', '.join(blends)})").alias(name))


def inner_cuts(quantiles: Column) -> Column:
    """Distinct quantiles without the outer two: the inner bin edges (tails stay open)."""
    distinct = F.array_sort(F.array_distinct(quantiles))
    return F.when(F.size(distinct) > 2, F.slice(distinct, 2, F.size(distinct) - 2)).otherwise(
        F.array().cast("array<double>")
    )


def bin_index(value: Column, cuts: Column) -> Column:
    """Number of inner edges at or below the value: 0 is the lowest bin."""
    return F.size(F.filter(cuts, lambda c: c <= value))
