"""Summaries that set results side by side: calibration means, ranges, attempts, intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shapes import stacked
from ..sources.files import finite_or_null
from .linking import duplicate_keys, key_set_difference


def calibration_means(scored: DataFrame, keys: Sequence[str | Column], score: str = "p") -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("Y").alias("events"), F.avg(score).alias("mean_predicted"),
        F.avg("Y").alias("recorded_rate"), F.min("d").alias("start_d"), F.max("d").alias("end_d"),
    )


def weighted_comparison(earlier: DataFrame, later: DataFrame, keys: Sequence[str], weight: str, values: Sequence[str]) -> DataFrame:
    """Weighted means of two result sets over their shared keys, one row per value column."""
    names = [weight, *values]
    left = earlier.select(*keys, *[F.col(c).alias(f"_l_{c}") for c in names])
    right = later.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in names])
    wide = left.join(right, list(keys)).agg(F.count("*").alias("cells"), *[
        (F.sum(F.col(f"{s}{v}") * F.col(f"{s}{weight}")) / F.sum(f"{s}{weight}")).alias(f"{s}{v}") for v in values for s in ("_l_", "_r_")
    ])
    rows = [(v, F.col(f"_l_{v}"), F.col(f"_r_{v}")) for v in values]
    return stacked(wide, ["cells"], ["comparison", "earlier", "later"], rows)


def attempt_summary(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attempted, successful, failed, and a map from failure message to count; a failure without a message counts under the empty one."""
    fine = attempts.withColumn("message", F.coalesce("message", F.lit("")))
    fine = fine.groupBy(*keys, "message").agg(F.count("*").alias("_n"), F.count_if("successful").alias("_ok"))
    failed = F.when(F.col("_n") > F.col("_ok"), F.struct("message", (F.col("_n") - F.col("_ok")).alias("n")))
    return fine.groupBy(*keys).agg(
        F.sum("_n").alias("attempted"), F.sum("_ok").alias("successful"), F.sum(F.col("_n") - F.col("_ok")).alias("failed"),
        F.map_from_entries(F.collect_list(failed)).alias("failures"),
    )


def ranges(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    parts = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*keys).agg(*parts)


def percentile_interval(draws: DataFrame, keys: Sequence[str], value: str = "value", level: float = 0.95) -> DataFrame:
    """Linear percentile interval over the finite draws of each key; needs at least two.

    A key holds one value per scheduled draw, so ``percentile`` sees a bounded group.
    """
    tail = (1 - level) / 2
    finite = finite_or_null(F.col(value))
    bounds = F.percentile(finite, F.array(F.lit(tail), F.lit(1 - tail)))
    wide = draws.groupBy(*keys).agg(F.count(finite).alias("effective_draws"), bounds.alias("_b"), F.count("*").alias("draws"))
    enough = F.col("effective_draws") >= 2
    return wide.select(
        *keys, F.when(enough, F.get("_b", F.lit(0))).alias("lower"), F.when(enough, F.get("_b", F.lit(1))).alias("upper"),
        "effective_draws", (F.col("draws") - F.col("effective_draws")).alias("undefined_draws"),
    )


def combine(point: DataFrame, draws: DataFrame, keys: Sequence[str], attempted: int, draw: str = "draw") -> DataFrame:
    """Point values with intervals; repeated keys or keys that some draw lacks fail the job."""
    keys = list(keys)
    if duplicate_keys(point, keys).limit(1).collect() or duplicate_keys(draws, [*keys, draw]).limit(1).collect():
        raise ValueError(f"{keys} do not tell all point values, or all values of a draw, apart")
    if key_set_difference(point, draws, keys).limit(1).collect():
        raise ValueError("some keys have only a point value or only draws")
    successful = draws.select(draw).distinct().count()
    uneven = draws.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") != successful)
    if uneven.limit(1).collect():
        raise ValueError("a statistic is missing from some draws")
    interval = percentile_interval(draws, keys)
    return point.join(interval, keys).withColumns(
        {"attempted_draws": F.lit(attempted), "successful_draws": F.lit(successful)}
    )
