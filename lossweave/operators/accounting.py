"""Row accounting: overlapping flags, sequential waterfalls, cohorts and their counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Protocol
from ..functions.cleaning import count_where, first_reason, holds, within
from ..functions.shapes import stacked

TOTAL = "__total__"


def flag_counts(df: DataFrame, flags: dict[str, Column], by: str) -> DataFrame:
    """``(by, flag, n)``: each flag is counted on its own; flags with no rows stay."""
    wide = df.groupBy(by).agg(*[count_where(f).alias(n) for n, f in flags.items()])
    return stacked(wide, [by], ["flag", "n"], [(n, F.col(n)) for n in flags])


def exclusion_waterfall(df: DataFrame, flags: dict[str, Column], by: str) -> DataFrame:
    """``(by, step, excluded, remaining)`` per source and in total.

    One aggregate: a row counts for the first flag that claims it. Steps without rows appear with
    zero because the step list, not the data, spans the output.
    """
    reason = df.select(by, first_reason(flags).alias("_reason"))
    per_source = reason.groupBy(by).agg(
        F.count("*").alias("_all"), *[count_where(F.col("_reason") == n).alias(n) for n in flags]
    )
    total = per_source.groupBy(F.lit(TOTAL).alias(by)).agg(*[F.sum(c).alias(c) for c in ["_all", *flags]])
    both = per_source.unionByName(total)
    left = F.col("_all")
    rows = [("all_source_rows", F.lit(0).cast("long"), left)]
    for name in flags:
        left = left - F.col(name)
        rows.append((name, F.col(name), left))
    return stacked(both, [by], ["step", "excluded", "remaining"], rows)


def cohort_membership(df: DataFrame, protocol: Protocol, day: str = "d") -> DataFrame:
    """One row per loan and cohort that contains it; ranges overlap.

    The cohort list is configuration of fixed length, so membership is an exploded array
    expression: no join at all, and a loan in no cohort emits nothing.
    """
    entries = [
        F.when(holds(within(F.col(day), c)), F.struct(F.lit(c.layer).alias("layer"), F.lit(c.name).alias("cohort")))
        for c in protocol.cohorts
    ]
    return df.withColumn("_c", F.explode(F.array_compact(F.array(*entries)))).select("*", "_c.*").drop("_c")


def cohort_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("Y").alias("events"))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("role").agg(
        F.count("*").alias("n"), F.sum("Y").alias("events"), F.min("d").alias("earliest_d"),
        F.max("d").alias("latest_d"), F.max("w").alias("latest_window"),
    )


def missing_by(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``(keys, feature, n, missing, missing_share)`` from one aggregate."""
    wide = df.groupBy(*keys).agg(F.count("*").alias("n"), *[count_where(F.col(c).isNull()).alias(c) for c in features])
    share = {c: F.col(c) / F.col("n") for c in features}
    return stacked(wide, keys, ["feature", "n", "missing", "missing_share"], [(c, F.col("n"), F.col(c), share[c]) for c in features])


def sample_waterfall(df: DataFrame, protocol: Protocol, matched: Column) -> DataFrame:
    """Final sample per overlapping cohort: eligible, matched, events and date extremes."""
    ok = holds(matched)
    return cohort_membership(df, protocol).groupBy("layer", "cohort").agg(
        F.count("*").alias("eligible_n"), F.count_if(ok).alias("n"), F.count_if(~ok).alias("macro_excluded_n"),
        F.coalesce(F.sum(F.when(ok, F.col("Y"))), F.lit(0)).alias("events"),
        F.min(F.when(ok, F.col("d"))).alias("earliest_d"), F.max(F.when(ok, F.col("d"))).alias("latest_d"),
    )


def duplicate_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that share their full key with another row. Nothing is removed: equal fields prove no identity."""
    groups = df.groupBy(*key).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.sum("_n").alias("eligible_rows"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("indistinguishable_rows"),
    )


def level_outcomes(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, level, n, events, non_events)`` for every category level."""
    rows = stacked(df, ["Y"], ["feature", "level"], [(c, F.col(c)) for c in features])
    return rows.groupBy("feature", "level").agg(
        F.count("*").alias("n"), F.sum("Y").alias("events"), F.sum(1 - F.col("Y")).alias("non_events")
    )


def separation_witnesses(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Levels whose outcomes are all 0 or all 1."""
    return level_outcomes(df, features).where((F.col("events") == 0) | (F.col("non_events") == 0))


def value_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(field, value, n)`` over several columns in one shuffle."""
    rows = stacked(df, [], ["field", "value"], [(c, F.col(c).cast("string")) for c in fields])
    return rows.groupBy("field", "value").agg(F.count("*").alias("n"))


def named_counts(df: DataFrame, conditions: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, check, n)``: every condition counted in the same pass."""
    wide = df.groupBy(*keys).agg(*[count_where(c).alias(n) for n, c in conditions.items()])
    return stacked(wide, keys, ["check", "n"], [(n, F.col(n)) for n in conditions])


def integrity_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(check, passed, violations)``; a rule that evaluates to NULL counts as violated."""
    return named_counts(df, {n: ~holds(r) for n, r in rules.items()}).select(
        "check", (F.col("n") == 0).alias("passed"), F.col("n").alias("violations")
    )
