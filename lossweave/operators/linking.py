"""Joins of loans with panels, scenarios, earlier sources and other result sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MACRO
from ..session import lookup_join
from .panel import origin_month


def attach_panel(loans: DataFrame, panel: DataFrame) -> DataFrame:
    """Many-to-one left join on state and origin month; unmatched loans keep NULLs."""
    keyed = loans.withColumn("month", origin_month(F.col("d")))
    joined = lookup_join(keyed, panel, ["ProjectState", "month"])
    return joined.withColumn("macro_complete", F.coalesce("macro_complete", F.lit(False)))


def apply_scenarios(portfolio: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Replaces observed macro columns by each scenario's values.

    All scenarios of a state arrive as one lookup row, so the portfolio is read and joined once
    and every loan keeps its identity in every scenario. A loan whose state lacks a scenario, or
    has one twice, fails the job.
    """
    values = [c for c in scenarios.columns if c != "ProjectState"]
    names = sorted(r.scenario for r in scenarios.select("scenario").distinct().collect())
    each = F.array_sort(F.transform("_s", lambda s: s["scenario"])) == F.array(*[F.lit(n) for n in names])
    by_state = scenarios.groupBy("ProjectState").agg(F.sort_array(F.collect_list(F.struct(*values))).alias("_s")).where(each)
    bare = portfolio.drop(*[c for c in values if c in portfolio.columns])
    joined = lookup_join(bare, by_state, ["ProjectState"])
    state = F.coalesce(F.col("ProjectState").cast("string"), F.lit("NULL"))
    found = F.when(F.col("_s").isNotNull(), F.col("_s")).otherwise(F.raise_error(F.concat(F.lit("not every scenario covers state "), state)))
    return joined.withColumn("_s", F.explode(found)).select("*", "_s.*").drop("_s")


def complete_cases(matched: DataFrame, columns: Sequence[str] = MACRO) -> DataFrame:
    return matched.na.drop(subset=list(columns)).where("macro_complete")


def attach_source_text(loans: DataFrame, raw: DataFrame, column: str, name: str, key: str = "row_id") -> DataFrame:
    """Recovers the unparsed text of a column by row id; a loan without source row fails the job."""
    source = raw.select(key, F.col(column).alias(name), F.lit(True).alias("_found"))
    joined = loans.join(source, key, "left")
    checked = F.when(F.col("_found"), F.col(name)).otherwise(F.raise_error(F.concat(F.lit("no source row for "), F.col(key))))
    return joined.withColumn(name, checked).drop("_found")


def frozen_selection(current: DataFrame, frozen: DataFrame, key: str = "row_id") -> DataFrame:
    return current.join(frozen.select(key), key, "left_semi")


def append_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds only rows whose key is absent; existing rows are never overwritten."""
    fresh = new.join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh)


def unchanged_rows(old: DataFrame, result: DataFrame) -> DataFrame:
    """Old rows that are missing or altered in the result; must be empty."""
    return old.exceptAll(result.select(*old.columns))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def key_set_difference(point: DataFrame, draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only, with the side that lacks them."""
    left = point.select(*keys).distinct().withColumn("_p", F.lit(True))
    right = draws.select(*keys).distinct().withColumn("_d", F.lit(True))
    both = left.join(right, list(keys), "full_outer")
    return both.where("_p is null or _d is null").select(
        *keys, F.when(F.col("_p").isNull(), "point").otherwise("draws").alias("missing_in")
    )


def paired_difference(results: DataFrame, side: str, left: str, right: str, keys: Sequence[str], value: str = "value") -> DataFrame:
    """``left - right`` of one column over shared keys, in a single aggregate instead of a self-join."""
    picked = results.where(F.col(side).isin(left, right)).groupBy(*keys).agg(
        F.max(F.when(F.col(side) == left, F.col(value))).alias("left_value"),
        F.max(F.when(F.col(side) == right, F.col(value))).alias("right_value"),
        F.count("*").alias("_n"),
    )
    return picked.where("_n = 2").select(*keys, (F.col("left_value") - F.col("right_value")).alias("difference"))


def select_where(df: DataFrame, **values) -> DataFrame:
    """Conjunction of equalities, in the order given."""
    for name, value in values.items():
        df = df.where(F.col(name) == value)
    return df


def select_one(df: DataFrame, **values):
    """The one row that matches, or an error."""
    found = select_where(df, **values).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"expected one row, found {'none' if not found else 'several'}: {values}")
    return found[0]


def fit_purity(fits: dict[str, DataFrame], requested: dict[str, Sequence[str]], allowed: Sequence[str]) -> DataFrame:
    """Per fitted artefact: rows by role, rows outside training, requested columns that are not allowed."""
    reports = []
    for name, rows in fits.items():
        odd = sorted(set(requested[name]) - set(allowed))
        reports.append(rows.groupBy("role").agg(F.count("*").alias("n")).select(
            F.lit(name).alias("artefact"), "role", "n",
            F.when(F.col("role") == "train", F.lit(0).cast("long")).otherwise(F.col("n")).alias("outside_train"),
            F.lit(",".join(odd)).alias("not_allowed"),
        ))
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out


def require_pure(report: DataFrame) -> None:
    bad = report.where((F.col("outside_train") > 0) | (F.col("not_allowed") != "")).limit(1).collect()
    if bad:
        raise ValueError(f"fit set is not pure: {bad[0].asDict()}")
