"""State panels: gap-filled calendars, horizon changes, peaks, growth and fixed scenarios.

Series hold one row per state and calendar period, so each window partition is bounded by the
calendar, whatever the size of the loan table. Frames are frames of *values* (period indices),
never of rows: a missing month must not pull in its neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MACRO, Protocol


def gap_filled(series: DataFrame, key: str = "state", period: str = "month") -> DataFrame:
    """Every period between a state's first and last; periods without data become NULL rows."""
    span = series.groupBy(key).agg(F.min(period).alias("_a"), F.max(period).alias("_b"))
    calendar = span.select(key, F.explode(F.sequence("_a", "_b")).alias(period))
    return calendar.join(series, [key, period], "left")


def _span(key: str, period: str, low: int, high: int):
    return Window.partitionBy(key).orderBy(period).rangeBetween(low, high)


def horizon_change(series: DataFrame, value: str, horizon: int, name: str, key: str = "state", period: str = "month") -> DataFrame:
    """``value[m + horizon] - value[m]``, NULL when either is missing."""
    ahead = F.first(value).over(_span(key, period, horizon, horizon))
    return series.withColumn(name, ahead - F.col(value))


def path_peak(series: DataFrame, value: str, horizon: int, name: str, key: str = "state", period: str = "month") -> DataFrame:
    """Highest level on the whole path minus the level now; NULL unless every step of the path exists."""
    path = _span(key, period, 0, horizon)
    whole = F.count(value).over(path) == horizon + 1
    return series.withColumn(name, F.when(whole, F.max(value).over(path) - F.col(value)))


def log_growth(later: Column, earlier: Column) -> Column:
    return 100 * F.ln(F.try_divide(later, earlier))


def quarterly_growth(hpi: DataFrame, protocol: Protocol) -> DataFrame:
    """Per state and quarter: annual growth ``h0``, growth over the horizon ``dh``, and completeness.

    A quarter without data has no row; months that fall in it find no match.
    """
    steps = protocol.horizon_quarters
    base = F.first("hpi").over(_span("state", "quarter", -4, -4))
    end = F.first("hpi").over(_span("state", "quarter", steps, steps))
    positive = F.when(F.col("hpi") > 0, 1)
    complete = (F.count(positive).over(_span("state", "quarter", 0, steps)) == steps + 1) & (
        F.count(positive).over(_span("state", "quarter", -4, -4)) == 1
    )
    return hpi.select(
        "state", "quarter", log_growth(F.col("hpi"), base).alias("h0"), log_growth(end, F.col("hpi")).alias("dh"),
        complete.alias("macro_complete"),
    )


def macro_panel(unemployment: DataFrame, hpi: DataFrame, protocol: Protocol) -> DataFrame:
    """One row per state and origin month: ``u0, du, peak_du, h0, dh, macro_complete``."""
    months = gap_filled(unemployment)
    months = horizon_change(months, "u", protocol.horizon_months, "du")
    months = path_peak(months, "u", protocol.horizon_months, "peak_du")
    growth = quarterly_growth(hpi, protocol)
    joined = months.withColumn("quarter", F.expr("month div 3")).join(growth, ["state", "quarter"], "left")
    return joined.select(
        F.col("state").alias("ProjectState"), "month", F.col("u").alias("u0"), "du", "peak_du", "h0", "dh",
        F.coalesce("macro_complete", F.lit(False)).alias("macro_complete"),
    )


def scenario_paths(unemployment: DataFrame, hpi: DataFrame, protocol: Protocol) -> DataFrame:
    """Two fixed rows per state: mean recent conditions, and the dated stress path.

    A missing input month leaves NULL in the row; :func:`complete_scenarios` refuses such a table.
    """
    first = protocol.baseline_first_year
    last = first + protocol.baseline_years
    start, horizon = protocol.adverse_month, protocol.horizon_months
    path = F.col("month").between(start, start + horizon)

    def level(month: int) -> Column:
        return F.max(F.when(F.col("month") == month, F.col("u")))

    monthly = unemployment.groupBy("state").agg(
        F.avg(F.when(F.col("month").between(first * 12, last * 12 - 1), F.col("u"))).alias("base_u"),
        level(start).alias("from_u"), level(start + horizon).alias("to_u"),
        F.max(F.when(path, F.col("u"))).alias("top_u"), F.count(F.when(path, F.col("u"))).alias("path_n"),
    )
    q0, steps = start // 3, protocol.horizon_quarters
    annual = quarterly_growth(hpi, protocol).groupBy("state").agg(
        F.avg(F.when(F.col("quarter").between(first * 4, last * 4 - 1), F.col("h0"))).alias("base_h"),
        F.max(F.when(F.col("quarter") == q0, F.col("h0"))).alias("start_h"),
        F.max(F.when(F.col("quarter") == q0, F.col("dh"))).alias("path_h"),
    )
    wide = monthly.join(annual, "state")
    zero = F.lit(0.0)
    rows = F.array(
        F.struct(F.lit("baseline").alias("scenario"), F.col("base_u").alias("u0"), zero.alias("du"), zero.alias("peak_du"),
                 F.col("base_h").alias("h0"), (F.col("base_h") * (steps / 4)).alias("dh")),
        F.struct(F.lit("adverse").alias("scenario"), F.col("from_u").alias("u0"), (F.col("to_u") - F.col("from_u")).alias("du"),
                 F.when(F.col("path_n") == horizon + 1, F.col("top_u") - F.col("from_u")).alias("peak_du"),
                 F.col("start_h").alias("h0"), F.col("path_h").alias("dh")),
    )
    return wide.select(F.col("state").alias("ProjectState"), F.explode(rows).alias("_r")).select("ProjectState", "_r.*")


def complete_scenarios(scenarios: DataFrame) -> DataFrame:
    """The same table, failing the job if any value is missing."""
    gap = F.lit(False)
    for c in (*MACRO, "peak_du"):
        gap = gap | F.col(c).isNull()
    guarded = F.when(gap, F.raise_error(F.concat(F.lit("incomplete scenario for "), F.col("ProjectState")))).otherwise(F.col("u0"))
    return scenarios.withColumn("u0", guarded)


def series_coverage(series: DataFrame, key: str, period: str, expected_states: int) -> DataFrame:
    """Per series: cells, distinct periods, duplicates, span and gaps; plus whether all states are there."""
    per = series.groupBy(key).agg(
        F.count("*").alias("cells"), F.count_distinct(period).alias("periods"),
        F.min(period).alias("first_period"), F.max(period).alias("last_period"),
    )
    states = per.agg(F.count("*").alias("n"))
    return per.select(
        "*", (F.col("cells") - F.col("periods")).alias("duplicates"),
        (F.col("last_period") - F.col("first_period") + 1 - F.col("periods")).cast("long").alias("gaps"),
    ).withColumn("all_states_present", states.scalar() == expected_states)


def origin_month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1
