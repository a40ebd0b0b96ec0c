"""Audit of recorded loan terms against elapsed time to the closing event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import count_where, holds, strip, to_number
from ..functions.shapes import stacked
from ..session import staged
from .linking import attach_source_text
from .ordered import exact_quantiles

# Audit thresholds and the reported percentiles.
DAYS_PER_MONTH = 365.25 / 12
TOLERANCE_MONTHS = 3
EVIDENCE_MINIMUM = 100
EVIDENCE_SHARE = 0.5
UPDATED = "Strong evidence of later updating."
UNVERIFIABLE = "Timing unverifiable."
VERIFIED = "Verified as an approval-time value."
PERCENTILES = {"min": 0.0, "p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "max": 1.0}

SUMMARISED = ("approval_year", "loan_type", "LoanStatus", "difference_months", "date_status", "term_status", "valid", "match", "after_window")


def _status(missing: Column, valid: Column) -> Column:
    return F.when(missing, "missing").when(holds(valid), "valid").otherwise("invalid")


def timing_rows(loans: DataFrame, raw: DataFrame) -> DataFrame:
    """One row per closed loan; the source text tells a missing term from an unreadable one."""
    closed = loans.where(F.col("LoanStatus").isin("CHGOFF", "PIF")).select(
        "row_id", "LoanStatus", "loan_type", "d", "w", F.year("ApprovalDate").alias("approval_year"),
        F.when(F.col("LoanStatus") == "CHGOFF", F.col("ChargeOffDate")).otherwise(F.col("PaidInFullDate")).alias("event_date"),
    )
    rows = attach_source_text(closed, raw, "TermInMonths", "term_text")
    text = strip(F.col("term_text"))
    event, day = F.col("event_date"), F.col("d")
    return (
        rows.withColumn("raw_term", to_number(text))
        .withColumn("elapsed_months", F.datediff(event, day) / F.lit(DAYS_PER_MONTH))
        .withColumn("difference_months", F.col("raw_term") - F.col("elapsed_months"))
        .withColumn("date_status", _status(event.isNull() | day.isNull(), event >= day))
        .withColumn("term_status", _status(text == "", F.col("raw_term") > 0))
        .withColumn("valid", (F.col("date_status") == "valid") & (F.col("term_status") == "valid"))
        .withColumn("match", F.col("valid") & holds(F.abs("difference_months") <= TOLERANCE_MONTHS))
        .withColumn("after_window", holds((F.col("LoanStatus") == "CHGOFF") & (event > F.col("w"))))
    )


def _scopes(rows: DataFrame) -> DataFrame:
    fine = F.concat_ws("|", F.coalesce(F.col("approval_year").cast("string"), F.lit("<NA>")), "loan_type", "LoanStatus")
    scopes = [("overall", "all"), ("status", F.col("LoanStatus")), ("approval_year_loan_type_status", fine)]
    return stacked(rows, rows.columns, ["scope", "group_key"], scopes)


def verdict(charge_valid: Column, charge_match: Column, verified: bool = False) -> Column:
    """A low share of matches never proves approval-time measurement; only metadata can."""
    if verified:
        return F.lit(VERIFIED)
    strong = (charge_valid >= EVIDENCE_MINIMUM) & (charge_match >= EVIDENCE_SHARE * charge_valid)
    return F.when(strong, UPDATED).otherwise(UNVERIFIABLE)


def timing_counts(rows: DataFrame, verified: bool = False) -> DataFrame:
    """Counters, mean, sample deviation and verdict for three nested scopes in one aggregate."""
    date, term, valid = F.col("date_status"), F.col("term_status"), F.col("valid")
    charge = F.col("LoanStatus") == "CHGOFF"
    gap = F.when(valid, F.col("difference_months"))
    wide = _scopes(rows).groupBy("scope", "group_key").agg(
        F.count("*").alias("n"), F.count_if(valid).alias("valid_n"),
        F.count_if(date == "valid").alias("date_valid_n"), F.count_if(term == "valid").alias("term_valid_n"),
        F.count_if(date == "missing").alias("date_missing_n"), F.count_if(date == "invalid").alias("date_invalid_n"),
        F.count_if(term == "missing").alias("term_missing_n"), F.count_if(term == "invalid").alias("term_invalid_n"),
        F.count_if((date == "missing") | (term == "missing")).alias("missing_either_n"),
        F.count_if((date == "invalid") | (term == "invalid")).alias("invalid_either_n"),
        F.count_if("match").alias("match_n"), F.count_if("after_window").alias("after_window_n"),
        F.avg(gap).alias("difference_mean"), F.stddev_samp(gap).alias("difference_sd"),
        count_where(charge & valid).alias("_cv"), count_where(charge & F.col("match")).alias("_cm"),
    )
    return wide.withColumn("match_share", F.try_divide("match_n", "valid_n")).withColumn(
        "verdict", verdict(F.col("_cv"), F.col("_cm"), verified)
    ).drop("_cv", "_cm")


def timing_summary(rows: DataFrame, verified: bool = False) -> DataFrame:
    """The counts with nine exact percentiles of the difference. Rows are landed once, both parts read the columns they need."""
    rows = staged(rows.select(*SUMMARISED))
    scoped = _scopes(rows.where("valid").select("approval_year", "loan_type", "LoanStatus", "difference_months"))
    quantiles = exact_quantiles(scoped, "difference_months", list(PERCENTILES.values()), by=["scope", "group_key"])
    named = [F.get("quantiles", F.lit(i)).alias(f"difference_{n}") for i, n in enumerate(PERCENTILES)]
    return timing_counts(rows, verified).join(quantiles.select("scope", "group_key", *named), ["scope", "group_key"], "left")
