"""Source profile: value counts, year histograms, date ranges and quality counters per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DATE_SOURCE, LEGAL_STATUS, Protocol
from ..functions.cleaning import CANCELLED, holds, to_day, to_number
from ..functions.shapes import stacked


def quality_counters(protocol: Protocol) -> dict[str, Column]:
    """Number of faults per row, to be summed; expects stripped text columns plus parsed ``_<date>`` columns."""
    cutoff = F.lit(protocol.snapshot).cast("date")
    status = F.col("LoanStatus")
    day, approved = F.col("_FirstDisbursementDate"), F.col("_ApprovalDate")
    charge, paid = F.col("_ChargeOffDate"), F.col("_PaidInFullDate")
    gross, backed, loss = (to_number(F.col(c)) for c in ("GrossApproval", "SBAGuaranteedApproval", "GrossChargeOffAmount"))
    one = {f"invalid_nonblank_{c}": (F.col(c) != "") & F.col(f"_{c}").isNull() for c in DATE_SOURCE}
    one |= {
        "incomplete_window": F.add_months(day, protocol.horizon_months) > cutoff,
        "cancelled_or_undisbursed": status.isin(*CANCELLED),
        "noncancelled_with_missing_first_disbursement": ~status.isin(*CANCELLED) & day.isNull(),
        "chargeoff_status_missing_date": (status == "CHGOFF") & charge.isNull(),
        "chargeoff_date_before_first_disbursement": charge < day,
        "first_disbursement_before_approval": day < approved,
        "nonchargeoff_status_with_chargeoff_date": (status != "CHGOFF") & charge.isNotNull(),
        "non_pif_status_with_payoff_date": (status != "PIF") & paid.isNotNull(),
        "payoff_date_before_first_disbursement": paid < day,
        "unknown_status": ~status.isin(*LEGAL_STATUS),
        "invalid_or_nonpositive_gross_approval": gross.isNull() | (gross <= 0),
        "guarantee_exceeds_gross_approval": backed > gross,
        "chargeoff_amount_exceeds_gross_approval": loss > gross,
    }
    counters = {n: holds(c).cast("long") for n, c in one.items()}
    counters["dates_after_snapshot"] = sum(
        (holds(F.col(f"_{c}") > cutoff).cast("long") for c in DATE_SOURCE[1:]), holds(approved > cutoff).cast("long")
    )
    return counters


def source_profile(text: DataFrame, protocol: Protocol) -> DataFrame:
    """Long ``(source_file, section, item, value)``; counts are written as text next to dates.

    All histograms share one shuffle of (file, section, item) with map-side counts; counters and
    ranges share one aggregate by file.
    """
    parsed = text.withColumns({f"_{c}": to_day(F.col(c)) for c in DATE_SOURCE})
    cutoff = F.lit(protocol.snapshot).cast("date")
    late = F.add_months("_FirstDisbursementDate", protocol.horizon_months) > cutoff
    histograms = {
        "status": F.col("LoanStatus"), "program": F.col("Program"), "business_age": F.col("BusinessAge"),
        "revolver": F.col("RevolverStatus"), "approval_year": F.year("_ApprovalDate").cast("string"),
        "disbursement_year": F.year("_FirstDisbursementDate").cast("string"),
        "incomplete_window_year": F.when(late, F.year("_FirstDisbursementDate").cast("string")),
    }
    histograms |= {
        f"missing_{c}": F.when(F.col(f"_{c}").isNull(), F.col("LoanStatus")) for c in DATE_SOURCE
    }
    entries = [F.when(c.isNotNull(), F.struct(F.lit(s).alias("section"), c.alias("item"))) for s, c in histograms.items()]
    rows = parsed.select("source_file", F.explode(F.array_compact(F.array(*entries))).alias("_e"))
    counts = rows.groupBy("source_file", "_e").agg(F.count("*").alias("n")).select(
        "source_file", "_e.section", "_e.item", F.col("n").cast("string").alias("value")
    )
    quality = quality_counters(protocol)
    wide = parsed.groupBy("source_file").agg(
        F.count("*").alias("rows"), *[F.sum(c).alias(n) for n, c in quality.items()],
        *[F.min(f"_{c}").alias(f"first_{c}") for c in DATE_SOURCE], *[F.max(f"_{c}").alias(f"last_{c}") for c in DATE_SOURCE],
    )
    cells = [("rows", "all", F.col("rows").cast("string"))]
    cells += [("quality", n, F.col(n).cast("string")) for n in quality]
    cells += [(f"{end}_date", c, F.col(f"{end}_{c}").cast("string")) for end in ("first", "last") for c in DATE_SOURCE]
    facts = stacked(wide, ["source_file"], ["section", "item", "value"], cells)
    return counts.unionByName(facts.where("value is not null"))


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per stored table."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = row if out is None else out.unionByName(row)
    return out


