"""Column expressions that turn snapshot text into typed, labelled, banded loans.

SQL comparisons with NULL are NULL, while a missing value must never raise a flag: every
predicate is closed with :func:`holds`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    CATEGORICAL, DATE_SOURCE, LEGAL_STATUS, MISSING, NUMERIC_SOURCE, DateRange, Protocol,
)

# Codes and label texts of the loan snapshot.
CANCELLED = ("CANCLD", "COMMIT")
REVOLVER = {"N": "term", "0": "term", "Y": "revolving", "1": "revolving"}
NO_FRANCHISE = ("00000", "000000")
WHITESPACE = " \t\n\r\f\v\u0085\u00a0\u2028\u2029\u3000"
GAPS = " \t\n\v\f\r"
NEW_BUSINESS = ("startup", "new business", "new, less", "2 or less")


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, [holds(c) for c in conditions])


def count_where(condition: Column) -> Column:
    return F.count_if(holds(condition))


def strip(column: Column) -> Column:
    """Trims white space at both ends. Spaces go first; if visible ASCII is then at both ends, nothing is left to
    trim, and only the rest is trimmed character by character. Few comparisons keep the pass in compiled methods."""
    text = F.trim(column)
    last = F.substring(text, -1, 1)
    bare = (text == "") | ((text >= "!") & (text < "\x7f") & (last >= "!") & (last < "\x7f"))
    return F.when(bare, text).otherwise(F.btrim(F.coalesce(column, F.lit("")), F.lit(WHITESPACE)))


def normalized(df: DataFrame, upper: bool = False) -> DataFrame:
    """Strips every text column and closes the gaps inside the status; the profiler also upper-cases."""
    text = {n: strip(F.col(n)) for n, t in df.dtypes if t == "string"}
    if upper:
        text = {n: F.upper(c) for n, c in text.items()}
    if "LoanStatus" in text:
        text["LoanStatus"] = F.translate(text["LoanStatus"], GAPS, "")
    return df.withColumns(text)


def to_number(column: Column) -> Column:
    number = F.nullif(column, F.lit("")).try_cast("double")
    return F.nullif(number, F.lit(float("nan")))


def to_day(column: Column) -> Column:
    """Ten characters ``yyyy-mm-dd``. The cast checks the digits; it also reads longer years, days of one digit and what
    follows a day, so both hyphens and a digit at the end must stand in their places."""
    last = F.substring(column, 10, 1)
    iso = (F.octet_length(column) == 10) & (F.locate("-", column) == 5) & (F.locate("-", column, 6) == 8) & (last >= "0") & (last <= "9")
    return F.when(iso, column.try_cast("date"))


def four_digit_year(day: Column) -> Column:
    """Days whose text is ``yyyy-mm-dd``; the text of others is not read as a day."""
    return F.when((day >= F.lit("0000-01-01").cast("date")) & (day <= F.lit("9999-12-31").cast("date")), day)


def typed(df: DataFrame, protocol: Protocol) -> DataFrame:
    """Casts that never fail, the marker for non-blank unreadable dates, origin ``d`` and window end ``w``.

    Text is read; dates and numbers of a source that has them pass as what their text would be read as.
    """
    types = dict(df.dtypes)
    is_text = {c: types[c] == "string" for c in DATE_SOURCE + NUMERIC_SOURCE}
    days = df.withColumns({f"_{c}": to_day(F.col(c)) if is_text[c] else four_digit_year(F.col(c)) for c in DATE_SOURCE})
    bad = any_of(*[(F.col(c) != "" if is_text[c] else F.col(c).isNotNull()) & F.col(f"_{c}").isNull() for c in DATE_SOURCE])
    numbers = {c: to_number(F.col(c)) if is_text[c] else F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in NUMERIC_SOURCE}
    casts = numbers | {c: F.col(f"_{c}") for c in DATE_SOURCE}
    dated = days.withColumn("invalid_date", bad).withColumns(casts).drop(*[f"_{c}" for c in DATE_SOURCE])
    return dated.withColumn("d", F.col("FirstDisbursementDate")).withColumn(
        "w", F.add_months("d", protocol.horizon_months)
    )


def exclusion_flags(protocol: Protocol) -> dict[str, Column]:
    """The eight predicates in the order in which they claim a row."""
    cutoff = F.lit(protocol.snapshot).cast("date")
    status, day = F.col("LoanStatus"), F.col("d")
    charge, paid = F.col("ChargeOffDate"), F.col("PaidInFullDate")
    flags = {
        "wrong_program": F.col("Program") != protocol.program,
        "cancelled_or_committed": status.isin(*CANCELLED),
        "unknown_status": ~status.isin(*LEGAL_STATUS),
        "missing_disbursement": day.isNull(),
        "incomplete_window": F.col("w") > cutoff,
        "invalid_approval_amount": F.col("GrossApproval").isNull() | (F.col("GrossApproval") <= 0),
        "unmapped_state": ~F.col("ProjectState").isin(*protocol.states),
        "date_or_status_contradiction": any_of(
            F.col("invalid_date"),
            day < F.col("ApprovalDate"), charge < day, paid < day,
            *[F.col(c) > cutoff for c in DATE_SOURCE],
            (status == "CHGOFF") & charge.isNull(),
            (status != "CHGOFF") & charge.isNotNull(),
            (status != "PIF") & paid.isNotNull(),
        ),
    }
    return {name: holds(flag) for name, flag in flags.items()}


def first_reason(flags: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(flag, F.lit(name)) for name, flag in flags.items()])


def event_label() -> Column:
    """1 iff the event falls in the closed window from origin to window end."""
    return holds(F.col("ChargeOffDate").between(F.col("d"), F.col("w"))).cast("int")


def within(day: Column, span: DateRange) -> Column:
    return day.between(F.lit(span.start).cast("date"), F.lit(span.end).cast("date"))


def role(day: Column, protocol: Protocol) -> Column:
    return F.coalesce(
        *[F.when(within(day, r), F.lit(r.name)) for r in protocol.roles], F.lit(protocol.outside_role)
    )


def guarantee_share() -> Column:
    ratio = F.try_divide(F.col("SBAGuaranteedApproval"), F.col("GrossApproval"))
    return F.when(ratio.between(0, 1), ratio)


def not_negative(column: Column) -> Column:
    return F.when(column >= 0, column)


def whole_code(column: Column) -> Column:
    """A code without the ``.0`` that a spreadsheet left behind it."""
    return F.when(column.endswith(".0"), F.substring(column, F.lit(1), F.length(column) - 2)).otherwise(column)


def industry_sector(column: Column) -> Column:
    code = whole_code(column)
    return F.when(code.rlike("^[0-9]{6}$"), F.substring(code, 1, 2)).otherwise("")


def revolver_kind(column: Column) -> Column:
    hits = [F.when(column == code, F.lit(kind)) for code, kind in REVOLVER.items()]
    return F.coalesce(*hits, F.lit("unknown"))


def franchise_kind(column: Column) -> Column:
    code = whole_code(column)
    return F.when(code == "", "missing").when(code.isin(*NO_FRANCHISE), "absent").otherwise("present")


def size_band(amount: Column, protocol: Protocol) -> Column:
    bands = [F.when(amount <= cut, label) for cut, label in zip(protocol.size_cuts, protocol.size_labels)]
    return F.coalesce(*bands, F.when(amount.isNotNull(), protocol.size_labels[-1]))


def age_group(column: Column) -> Column:
    text = F.lower(column)
    return (
        F.when(text.contains("change of ownership"), "change_of_ownership")
        .when(text == "", "missing")
        .when(text.contains("unanswered"), "unanswered")
        .when(any_of(*[text.contains(words) for words in NEW_BUSINESS]), "new")
        .otherwise("existing")
    )


def maturity_group(months: Column, protocol: Protocol) -> Column:
    limit = protocol.long_maturity_months
    return F.when(months.isNull(), "missing").when(months >= limit, f">={limit}_months").otherwise(f"<{limit}_months")


def missing_token(column: Column) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(MISSING))


def featured(df: DataFrame, protocol: Protocol) -> DataFrame:
    """Derived predictors, bands, year and role of typed loans."""
    clean = df.withColumns({c: not_negative(F.col(c)) for c in ("InitialInterestRate", "TermInMonths", "JobsSupported")})
    out = clean.withColumns({
        "year": F.year("d"),
        "role": role(F.col("d"), protocol),
        "log_approval": F.ln("GrossApproval"),
        "guarantee_share": guarantee_share(),
        "log_jobs": F.log1p("JobsSupported"),
        "year_trend": F.year("d") - protocol.trend_origin_year,
        "naics2": industry_sector(F.col("NaicsCode")),
        "loan_type": revolver_kind(F.col("RevolverStatus")),
        "franchise": franchise_kind(F.col("FranchiseCode")),
        "size_band": size_band(F.col("GrossApproval"), protocol),
        "age_group": age_group(F.col("BusinessAge")),
        "maturity_group": maturity_group(F.col("TermInMonths"), protocol),
    })
    return out.withColumns({c: missing_token(F.col(c)) for c in CATEGORICAL if c in out.columns})


def typed_snapshot(raw: DataFrame, protocol: Protocol) -> DataFrame:
    return typed(normalized(raw), protocol)


def with_reason(typed_loans: DataFrame, protocol: Protocol, flags: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``reason``, the first exclusion that claims the row (NULL for none).

    The first branch never holds. Being non-deterministic in name it keeps a later filter on ``reason``
    from being pushed into the text parsing below it, where every predicate would parse the same dates again.
    """
    kept_above = F.when(F.monotonically_increasing_id() < 0, F.lit(""))
    return typed_loans.withColumn("reason", F.coalesce(kept_above, first_reason(flags or exclusion_flags(protocol))))


def eligible(typed_loans: DataFrame, protocol: Protocol, flags: dict[str, Column] | None = None) -> DataFrame:
    """Loans that no exclusion claims, with label and features; one narrow pass, no shuffle.

    ``flags`` leaves out exclusions on columns that are joined later, to be applied there.
    """
    kept = with_reason(typed_loans, protocol, flags).where("reason is null").drop("reason")
    return featured(kept.withColumn("Y", event_label()), protocol)
