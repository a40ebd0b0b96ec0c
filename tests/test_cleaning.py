import datetime as dt

from pyspark.sql import functions as F

from lossweave.config import SOURCE_COLUMNS, Protocol
from lossweave.functions import cleaning
from lossweave.operators import accounting

PROTOCOL = Protocol(states=("CA", "NY", "TX"))
BASE = dict.fromkeys(SOURCE_COLUMNS, "") | {
    "AsOfDate": "2026-06-30", "Program": " 7A", "GrossApproval": "100000", "SBAGuaranteedApproval": "75000", "ApprovalDate": "2006-01-15",
    "FirstDisbursementDate": "2006-01-31", "ProjectState": "CA", "LoanStatus": "EXEMPT", "TermInMonths": "84", "NaicsCode": "722511",
    "RevolverStatus": "N", "JobsSupported": "4", "BusinessAge": "Existing or more than 2 years old",
}
CHARGED = {"LoanStatus": "CHGOFF", "GrossChargeOffAmount": "5000"}


def frame(spark, *changes):
    rows = [BASE | {"row_id": f"f:{i}", "source_file": "f.csv"} | c for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in [*SOURCE_COLUMNS, "row_id", "source_file"]))


def typed(spark, *changes):
    return cleaning.typed_snapshot(frame(spark, *changes), PROTOCOL)


def test_label_is_inclusive_at_both_ends(spark):
    dates = ["2006-01-31", "2009-01-31", "2009-02-01"]
    loans = cleaning.eligible(typed(spark, *[CHARGED | {"ChargeOffDate": d} for d in dates]), PROTOCOL)
    assert [r.Y for r in loans.orderBy("row_id").collect()] == [1, 1, 0]


def test_window_end_clamps_to_month_end(spark):
    row = typed(spark, {"FirstDisbursementDate": "2008-02-29", "ApprovalDate": "2008-02-01"}).first()
    assert row.w == dt.date(2011, 2, 28)


def test_severity_above_approval_keeps_the_row(spark):
    loans = cleaning.eligible(typed(spark, CHARGED | {"ChargeOffDate": "2007-01-01", "GrossChargeOffAmount": "150000"}), PROTOCOL)
    assert [r.Y for r in loans.collect()] == [1]


DAY = dt.timedelta(days=1)


def day(text, shift=0):
    return (dt.date.fromisoformat(text) + shift * DAY).isoformat()


def months_back(text, months):
    """The same day of the month ``months`` earlier; the snapshot's day exists in every month but February."""
    d = dt.date.fromisoformat(text)
    month = d.year * 12 + d.month - 1 - months
    return d.replace(year=month // 12, month=month % 12 + 1).isoformat()


def terms():
    """One change to the base row for each term of each flag, built from the protocol and the base row."""
    issued, paid_out, seen = BASE["ApprovalDate"], BASE["FirstDisbursementDate"], PROTOCOL.snapshot
    last_mature = months_back(seen, PROTOCOL.horizon_months)
    paid = {"LoanStatus": "PIF"}
    return {
        "wrong_program": [{"Program": p} for p in ("", "77", PROTOCOL.program + "X")],
        "cancelled_or_committed": [{"LoanStatus": s} for s in (" CAN CLD ", "COM MIT")],
        "unknown_status": [{"LoanStatus": s} for s in ("", "SOLD")],
        "missing_disbursement": [{"FirstDisbursementDate": v} for v in (" ", "31/01/2006x")],
        "incomplete_window": [{"FirstDisbursementDate": day(last_mature, 1)}],
        "invalid_approval_amount": [{"GrossApproval": v} for v in ("", "-0.01", "NaN", "ten")],
        "unmapped_state": [{"ProjectState": v} for v in ("", "FL")],
        "date_or_status_contradiction": [
            {"ApprovalDate": day(paid_out, 1)},
            {"ApprovalDate": "2006-13-01"},
            {"ChargeOffDate": day(paid_out, 400)},
            {"PaidInFullDate": day(paid_out, 400)},
            CHARGED,
            CHARGED | {"ChargeOffDate": day(paid_out, -1)},
            CHARGED | {"ChargeOffDate": day(seen, 1)},
            paid | {"PaidInFullDate": day(issued, -30)},
            paid | {"PaidInFullDate": day(seen, 1)},
        ],
    }


def test_every_term_of_a_flag_excludes_its_row_once(spark):
    cases = [(flag, change) for flag, changes in terms().items() for change in changes]
    rows = typed(spark, *[c for _, c in cases])
    reasons = [r.reason for r in cleaning.with_reason(rows, PROTOCOL).orderBy(F.split("row_id", ":")[1].cast("int")).collect()]
    assert list(zip(reasons, [c for _, c in cases])) == cases
    waterfall = accounting.exclusion_waterfall(rows, cleaning.exclusion_flags(PROTOCOL), "source_file")
    total = {r.step: r for r in waterfall.where(F.col("source_file") == accounting.TOTAL).collect()}
    assert total.keys() >= terms().keys() and total["date_or_status_contradiction"].remaining == 0
    assert {f: total[f].excluded for f in terms()} == {f: len(c) for f, c in terms().items()}


def test_bounds_of_the_flags_are_kept(spark):
    paid_out, seen = BASE["FirstDisbursementDate"], PROTOCOL.snapshot
    kept = [
        {}, {"ApprovalDate": paid_out}, {"FirstDisbursementDate": months_back(seen, PROTOCOL.horizon_months)}, {"GrossApproval": "0.01"},
        CHARGED | {"ChargeOffDate": paid_out}, CHARGED | {"ChargeOffDate": seen}, {"LoanStatus": "PIF", "PaidInFullDate": seen},
    ]
    assert cleaning.eligible(typed(spark, *kept), PROTOCOL).count() == len(kept)


def test_roles_hold_from_the_first_to_the_last_day(spark):
    want = {}
    for r in PROTOCOL.roles:
        want |= {r.start: r.name, r.end: r.name}
    starts, ends = {r.start for r in PROTOCOL.roles}, {r.end for r in PROTOCOL.roles}
    want |= {day(r.start, -1): PROTOCOL.outside_role for r in PROTOCOL.roles if day(r.start, -1) not in ends}
    want |= {day(r.end, 1): PROTOCOL.outside_role for r in PROTOCOL.roles if day(r.end, 1) not in starts}
    rows = spark.createDataFrame([(d,) for d in want], "d string")
    assert {r.d: r.role for r in rows.select("d", cleaning.role(F.col("d").cast("date"), PROTOCOL).alias("role")).collect()} == want


def test_features_keep_anomalies_as_missing(spark):
    loans = cleaning.eligible(typed(
        spark, {"SBAGuaranteedApproval": "200000", "InitialInterestRate": "-1", "JobsSupported": "-1"},
        {"RevolverStatus": "Y", "FranchiseCode": "12345", "BusinessAge": "Startup, Loan Funds will Open Business", "GrossApproval": "150000"},
        {"RevolverStatus": "", "FranchiseCode": "00000", "BusinessAge": "Change of Ownership", "GrossApproval": "150001", "NaicsCode": "72251"},
        {"BusinessAge": "Unanswered", "NaicsCode": "722511.0", "TermInMonths": "240", "ProcessingMethod": " x "},
    ), PROTOCOL).orderBy("row_id").collect()
    assert loans[0].guarantee_share is None and loans[0].InitialInterestRate is None and loans[0].log_jobs is None
    assert (loans[0].franchise, loans[0].ProcessingMethod) == ("missing", "__missing__")
    assert (loans[1].loan_type, loans[1].franchise, loans[1].age_group, loans[1].size_band) == ("revolving", "present", "new", "<=150k")
    assert (loans[2].loan_type, loans[2].franchise, loans[2].age_group) == ("unknown", "absent", "change_of_ownership")
    assert (loans[2].size_band, loans[2].naics2) == ("150k-350k", "__missing__")
    assert (loans[3].age_group, loans[3].naics2, loans[3].maturity_group, loans[3].ProcessingMethod) == ("unanswered", "72", ">=240_months", "x")


def test_missing_dates_never_raise_flags(spark):
    flags = cleaning.exclusion_flags(PROTOCOL)
    row = typed(spark, {"FirstDisbursementDate": "", "ApprovalDate": ""}).select(*[c.alias(n) for n, c in flags.items()]).first()
    assert [n for n in flags if row[n]] == ["missing_disbursement"] and all(row[n] is not None for n in flags)


def test_overlapping_cohorts_and_duplicates(spark):
    rows = spark.createDataFrame([("a", dt.date(2006, 5, 1), 1), ("b", dt.date(2012, 5, 1), 0), ("c", dt.date(2003, 5, 1), 0)], "k string, d date, Y int")
    found = {(r.k, r.layer, r.cohort) for r in accounting.cohort_membership(rows, PROTOCOL).collect()}
    assert found == {("a", "layer2", "estimation"), ("a", "layer2", "reference"), ("b", "layer1", "oot"), ("b", "layer2", "oot"), ("c", "layer2", "estimation")}
    twice = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert accounting.duplicate_rows(twice, ["a", "b"]).first().indistinguishable_rows == 2


def test_stripping_by_the_ends_of_a_text_equals_stripping_by_character(spark):
    ends = ["", "a", "!", "~", "\x7f", "\u00e9", "\u2027", "\u200b", *cleaning.WHITESPACE]
    texts = [a + m + b for a in ends for m in ("", "x y", " ", "\u3000z") for b in ends] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.btrim(F.coalesce("t", F.lit("")), F.lit(cleaning.WHITESPACE))
    assert rows.where(~cleaning.strip(F.col("t")).eqNullSafe(plain)).isEmpty()


def test_days_are_ten_characters_and_nothing_else(spark):
    from lossweave.functions.cleaning import to_day

    odd = ["2000-02-29", "2001-02-29", "0000-01-01", "9999-12-31", "2000-1-01T", "2000-01-1T", "2000-01-1 ", "2000-01-1\t", "20000-1-01", "02000-1-01", "200000-01-1",
           "+2000-01-1", "-200-01-01", " 2000-01-1", "2000-1-1T5", "2000-01-01T", "2000-01-01 ", "2000-01", "2000", "", "2000/01/01", "2000-0a-01", "2000-01-١١",
           "é000-01-01", "2000-00-10", "2000--1-01", "2000-01--1", "1-2000-0101", None]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    exact = F.when(F.col("t").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("t").try_cast("date"))
    assert rows.where(~to_day(F.col("t")).eqNullSafe(exact)).collect() == []
    assert rows.where(to_day(F.col("t")).isNotNull()).count() == 3


def test_white_space_of_any_kind_is_trimmed(spark):
    from lossweave.functions.cleaning import GAPS, WHITESPACE, strip

    texts = [a + body + b for body in ("", "x", "P I F", "é", "a　b", "~", "!", "\x7f") for a in ("", *WHITESPACE, " \t ", "  ") for b in ("", *WHITESPACE, " \n ", "　 ")]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r.t: (r.s, r.g, r.r) for r in rows.select("t", strip(F.col("t")).alias("s"), F.translate("t", GAPS, "").alias("g"), F.regexp_replace("t", r"\s+", "").alias("r")).collect()}
    assert all(got[t][0] == t.strip(WHITESPACE) and got[t][1] == got[t][2] for t in texts)
    assert got[None][0] == ""


def test_dates_and_numbers_pass_as_their_text_would_be_read(spark):
    from lossweave.config import DATE_SOURCE, NUMERIC_SOURCE
    from lossweave.functions.cleaning import typed
    from lossweave.plans.bindings import TEST

    amounts = ["cast(null as double)", "double('NaN')", "double('Infinity')", "-0e0", "0.1e0 + 0.2e0", "1e-320", "1.7e308"]
    days = ["cast(null as date)", "date'1996-02-29'", "date'0000-01-01'", "date'9999-12-31'", "date'9999-12-31' + 1", "date'0000-01-01' - 1", "date'1899-12-31'"]
    held = spark.sql(" union all ".join(
        "select " + ", ".join([f"{a} as {c}" for c in NUMERIC_SOURCE] + [f"{d} as {c}" for c in DATE_SOURCE]) for a, d in zip(amounts, days)))
    text = held.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in held.columns])
    a, b = typed(held, TEST), typed(text, TEST)
    assert a.dtypes == b.dtypes
    a, b = (x.select(*[F.col(c).cast("string").alias(c) for c in x.columns]) for x in (a, b))  # Python has no year 0
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert a.where("invalid_date = 'true'").count() == 2


def test_codes_and_ages_are_read_as_by_patterns_without_any(spark):
    from lossweave.functions.cleaning import age_group, whole_code

    codes = ["722511.0", "722511", ".0", "0", "", "1.0.0", "1.00", "é.0", "12.0x", None]
    ages = ["Startup, opens", "NEW BUSINESS or 2 years", "new, less than", "2 or less", "Existing", "new", None, "", "Unanswered", "Change of Ownership, startup"]
    rows = spark.createDataFrame(list(zip(codes, ages)), "c string, a string")
    same = rows.select(whole_code(F.col("c")).eqNullSafe(F.regexp_replace("c", r"\.0$", "")).alias("s"), age_group(F.col("a")).alias("g"))
    text = same._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.s for r in same.collect()) and "RLIKE" not in text
    assert [r.g for r in same.collect()] == ["new", "new", "new", "new", "existing", "existing", "existing", "missing", "unanswered", "change_of_ownership"]
