"""Registered queries: projections, filters, labels, row accounting (B) and cohort aggregates (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CATEGORICAL, MACRO, NUMERIC, SOURCE_COLUMNS, ALLOWED_PREDICTORS, LEGAL_STATUS
from ..functions import cleaning
from ..operators import accounting, comparison, linking, loss, profile, timing
from .bindings import TEST, snapshot, table
from .catalog import query
from .inputs import loans, matched, scored, typed_loans
from .oracle_base import FLAG_SQL, with_tables

FLAGS = list(FLAG_SQL)
_UNPIVOT_FLAGS = ", ".join(FLAGS)


# ---- B: projections, filters, predicates, labels -------------------------------------------


@query(
    "b01_text_normalization",
    with_tables("norm") + """
    select upper(LoanStatus) as status, upper(Program) as program, upper(BusinessAge) as age, count(*) as n,
      cast(sum(length(BusinessType)) as bigint) as type_length from norm group by 1, 2, 3""",
)
def text_normalization(spark, sf):
    text = cleaning.normalized(snapshot(spark, sf), upper=True)
    return text.groupBy(
        F.col("LoanStatus").alias("status"), F.col("Program").alias("program"), F.col("BusinessAge").alias("age")
    ).agg(F.count("*").alias("n"), F.sum(F.length("BusinessType")).alias("type_length"))


@query(
    "b02_safe_casts",
    with_tables("typed") + """
    select LoanStatus, count(*) as n, count(*) filter (invalid_date) as invalid_dates, count(TermInMonths) as terms,
      count(InitialInterestRate) as rates, count(GrossChargeOffAmount) as losses, count(d) as origins,
      count(ChargeOffDate) as charge_offs, count(PaidInFullDate) as payoffs, cast(sum(TermInMonths) as double) as term_sum,
      cast(sum(JobsSupported) as double) as jobs_sum from typed group by 1""",
)
def safe_casts(spark, sf):
    return typed_loans(spark, sf).groupBy("LoanStatus").agg(
        F.count("*").alias("n"), F.count_if("invalid_date").alias("invalid_dates"), F.count("TermInMonths").alias("terms"),
        F.count("InitialInterestRate").alias("rates"), F.count("GrossChargeOffAmount").alias("losses"), F.count("d").alias("origins"),
        F.count("ChargeOffDate").alias("charge_offs"), F.count("PaidInFullDate").alias("payoffs"),
        F.sum("TermInMonths").alias("term_sum"), F.sum("JobsSupported").alias("jobs_sum"),
    )


@query(
    "b03_exclusion_flags",
    with_tables("flagged") + f"select {_UNPIVOT_FLAGS}, count(*) as n from flagged group by all",
)
def exclusion_flags(spark, sf):
    flags = cleaning.exclusion_flags(TEST)
    rows = typed_loans(spark, sf).select(*[c.alias(n) for n, c in flags.items()])
    return rows.groupBy(*flags).agg(F.count("*").alias("n"))


@query(
    "b04_overlapping_flags",
    with_tables("flagged") + " union all ".join(
        f"select source_file, '{n}' as flag, count(*) filter ({n}) as n from flagged group by 1" for n in FLAGS
    ),
)
def overlapping_flags(spark, sf):
    return accounting.flag_counts(typed_loans(spark, sf), cleaning.exclusion_flags(TEST), "source_file")


_STEPS = " union all ".join(f"select {i + 1} as ord, '{n}' as step" for i, n in enumerate(FLAGS))
_WATERFALL = (
    with_tables("flagged") + ", hit as (select source_file, case "
    + " ".join(f"when {n} then {i + 1}" for i, n in enumerate(FLAGS))
    + " else 99 end as ord from flagged union all select '__total__', case "
    + " ".join(f"when {n} then {i + 1}" for i, n in enumerate(FLAGS))
    + f" else 99 end from flagged), steps as (select 0 as ord, 'all_source_rows' as step union all {_STEPS}), "
    "sizes as (select source_file, count(*) as n from hit group by 1), "
    "gone as (select z.source_file, s.ord, s.step, z.n, count(h.ord) as excluded from sizes z cross join steps s "
    "left join hit h on h.source_file = z.source_file and h.ord = s.ord group by all) "
    "select source_file, step, excluded, cast(n - sum(excluded) over (partition by source_file order by ord) as bigint) as remaining from gone"
)


@query("b05_exclusion_waterfall", _WATERFALL)
def exclusion_waterfall(spark, sf):
    return accounting.exclusion_waterfall(typed_loans(spark, sf), cleaning.exclusion_flags(TEST), "source_file")


@query(
    "b06_event_label",
    with_tables("elig") + """
    select cast(year(d) as int) as year, cast(month(d) as int) as month, count(*) as n, cast(sum(Y) as bigint) as events,
      count(*) filter (ChargeOffDate > w) as later_events, max(w) as last_window from elig group by 1, 2""",
)
def event_label(spark, sf):
    return loans(spark, sf, "year", "d", "w", "Y", "ChargeOffDate").groupBy("year", F.month("d").alias("month")).agg(
        F.count("*").alias("n"), F.sum("Y").alias("events"), F.count_if(F.col("ChargeOffDate") > F.col("w")).alias("later_events"),
        F.max("w").alias("last_window"),
    )


@query(
    "b07_chronological_role",
    with_tables("elig") + "select role, cast(year as int) as year, count(*) as n, min(d) as first_d, max(d) as last_d from elig group by 1, 2",
)
def chronological_role(spark, sf):
    return loans(spark, sf, "year", "d").groupBy("role", "year").agg(
        F.count("*").alias("n"), F.min("d").alias("first_d"), F.max("d").alias("last_d")
    )


COHORT_SQL = (
    "cohorts as (select * from (values ('layer1','estimation',date '1995-01-01',date '1996-12-31'),"
    "('layer1','crisis',date '1999-01-01',date '1999-12-31'),('layer1','oot',date '2000-01-01',date '2000-12-31'),"
    "('layer2','estimation',date '1995-01-01',date '1999-12-31'),('layer2','reference',date '1998-01-01',date '1998-12-31'),"
    "('layer2','oot',date '2000-01-01',date '2000-12-31')) t(layer, cohort, lo, hi))"
)


@query(
    "b08_cohort_membership",
    with_tables("elig") + f", {COHORT_SQL} select layer, cohort, ProjectState as state, count(*) as n, cast(sum(Y) as bigint) as events "
    "from elig join cohorts on d between lo and hi group by 1, 2, 3",
)
def cohort_membership(spark, sf):
    member = accounting.cohort_membership(loans(spark, sf, "d", "Y", "ProjectState"), TEST)
    return member.groupBy("layer", "cohort", F.col("ProjectState").alias("state")).agg(
        F.count("*").alias("n"), F.sum("Y").alias("events")
    )


@query(
    "b09_numeric_features",
    with_tables("elig") + """
    select role, round(avg(log_approval), 6) as log_approval, count(guarantee_share) as shares, round(avg(guarantee_share), 6) as share,
      count(log_jobs) as jobs_n, round(avg(log_jobs), 6) as log_jobs, count(InitialInterestRate) as rates,
      min(year_trend) as first_trend, max(year_trend) as last_trend from elig group by 1""",
)
def numeric_features(spark, sf):
    return loans(spark, sf).groupBy("role").agg(
        F.round(F.avg("log_approval"), 6).alias("log_approval"), F.count("guarantee_share").alias("shares"),
        F.round(F.avg("guarantee_share"), 6).alias("share"), F.count("log_jobs").alias("jobs_n"),
        F.round(F.avg("log_jobs"), 6).alias("log_jobs"), F.count("InitialInterestRate").alias("rates"),
        F.min(F.col("year_trend").cast("long")).alias("first_trend"), F.max(F.col("year_trend").cast("long")).alias("last_trend"),
    )


@query(
    "b10_code_features",
    with_tables("elig") + "select naics2, loan_type, franchise, count(*) as n from elig group by 1, 2, 3",
)
def code_features(spark, sf):
    return loans(spark, sf).groupBy("naics2", "loan_type", "franchise").agg(F.count("*").alias("n"))


@query(
    "b11_bands",
    with_tables("elig") + """select size_band, age_group, maturity_group, count(*) as n, min(GrossApproval) as lowest,
    max(GrossApproval) as highest from elig group by 1, 2, 3""",
)
def bands(spark, sf):
    return loans(spark, sf).groupBy("size_band", "age_group", "maturity_group").agg(
        F.count("*").alias("n"), F.min("GrossApproval").alias("lowest"), F.max("GrossApproval").alias("highest")
    )


@query(
    "b12_missing_token",
    with_tables("elig") + "select ProcessingMethod, BusinessType, BusinessAge, count(*) as n from elig group by 1, 2, 3",
)
def missing_token(spark, sf):
    return loans(spark, sf).groupBy("ProcessingMethod", "BusinessType", "BusinessAge").agg(F.count("*").alias("n"))


@query(
    "b13_complete_cases",
    with_tables("matched") + """
    select cast(year as int) as year, count(*) as eligible_n,
      count(*) filter (u0 is not null and du is not null and h0 is not null and dh is not null and macro_complete) as matched_n,
      count(*) filter (not (u0 is not null and du is not null and h0 is not null and dh is not null and macro_complete)) as excluded_n
    from matched group by 1""",
)
def complete_cases(spark, sf):
    ok = F.col("macro_complete")
    for c in MACRO:
        ok = ok & F.col(c).isNotNull()
    return matched(spark, sf).groupBy("year").agg(
        F.count("*").alias("eligible_n"), cleaning.count_where(ok).alias("matched_n"), F.count_if(~cleaning.holds(ok)).alias("excluded_n")
    )


@query(
    "b14_fit_purity",
    with_tables("elig") + """
    select 'layer1' as artefact, role, count(*) as n, 0::bigint as outside_train, '' as not_allowed from elig where role = 'train' group by role
    union all select 'leaky', role, count(*), case when role = 'train' then 0 else count(*) end, 'GrossChargeOffAmount'
    from elig where role in ('train', 'tune') group by role""",
)
def fit_purity(spark, sf):
    rows = loans(spark, sf)
    fits = {"layer1": rows.where("role = 'train'"), "leaky": rows.where("role in ('train', 'tune')")}
    columns = {"layer1": NUMERIC + CATEGORICAL, "leaky": (*NUMERIC, "GrossChargeOffAmount")}
    return linking.fit_purity(fits, columns, ALLOWED_PREDICTORS)


@query(
    "b15_selector",
    with_tables("elig") + """select row_id, d, GrossApproval, Y from elig
    where role = 'crisis' and loan_type = 'term' and size_band = '>1m' and ProjectState = '3'""",
)
def selector(spark, sf):
    rows = linking.select_where(loans(spark, sf), role="crisis", loan_type="term", size_band=">1m", ProjectState="3")
    return rows.select("row_id", "d", "GrossApproval", "Y")


# ---- E: aggregations ------------------------------------------------------------------------


@query(
    "e01_cohort_counts",
    with_tables("elig") + """
    select cast(year as int) as year, LoanStatus, role, count(*) as n, cast(sum(Y) as bigint) as events,
      cast(sum(1 - Y) as bigint) as non_events from elig group by 1, 2, 3""",
)
def cohort_counts(spark, sf):
    out = accounting.cohort_counts(loans(spark, sf, "year", "LoanStatus", "Y"), ["year", "LoanStatus", "role"])
    return out.withColumn("non_events", F.col("n") - F.col("events"))


@query(
    "e02_split_counts",
    with_tables("elig") + """select role, count(*) as n, cast(sum(Y) as bigint) as events, min(d) as earliest_d, max(d) as latest_d,
    max(w) as latest_window from elig group by 1""",
)
def split_counts(spark, sf):
    return accounting.split_counts(loans(spark, sf, "Y", "d", "w"))


_REPORTED = (*NUMERIC, "TermInMonths")


@query(
    "e03_missingness",
    with_tables("elig") + " union all ".join(
        f"select role, '{c}' as feature, count(*) as n, count(*) - count({c}) as missing, "
        f"round((count(*) - count({c})) / count(*)::double, 6) as missing_share from elig group by 1" for c in _REPORTED
    ),
)
def missingness(spark, sf):
    out = accounting.missing_by(loans(spark, sf, *_REPORTED), ["role"], _REPORTED)
    return out.withColumn("missing_share", F.round("missing_share", 6))


@query(
    "e04_duplicate_rows",
    with_tables("elig") + """
    , g as (select count(*) as n from elig group by LoanStatus, ProjectState, BusinessType, d, TermInMonths, JobsSupported)
    select cast(sum(n) as bigint) as eligible_rows, cast(coalesce(sum(n) filter (n > 1), 0) as bigint) as indistinguishable_rows from g""",
)
def duplicate_rows(spark, sf):
    key = ["LoanStatus", "ProjectState", "BusinessType", "d", "TermInMonths", "JobsSupported"]
    return accounting.duplicate_rows(loans(spark, sf, *key), key)


@query(
    "e05_match_waterfall",
    with_tables("matched") + """select role, count(*) as eligible, count(*) filter (u0 is not null and macro_complete) as matched,
    count(*) filter (u0 is not null and macro_complete and Y = 1) as events from matched group by 1""",
)
def match_waterfall(spark, sf):
    ok = F.col("u0").isNotNull() & F.col("macro_complete")
    return matched(spark, sf, "Y").groupBy("role").agg(
        F.count("*").alias("eligible"), F.count_if(ok).alias("matched"), F.count_if(ok & (F.col("Y") == 1)).alias("events")
    )


_OK = "(u0 is not null and du is not null and h0 is not null and dh is not null and macro_complete)"


@query(
    "e06_sample_waterfall",
    with_tables("matched") + f", {COHORT_SQL} select layer, cohort, count(*) as eligible_n, count(*) filter {_OK.replace('(', '(', 1)} as n, "
    f"count(*) filter (not {_OK}) as macro_excluded_n, cast(coalesce(sum(Y) filter {_OK}, 0) as bigint) as events, "
    f"min(d) filter {_OK} as earliest_d, max(d) filter {_OK} as latest_d from matched join cohorts on d between lo and hi group by 1, 2",
)
def sample_waterfall(spark, sf):
    ok = F.col("macro_complete")
    for c in MACRO:
        ok = ok & F.col(c).isNotNull()
    return accounting.sample_waterfall(matched(spark, sf, "Y"), TEST, ok)


def _levels_sql(having: str = "") -> str:
    parts = [
        f"select '{c}' as feature, {c} as level, count(*) as n, cast(sum(Y) as bigint) as events, "
        f"cast(sum(1 - Y) as bigint) as non_events from elig where role = 'train' group by 2" for c in CATEGORICAL
    ]
    return f"select * from ({' union all '.join(parts)}) {having}"


@query("e07_separation_witnesses", with_tables("elig") + """
    select * from (select 'ProjectState x size_band x age_group' as feature, concat_ws('|', ProjectState, size_band, age_group) as level,
    count(*) as n, cast(sum(Y) as bigint) as events, cast(sum(1 - Y) as bigint) as non_events from elig where role = 'train' group by 2)
    where events = 0 or non_events = 0""")
def separation_witnesses(spark, sf):
    name = "ProjectState x size_band x age_group"
    rows = loans(spark, sf, "Y", "ProjectState", "size_band", "age_group").where("role = 'train'").withColumn(name, F.concat_ws("|", "ProjectState", "size_band", "age_group"))
    return accounting.separation_witnesses(rows, [name])


@query("e08_level_counts", with_tables("elig") + _levels_sql())
def level_counts(spark, sf):
    return accounting.level_outcomes(loans(spark, sf, "Y", *CATEGORICAL).where("role = 'train'"), CATEGORICAL)


@query(
    "e09_state_validation",
    with_tables("scored") + """select role, ProjectState as state, count(*) as n, cast(sum(Y) as bigint) as events,
    round(avg(Y), 6) as recorded_rate, round(avg(p), 6) as mean_predicted from scored where role in ('crisis', 'oot') group by 1, 2""",
)
def state_validation(spark, sf):
    rows = scored(spark, sf, "Y", "d", "ProjectState").where(F.col("role").isin("crisis", "oot"))
    out = comparison.calibration_means(rows, ["role", F.col("ProjectState").alias("state")])
    return out.select("role", "state", "n", "events", F.round("recorded_rate", 6).alias("recorded_rate"), F.round("mean_predicted", 6).alias("mean_predicted"))


def _profile_sql() -> str:
    parse = {c: f"cast(try_strptime({c}, '%Y-%m-%d') as date)" for c in
             ("ApprovalDate", "FirstDisbursementDate", "PaidInFullDate", "ChargeOffDate")}
    head = with_tables("norm") + ", up as (select " + ", ".join(f"upper({c}) as {c}" for c in ("row_id", "source_file", *SOURCE_COLUMNS)) + " from norm), "
    head += "pd as (select *, " + ", ".join(f"{e} as _{c}" for c, e in parse.items()) + " from up) "
    sections = {
        "status": "LoanStatus", "program": "Program", "business_age": "BusinessAge", "revolver": "RevolverStatus",
        "approval_year": "cast(year(_ApprovalDate) as varchar)", "disbursement_year": "cast(year(_FirstDisbursementDate) as varchar)",
        "incomplete_window_year": "case when cast(_FirstDisbursementDate + interval 12 month as date) > date '2001-12-31' then cast(year(_FirstDisbursementDate) as varchar) end",
    } | {f"missing_{c}": f"case when _{c} is null then LoanStatus end" for c in parse}
    parts = [
        f"select source_file, '{s}' as section, {e} as item, cast(count(*) as varchar) as value from pd where ({e}) is not null group by 1, 3"
        for s, e in sections.items()
    ]
    parts.append("select source_file, 'rows', 'all', cast(count(*) as varchar) from pd group by 1")
    day, ok, gross = "_FirstDisbursementDate", "LoanStatus", "try_cast(GrossApproval as double)"
    counters = {f"invalid_nonblank_{c}": f"{c} <> '' and _{c} is null" for c in parse} | {
        "incomplete_window": f"cast({day} + interval 12 month as date) > date '2001-12-31'",
        "cancelled_or_undisbursed": f"{ok} in ('CANCLD','COMMIT')",
        "noncancelled_with_missing_first_disbursement": f"{ok} not in ('CANCLD','COMMIT') and {day} is null",
        "chargeoff_status_missing_date": f"{ok} = 'CHGOFF' and _ChargeOffDate is null",
        "chargeoff_date_before_first_disbursement": f"_ChargeOffDate < {day}",
        "first_disbursement_before_approval": f"{day} < _ApprovalDate",
        "nonchargeoff_status_with_chargeoff_date": f"{ok} <> 'CHGOFF' and _ChargeOffDate is not null",
        "non_pif_status_with_payoff_date": f"{ok} <> 'PIF' and _PaidInFullDate is not null",
        "payoff_date_before_first_disbursement": f"_PaidInFullDate < {day}",
        "unknown_status": f"{ok} not in ({', '.join(repr(s) for s in LEGAL_STATUS)})",
        "invalid_or_nonpositive_gross_approval": f"{gross} is null or {gross} <= 0",
        "guarantee_exceeds_gross_approval": f"try_cast(SBAGuaranteedApproval as double) > {gross}",
        "chargeoff_amount_exceeds_gross_approval": f"try_cast(GrossChargeOffAmount as double) > {gross}",
    }
    parts += [f"select source_file, 'quality', '{n}', cast(count(*) filter ({e}) as varchar) from pd group by 1" for n, e in counters.items()]
    parts.append(
        "select source_file, 'quality', 'dates_after_snapshot', cast("
        + " + ".join(f"count(*) filter (_{c} > date '2001-12-31')" for c in parse) + " as varchar) from pd group by 1"
    )
    for end, fn in (("first", "min"), ("last", "max")):
        parts += [f"select source_file, '{end}_date', '{c}', cast({fn}(_{c}) as varchar) from pd group by 1 having {fn}(_{c}) is not null" for c in parse]
    return head + " union all ".join(parts)


@query("e10_source_profile", _profile_sql())
def source_profile(spark, sf):
    return profile.source_profile(cleaning.normalized(snapshot(spark, sf), upper=True), TEST)


_GROUPS = ("loan_type", "size_band", "naics2", "age_group", "maturity_group")


def grouped_sql(source: str, aggregates: str, where: str = "true", keys: str = "") -> str:
    """Overall plus five single-key groupings as a plain union."""
    lead = f"{keys}, " if keys else ""
    parts = [f"select {lead}'overall' as group_name, 'all' as group_value, {aggregates} from {source} where {where}" + (f" group by {keys}" if keys else "")]
    parts += [
        f"select {lead}'{g}' as group_name, {g} as group_value, {aggregates} from {source} where {where} group by {lead}{g}" for g in _GROUPS
    ]
    return " union all ".join(parts)


@query(
    "e11_grouping_sets",
    with_tables("elig") + grouped_sql("elig", "count(*) as n, cast(sum(Y) as bigint) as events, round(sum(GrossApproval), 2) as exposure", "role = 'reference'"),
)
def grouping_sets(spark, sf):
    rows = loans(spark, sf).where("role = 'reference'")
    out = loss.group_sums(rows, {"n": F.lit(1), "events": F.col("Y"), "exposure": F.col("GrossApproval")})
    return out.withColumn("exposure", F.round("exposure", 2)).withColumn("n", F.col("n").cast("long"))


TIMING_SQL = (
    with_tables("elig", "snap") + ", tm as (select e.row_id, e.LoanStatus, e.loan_type, e.d, e.w, cast(year(e.ApprovalDate) as int) as approval_year, "
    "case when e.LoanStatus = 'CHGOFF' then e.ChargeOffDate else e.PaidInFullDate end as event_date, "
    "try_cast(nullif(trim(s.TermInMonths), '') as double) as term, trim(s.TermInMonths) as txt "
    "from elig e join snap s using (row_id) where e.LoanStatus in ('CHGOFF', 'PIF')), "
    "ta as (select *, date_diff('day', d, event_date) / (365.25::double / 12) as elapsed_months, "
    "term - date_diff('day', d, event_date) / (365.25::double / 12) as difference_months, "
    "case when event_date is null or d is null then 'missing' when event_date >= d then 'valid' else 'invalid' end as date_status, "
    "case when txt = '' then 'missing' when term > 0 then 'valid' else 'invalid' end as term_status, "
    "coalesce(LoanStatus = 'CHGOFF' and event_date > w, false) as after_window from tm), "
    "tv as (select *, date_status = 'valid' and term_status = 'valid' as valid, "
    "date_status = 'valid' and term_status = 'valid' and abs(difference_months) <= 3 as match from ta) "
)


@query(
    "e12_timing_rows",
    TIMING_SQL + """select row_id, date_status, term_status, round(elapsed_months, 6) as elapsed_months,
    round(difference_months, 6) as difference_months, valid, match, after_window from tv""",
)
def timing_rows(spark, sf):
    rows = loans(spark, sf, "row_id", "LoanStatus", "loan_type", "ApprovalDate", "PaidInFullDate", "ChargeOffDate", "d", "w")
    out = timing.timing_rows(rows, snapshot(spark, sf))
    return out.select(
        "row_id", "date_status", "term_status", F.round("elapsed_months", 6).alias("elapsed_months"),
        F.round("difference_months", 6).alias("difference_months"), "valid", "match", "after_window",
    )


_STATUS_COUNTS = ", ".join(
    f"count(*) filter ({w}) as {n}" for n, w in {
        "valid_n": "valid", "date_valid_n": "date_status = 'valid'", "term_valid_n": "term_status = 'valid'",
        "date_missing_n": "date_status = 'missing'", "date_invalid_n": "date_status = 'invalid'",
        "term_missing_n": "term_status = 'missing'", "term_invalid_n": "term_status = 'invalid'",
        "missing_either_n": "date_status = 'missing' or term_status = 'missing'",
        "invalid_either_n": "date_status = 'invalid' or term_status = 'invalid'",
        "match_n": "match", "after_window_n": "after_window",
    }.items()
)
_QUANTILES = ", ".join(
    f"round(quantile_cont(difference_months, {q}) filter (valid), 6) as difference_{n}" for n, q in timing.PERCENTILES.items()
)
_VERDICT = (
    "case when count(*) filter (valid and LoanStatus = 'CHGOFF') >= 100 and count(*) filter (match and LoanStatus = 'CHGOFF') >= "
    "0.5::double * count(*) filter (valid and LoanStatus = 'CHGOFF') then 'Strong evidence of later updating.' else 'Timing unverifiable.' end as verdict"
)


@query(
    "e13_timing_summary",
    TIMING_SQL + " union all ".join(
        f"select '{scope}' as scope, {key} as group_key, count(*) as n, {_STATUS_COUNTS}, {_QUANTILES}, "
        "count(*) filter (match)::double / nullif(count(*) filter (valid), 0) as match_share, "
        "round(avg(difference_months) filter (valid), 6) as difference_mean, round(stddev_samp(difference_months) filter (valid), 6) as difference_sd "
        f"from tv group by {by}"
        for scope, key, by in (
            ("overall", "'all'", "()"), ("status", "LoanStatus", "LoanStatus"),
            ("approval_year_loan_type_status", "approval_year || '|' || loan_type || '|' || LoanStatus", "approval_year, loan_type, LoanStatus"),
        )
    ),
)
def timing_summary(spark, sf):
    out = timing.timing_summary(timing.timing_rows(loans(spark, sf), snapshot(spark, sf)))
    rounded = [c for c, t in out.dtypes if t == "double"]
    return out.drop("verdict").withColumns({c: F.round(c, 6) for c in rounded if c != "match_share"})


@query(
    "e14_timing_verdict",
    TIMING_SQL + " union all ".join(
        f"select '{scope}' as scope, {key} as group_key, {_VERDICT} from tv group by {by}"
        for scope, key, by in (("overall", "'all'", "()"), ("status", "LoanStatus", "LoanStatus"),
                               ("approval_year_loan_type_status", "approval_year || '|' || loan_type || '|' || LoanStatus", "approval_year, loan_type, LoanStatus"))
    ),
)
def timing_verdict(spark, sf):
    return timing.timing_counts(timing.timing_rows(loans(spark, sf), snapshot(spark, sf))).select("scope", "group_key", "verdict")


def severity_sql(prefix: str = "") -> str:
    """All three variants of the 12-cell grid; named tables end with ``lgd``."""
    return (
        f"ev{prefix} as (select v.variant, loan_type, size_band, GrossApproval as ead, GrossChargeOffAmount as raw_loss, "
        "case when v.variant = 'capped' then least(GrossChargeOffAmount, GrossApproval) else GrossChargeOffAmount end as loss, "
        "GrossChargeOffAmount is not null and GrossChargeOffAmount >= 0 as ok "
        "from elig cross join (values ('primary'), ('capped'), ('downturn')) v(variant) "
        "where role = 'train' and Y = 1 and (v.variant <> 'downturn' or year = 1995)), "
        f"sev_grid{prefix} as (select v.variant, t.loan_type, b.size_band from (values ('primary'), ('capped'), ('downturn')) v(variant) "
        "cross join (values ('term'), ('revolving'), ('unknown')) t(loan_type) cross join (values ('<=150k'), ('150k-350k'), ('350k-1m'), ('>1m')) b(size_band)), "
        f"sev_all{prefix} as (select g.*, (select count(*) from ev e where e.variant = g.variant and e.loan_type = g.loan_type and e.size_band = g.size_band) as cell_events, "
        "(select count(*) from ev e where ok and e.variant = g.variant and e.loan_type = g.loan_type and e.size_band = g.size_band) as n1, "
        "(select count(*) from ev e where ok and e.variant = g.variant and e.loan_type = g.loan_type) as n2, "
        "(select count(*) from ev e where ok and e.variant = g.variant) as n3, "
        "(select sum(loss) / sum(ead) from ev e where ok and e.variant = g.variant and e.loan_type = g.loan_type and e.size_band = g.size_band) as r1, "
        "(select sum(loss) / sum(ead) from ev e where ok and e.variant = g.variant and e.loan_type = g.loan_type) as r2, "
        "(select sum(loss) / sum(ead) from ev e where ok and e.variant = g.variant) as r3, "
        "(select count(*) from ev e where ok and raw_loss > ead and e.variant = g.variant and e.loan_type = g.loan_type and e.size_band = g.size_band) as o1, "
        "(select count(*) from ev e where ok and raw_loss > ead and e.variant = g.variant and e.loan_type = g.loan_type) as o2, "
        f"(select count(*) from ev e where ok and raw_loss > ead and e.variant = g.variant) as o3 from sev_grid{prefix} g), "
        f"lgd{prefix} as (select variant, loan_type, size_band, cell_events, n1 as valid_cell_n, cell_events - n1 as excluded_n, "
        "case when n1 >= 50 then 'cell' when n2 >= 50 then 'loan_type' else 'overall' end as pool, "
        "case when n1 >= 50 then n1 when n2 >= 50 then n2 else n3 end as pooled_n, "
        "case when n1 >= 50 then r1 when n2 >= 50 then r2 else r3 end as lgd, "
        f"case when n1 >= 50 then o1 when n2 >= 50 then o2 else o3 end as ratios_above_one from sev_all{prefix})"
    )


@query(
    "e15_pooled_severity",
    with_tables("elig") + ", " + severity_sql() + " select * replace (round(lgd, 6) as lgd) from lgd",
)
def pooled_severity(spark, sf):
    rows = loans(spark, sf, *loss.SEVERITY_INPUTS).where("role = 'train'")
    return loss.severity_table(rows, TEST).withColumn("lgd", F.round("lgd", 6))


@query(
    "e16_calibration_means",
    with_tables("scored") + """select 'layer1' as variant, 'scorecard' as model, role as cohort, count(*) as n, cast(sum(Y) as bigint) as events,
    round(avg(p), 6) as mean_predicted, round(avg(Y), 6) as recorded_rate, min(d) as start_d, max(d) as end_d from scored group by role""",
)
def calibration_means(spark, sf):
    rows = scored(spark, sf, "Y", "d").select(F.lit("layer1").alias("variant"), F.lit("scorecard").alias("model"), F.col("role").alias("cohort"), "Y", "p", "d")
    out = comparison.calibration_means(rows, ["variant", "model", "cohort"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_predicted", "recorded_rate")})


@query(
    "e17_loss_population",
    with_tables("elig") + """select role, count(*) as reference_n, count(guarantee_share) as valid_loss_n,
    count(*) - count(guarantee_share) as excluded_invalid_share_n from elig group by 1""",
)
def loss_population(spark, sf):
    return loss.loss_population(loans(spark, sf, "guarantee_share"), ["role"])


_STATE_MEANS = "select ProjectState as state, count(*) as n, avg(p) as predicted, avg(Y) as recorded from scored where role = '{}' group by 1"


@query(
    "e18_weighted_comparison",
    with_tables("scored") + f", a as ({_STATE_MEANS.format('crisis')}), b as ({_STATE_MEANS.format('oot')}) "
    + " union all ".join(
        f"select '{c}' as comparison, round(sum(a.{c} * a.n) / sum(a.n), 6) as earlier, round(sum(b.{c} * b.n) / sum(b.n), 6) as later, count(*) as cells "
        "from a join b using (state)" for c in ("predicted", "recorded")
    ),
)
def weighted_comparison(spark, sf):
    means = comparison.calibration_means(scored(spark, sf, "Y", "d", "ProjectState"), ["role", F.col("ProjectState").alias("state")]).select(
        "role", "state", "n", F.col("mean_predicted").alias("predicted"), F.col("recorded_rate").alias("recorded")
    )
    out = comparison.weighted_comparison(means.where("role = 'crisis'"), means.where("role = 'oot'"), ["state"], "n", ["predicted", "recorded"])
    return out.withColumns({c: F.round(c, 6) for c in ("earlier", "later")})


@query(
    "e19_attempt_summary",
    """with att as (select user_id % 5 as variant, event_id as attempt, event_type <> 'error' as successful,
    case when event_type = 'error' then case when value > 20 then 'iteration limit' else 'line-search exhaustion' end end as reason from events)
    select variant, count(*) as attempted, count(*) filter (successful) as successful, count(*) filter (not successful) as failed,
    count(*) filter (reason = 'iteration limit') as iteration_limit, count(*) filter (reason = 'line-search exhaustion') as line_search
    from att group by 1""",
)
def attempt_summary(spark, sf):
    ok = F.col("event_type") != "error"
    reason = F.when(~ok, F.when(F.col("value") > 20, "iteration limit").otherwise("line-search exhaustion"))
    attempts = table(spark, sf, "events").select(
        (F.col("user_id") % 5).alias("variant"), F.col("event_id").alias("attempt"), ok.alias("successful"), reason.alias("message")
    )
    out = comparison.attempt_summary(attempts, ["variant"])
    return out.select(
        "variant", "attempted", "successful", "failed", F.coalesce(F.col("failures")["iteration limit"], F.lit(0)).alias("iteration_limit"),
        F.coalesce(F.col("failures")["line-search exhaustion"], F.lit(0)).alias("line_search"),
    )


_RULES = {
    "window_complete": "w <= date '2001-12-31'", "origin_observed": "d is not null", "positive_approval": "GrossApproval > 0",
    "all_positive_labels_in_window": "Y = 0 or ChargeOffDate between d and w",
    "all_non_events_outside_window_or_missing": "Y = 1 or ChargeOffDate is null or ChargeOffDate > w",
    "full_macro_path_matched": "u0 is not null and peak_du is not null and macro_complete",
    "peak_not_below_endpoint_or_zero": "peak_du is null or peak_du >= greatest(coalesce(du, 0), 0) - 1e-12",
}


@query(
    "e20_integrity_rules",
    with_tables("matched") + " union all ".join(
        f"select '{n}' as \"check\", count(*) filter (not coalesce({r}, false)) = 0 as passed, count(*) filter (not coalesce({r}, false)) as violations from matched"
        for n, r in _RULES.items()
    ),
)
def integrity_rules(spark, sf):
    return accounting.integrity_report(matched(spark, sf, "w", "GrossApproval", "Y", "ChargeOffDate"), {n: F.expr(r) for n, r in _RULES.items()})


@query(
    "e21_scenario_range",
    with_tables("scenario") + """select scenario, round(min(u0), 6) as u0_min, round(max(u0), 6) as u0_max, round(min(du), 6) as du_min, round(max(du), 6) as du_max,
    round(min(dh), 6) as dh_min, round(max(dh), 6) as dh_max from scenario group by 1""",
)
def scenario_range(spark, sf):
    from .inputs import scenarios

    out = comparison.ranges(scenarios(spark, sf), ["scenario"], ["u0", "du", "dh"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "scenario"})
