"""Registered queries: joins (C), time series and ordered operators (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import count_where, strip
from ..operators import linking, ordered, panel
from ..session import lookup_join
from .bindings import TEST, monthly_series, quarterly_series, snapshot
from .catalog import query
from .inputs import loans, matched, scenarios, scored, with_quarter
from .oracle_base import with_tables
from .queries_rows import COHORT_SQL, severity_sql


def computed_panel(spark, sf):
    return panel.macro_panel(monthly_series(spark, sf), with_quarter(quarterly_series(spark, sf)), TEST)


def _r(*columns):
    return {c: F.round(c, 6) for c in columns}


# ---- C: joins -------------------------------------------------------------------------------


@query(
    "c01_panel_join",
    with_tables("matched") + """select ProjectState as state, month, count(*) as n, count(u0) as with_u, count(du) as with_du, count(peak_du) as with_peak,
    min(du) as du, round(max(dh), 6) as dh from matched group by 1, 2""",
)
def panel_join(spark, sf):
    return matched(spark, sf, "ProjectState").groupBy(F.col("ProjectState").alias("state"), "month").agg(
        F.count("*").alias("n"), F.count("u0").alias("with_u"), F.count("du").alias("with_du"), F.count("peak_du").alias("with_peak"),
        F.min("du").alias("du"), F.round(F.max("dh"), 6).alias("dh"),
    )


@query(
    "c02_scenario_application",
    with_tables("elig", "scenario") + """select s.scenario, e.ProjectState as state, count(*) as n, round(sum(e.GrossApproval), 2) as exposure,
    round(min(s.u0), 6) as u0, round(max(s.peak_du), 6) as peak_du
    from elig e left join scenario s using (ProjectState) where e.role = 'reference' group by 1, 2""",
)
def scenario_application(spark, sf):
    rows = linking.apply_scenarios(loans(spark, sf, "ProjectState", "GrossApproval").where("role = 'reference'"), scenarios(spark, sf))
    return rows.groupBy("scenario", F.col("ProjectState").alias("state")).agg(
        F.count("*").alias("n"), F.round(F.sum("GrossApproval"), 2).alias("exposure"),
        F.round(F.min("u0"), 6).alias("u0"), F.round(F.max("peak_du"), 6).alias("peak_du"),
    )


@query(
    "c03_severity_lookup",
    with_tables("elig") + ", " + severity_sql() + """
    select e.role, e.loan_type, e.size_band, count(*) as n, round(avg(l.lgd), 6) as lgd from elig e
    join lgd l on l.loan_type = e.loan_type and l.size_band = e.size_band and l.variant = 'primary' group by 1, 2, 3""",
)
def severity_lookup(spark, sf):
    from ..operators import loss

    rows = loans(spark, sf, *loss.SEVERITY_INPUTS)
    severity = loss.severity_table(rows.where("role = 'train'"), TEST)
    out = loss.assign_severity(rows, severity, ["primary"])
    return out.groupBy("role", "loan_type", "size_band").agg(F.count("*").alias("n"), F.round(F.avg("lgd_primary"), 6).alias("lgd"))


@query(
    "c04_training_bounds",
    with_tables("elig") + """
    , b as (select ProjectState, min(log_jobs) as lo, max(log_jobs) as hi, min(GrossApproval) as glo, max(GrossApproval) as ghi
      from elig where role = 'train' group by 1)
    select e.role, e.ProjectState as state, count(*) as n, count(*) filter (e.log_jobs < lo or e.log_jobs > hi) as jobs_outside,
      count(*) filter (e.GrossApproval < glo or e.GrossApproval > ghi) as approval_outside
    from elig e left join b using (ProjectState) where e.role in ('crisis', 'oot') group by 1, 2""",
)
def training_bounds(spark, sf):
    rows = loans(spark, sf)
    bounds = rows.where("role = 'train'").groupBy("ProjectState").agg(
        F.min("log_jobs").alias("lo"), F.max("log_jobs").alias("hi"), F.min("GrossApproval").alias("glo"), F.max("GrossApproval").alias("ghi")
    )
    target = lookup_join(rows.where(F.col("role").isin("crisis", "oot")), bounds, ["ProjectState"])
    return target.groupBy("role", F.col("ProjectState").alias("state")).agg(
        F.count("*").alias("n"), count_where((F.col("log_jobs") < F.col("lo")) | (F.col("log_jobs") > F.col("hi"))).alias("jobs_outside"),
        count_where((F.col("GrossApproval") < F.col("glo")) | (F.col("GrossApproval") > F.col("ghi"))).alias("approval_outside"),
    )


@query(
    "c05_source_text_join",
    with_tables("elig", "snap") + """select case when trim(s.TermInMonths) = '' then 'missing' when try_cast(s.TermInMonths as double) > 0 then 'valid'
    else 'invalid' end as term_status, e.LoanStatus, count(*) as n, count(e.TermInMonths) as typed_n from elig e join snap s using (row_id) group by 1, 2""",
)
def source_text_join(spark, sf):
    rows = linking.attach_source_text(loans(spark, sf), snapshot(spark, sf), "TermInMonths", "term_text")
    text = strip(F.col("term_text"))
    status = F.when(text == "", "missing").when(F.nullif(text, F.lit("")).try_cast("double") > 0, "valid").otherwise("invalid")
    return rows.groupBy(status.alias("term_status"), "LoanStatus").agg(F.count("*").alias("n"), F.count("TermInMonths").alias("typed_n"))


@query(
    "c06_frozen_selection",
    with_tables("elig") + "select row_id, d, ProjectState as state, Y from elig where role = 'reference' and size_band = '>1m'",
)
def frozen_selection(spark, sf):
    rows = loans(spark, sf)
    frozen = rows.where("role = 'reference' and size_band = '>1m'")
    return linking.frozen_selection(rows, frozen).select("row_id", "d", F.col("ProjectState").alias("state"), "Y")


_DRAW_RATES = (
    "select 'with_rate' as variant, role, draw, sum(dw.w * p) / sum(dw.w) as value from scored join dw on ProjectState = state where role in ('crisis','oot') group by 2, 3 "
    "union all select 'recorded', role, draw, sum(dw.w * Y) / sum(dw.w) from scored join dw on ProjectState = state where role in ('crisis','oot') group by 2, 3"
)
DRAW_SQL = (
    "dw as (select cast(g.draw as int) as draw, cast(n.n_nationkey as varchar) as state, (7 * g.draw + 3 * n.n_nationkey) % 4 as w "
    "from nation n cross join (select unnest(range(0, 40)) as draw) g)"
)


def draw_schedule(spark, sf, draws: int = 40):
    """Deterministic state multiplicities that SQL can repeat: draws x states, fixed by configuration."""
    from .bindings import table

    states = table(spark, sf, "nation").select("n_nationkey")
    long = states.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return long.select("draw", F.col("n_nationkey").cast("string").alias("state"), ((7 * F.col("draw") + 3 * F.col("n_nationkey")) % 4).alias("w"))


def draw_means(spark, sf):
    """Weighted means of score and outcome per draw: loans are reduced to states before draws multiply them."""
    per_state = scored(spark, sf, "Y", "ProjectState").where(F.col("role").isin("crisis", "oot")).groupBy("role", F.col("ProjectState").alias("state")).agg(
        F.count("*").alias("n"), F.sum("p").alias("p"), F.sum("Y").alias("y")
    )
    rows = per_state.join(draw_schedule(spark, sf), "state").groupBy("role", "draw").agg(
        (F.sum(F.col("w") * F.col("p")) / F.sum(F.col("w") * F.col("n"))).alias("with_rate"),
        (F.sum(F.col("w") * F.col("y")) / F.sum(F.col("w") * F.col("n"))).alias("recorded"),
    )
    return rows.unpivot(["role", "draw"], ["with_rate", "recorded"], "variant", "value")


@query(
    "c07_paired_difference",
    with_tables("scored") + f", {DRAW_SQL}, dr as ({_DRAW_RATES}) "
    "select a.role, a.draw, round(a.value - b.value, 6) as difference from dr a join dr b on a.role = b.role and a.draw = b.draw "
    "and a.variant = 'with_rate' and b.variant = 'recorded'",
)
def paired_difference(spark, sf):
    out = linking.paired_difference(draw_means(spark, sf), "variant", "with_rate", "recorded", ["role", "draw"])
    return out.withColumns(_r("difference"))


@query(
    "c08_key_set_equality",
    with_tables("elig") + """
    , a as (select distinct role, loan_type, ProjectState as state from elig where year <= 1998),
    b as (select distinct role, loan_type, ProjectState as state from elig where year >= 1998)
    select *, 'draws' as missing_in from (select * from a except select * from b)
    union all select *, 'point' from (select * from b except select * from a)""",
)
def key_set_equality(spark, sf):
    rows = loans(spark, sf).withColumn("state", F.col("ProjectState"))
    keys = ["role", "loan_type", "state"]
    return linking.key_set_difference(rows.where("year <= 1998"), rows.where("year >= 1998"), keys)


# ---- D: time series, ranking, sweeps --------------------------------------------------------


@query(
    "d01_gap_filled_calendar",
    with_tables("panel") + "select g.state, cast(g.month as int) as month, u.u from grid g left join useries u using (state, month)",
)
def gap_filled_calendar(spark, sf):
    return panel.gap_filled(monthly_series(spark, sf))


@query("d02_horizon_change", with_tables("panel") + "select ProjectState as state, month, u0, du from panel")
def horizon_change(spark, sf):
    out = panel.horizon_change(panel.gap_filled(monthly_series(spark, sf)), "u", TEST.horizon_months, "du")
    return out.select("state", "month", F.col("u").alias("u0"), "du")


@query("d03_path_peak", with_tables("panel") + "select ProjectState as state, month, peak_du from panel")
def path_peak(spark, sf):
    out = panel.path_peak(panel.gap_filled(monthly_series(spark, sf)), "u", TEST.horizon_months, "peak_du")
    return out.select("state", "month", "peak_du")


@query("d04_log_growth", with_tables("panel") + "select ProjectState as state, month, round(h0, 6) as h0, round(dh, 6) as dh from panel")
def log_growth(spark, sf):
    return computed_panel(spark, sf).select(F.col("ProjectState").alias("state"), "month", F.round("h0", 6).alias("h0"), F.round("dh", 6).alias("dh"))


@query("d05_window_completeness", with_tables("panel") + "select ProjectState as state, month, macro_complete from panel")
def window_completeness(spark, sf):
    return computed_panel(spark, sf).select(F.col("ProjectState").alias("state"), "month", "macro_complete")


@query(
    "d06_fixed_scenarios",
    with_tables("scenario") + """select ProjectState as state, scenario, round(u0, 6) as u0, round(du, 6) as du, round(peak_du, 6) as peak_du,
    round(h0, 6) as h0, round(dh, 6) as dh from scenario""",
)
def fixed_scenarios(spark, sf):
    out = panel.scenario_paths(monthly_series(spark, sf), with_quarter(quarterly_series(spark, sf)), TEST)
    return out.select(F.col("ProjectState").alias("state"), "scenario", *[F.round(c, 6).alias(c) for c in ("u0", "du", "peak_du", "h0", "dh")])


@query(
    "d07_series_coverage",
    with_tables("series") + """
    select 'u' as series, state, count(*) as cells, count(distinct month) as periods, min(month) as first_period, max(month) as last_period,
      count(*) - count(distinct month) as duplicates, max(month) - min(month) + 1 - count(distinct month) as gaps,
      (select count(distinct state) = 25 from useries) as all_states_present from useries group by state
    union all select 'hpi', state, count(*), count(distinct quarter), min(quarter), max(quarter), count(*) - count(distinct quarter),
      max(quarter) - min(quarter) + 1 - count(distinct quarter), (select count(distinct state) = 25 from hseries) from hseries group by state""",
)
def series_coverage(spark, sf):
    u = panel.series_coverage(monthly_series(spark, sf), "state", "month", 25)
    h = panel.series_coverage(with_quarter(quarterly_series(spark, sf)), "state", "quarter", 25)
    return u.select(F.lit("u").alias("series"), "*").unionByName(h.select(F.lit("hpi").alias("series"), "*"))


@query(
    "d08_lowest_fraction",
    with_tables("scored") + """
    , rk as (select role, row_id, p, Y, row_number() over (order by p, row_id) as rn, count(*) over () as n from scored where role = 'oot')
    select row_id, p, Y from rk where rn <= floor(0.7::double * n)""",
)
def lowest_fraction(spark, sf):
    rows = scored(spark, sf).where("role = 'oot'").select("p", "row_id", "Y")
    return ordered.lowest_fraction(rows, ["p", "row_id"], TEST.accept_fraction)


@query(
    "d09_tie_group_sweep",
    with_tables("scored") + """
    , g as (select role, p, cast(sum(Y) as bigint) as pos, cast(sum(1 - Y) as bigint) as neg from scored group by 1, 2)
    select role, p, pos, neg, cast(sum(pos) over (partition by role order by p desc) as bigint) as cumpos,
      cast(sum(neg) over (partition by role order by p desc) as bigint) as cumneg from g""",
)
def tie_group_sweep(spark, sf):
    from ..operators import metrics

    return metrics.tie_sweep(scored(spark, sf), ["role"])
