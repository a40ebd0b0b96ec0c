"""Registered queries: evaluation, uncertainty, losses and stress (H)."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from ..config import GROUP_KEYS
from ..operators import attempts, bootstrap, comparison, linking, loss, metrics, models, ordered, paired, panel
from ..operators.design import Design
from ..operators.ordered import bin_index
from ..session import staged
from .bindings import TEST
from .catalog import query
from .inputs import STRESSED_ON, complete, loans, scenarios, scored, stressed
from .oracle_base import with_tables
from .queries_design import CUTS_SQL, LATER
from .queries_panels import _DRAW_RATES, DRAW_SQL, draw_means, draw_schedule
from .queries_rows import grouped_sql, severity_sql


def _rounded(df, digits=6, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_SWEEP = (
    ", g as (select role, p, sum(Y)::double as pos, sum(1 - Y)::double as neg from scored group by 1, 2), "
    "sw as (select *, sum(pos) over (partition by role order by p desc) as cumpos, sum(neg) over (partition by role order by p desc) as cumneg, "
    "sum(pos) over (partition by role) as tp, sum(neg) over (partition by role) as tn from g) "
)


@query("h01_auc", with_tables("scored") + _SWEEP + "select role, cast(max(tp) as bigint) as events, cast(max(tn) as bigint) as non_events, "
       "round(sum(pos * (tn - cumneg + 0.5 * neg)) / (max(tp) * max(tn)), 6) as auc from sw group by 1")
def auc(spark, sf):
    return _rounded(metrics.ranking_metrics(scored(spark, sf, "Y"), ["role"]), 6, "auc").drop("average_precision")


@query("h02_average_precision", with_tables("scored") + _SWEEP + "select role, round(sum(pos / tp * cumpos / (cumpos + cumneg)), 6) as average_precision from sw group by 1")
def average_precision(spark, sf):
    return _rounded(metrics.ranking_metrics(scored(spark, sf, "Y"), ["role"]), 6, "average_precision").select("role", "average_precision")


@query("h03_brier", with_tables("scored") + "select role, count(*) as n, round(avg((Y - p) * (Y - p)), 6) as brier from scored group by 1")
def brier(spark, sf):
    return _rounded(metrics.brier(scored(spark, sf, "Y"), ["role"]), 6, "brier")


@query("h04_calibration_line")
def calibration_line(spark, sf):
    return models.calibration_table(scored(spark, sf, "Y", "ProjectState"), "role", "ProjectState")


@query(
    "h05_score_validity",
    with_tables("scored") + """, v as (select *, case when row_id like '%7' then null when row_id like '%13' then 1.5 else p end as s from scored)
    select role, count(*) as n, count(*) filter (s is null) as non_finite, count(*) filter (s < 0 or s > 1) as out_of_range, min(Y) = max(Y) as one_class from v group by 1""",
)
def score_validity(spark, sf):
    rows = scored(spark, sf, "row_id", "Y").withColumn("s", F.when(F.col("row_id").endswith("7"), None).when(F.col("row_id").endswith("13"), 1.5).otherwise(F.col("p")))
    return metrics.score_validity(rows, ["role"], "s")


@query("h06_cluster_bootstrap")
def cluster_bootstrap(spark, sf):
    draws = bootstrap.metric_draws(scored(spark, sf, "Y", "ProjectState").where(LATER), "role", "ProjectState", draws=TEST.draws, seed=TEST.seed)
    return bootstrap.metric_intervals(draws)


_BINS = (
    f", {CUTS_SQL}, {DRAW_SQL}, bn as (select role, ProjectState as state, Y, p, cast(len(list_filter((select cuts from k), lambda v: v <= p)) as int) + 1 as bin from scored where {LATER}), "
    "nb as (select unnest(range(1, len((select cuts from k)) + 2)) as bin), cohorts as (select distinct role from bn), "
    "pt as (select c.role, cast(nb.bin as int) as bin, count(b.p) as n, cast(coalesce(sum(b.Y), 0) as bigint) as events, round(avg(b.p), 6) as mean_predicted, round(avg(b.Y), 6) as recorded_rate "
    "from cohorts c cross join nb left join bn b on b.role = c.role and b.bin = nb.bin group by 1, 2), "
    "dr as (select role, bin, draw, case when sum(w) > 0 then sum(w * Y) / sum(w) end as v from bn join dw using (state) group by 1, 2, 3), "
    "iv as (select role, bin, count(v) as effective_draws, round(quantile_cont(v, 0.025), 6) as lower, round(quantile_cont(v, 0.975), 6) as upper from dr group by 1, 2) "
)


@query("h07_calibration_bins", with_tables("scored") + _BINS + "select pt.*, iv.lower, iv.upper, iv.effective_draws from pt left join iv using (role, bin)")
def calibration_bins(spark, sf):
    rows = scored(spark, sf, "Y", "ProjectState")
    train, later = rows.where("role = 'train'"), rows.where(LATER)
    point = metrics.calibration_table(train, later, ["role"])
    cuts = metrics.training_cuts(train, "p")
    binned = later.withColumn("_c", cuts.scalar()).select("role", F.col("ProjectState").alias("state"), "Y", (bin_index(F.col("p"), F.col("_c")) + 1).alias("bin"))
    bands = bootstrap.bin_bands(binned, draw_schedule(spark, sf).withColumnRenamed("w", "weight"), ["role"])
    out = point.join(bands.drop("undefined_draws"), ["role", "bin"], "left").drop("lower_edge", "upper_edge")
    return _rounded(out, 6, "mean_predicted", "recorded_rate", "lower", "upper")


@query(
    "h08_paired_differences",
    with_tables("scored") + f", {DRAW_SQL}, dr as ({_DRAW_RATES}), df as (select a.role, a.value - b.value as v from dr a join dr b on a.role = b.role and a.draw = b.draw "
    "and a.variant = 'with_rate' and b.variant = 'recorded') select role, round(quantile_cont(v, 0.025), 6) as lower, round(quantile_cont(v, 0.975), 6) as upper, "
    "count(v) as effective_draws, count(*) - count(v) as undefined_draws from df group by 1",
)
def paired_differences(spark, sf):
    gaps = linking.paired_difference(draw_means(spark, sf), "variant", "with_rate", "recorded", ["role", "draw"])
    return _rounded(comparison.percentile_interval(gaps, ["role"], "difference"), 6, "lower", "upper")


_SECOND = "(0.7e0 * p + 0.3e0 * coalesce(guarantee_share, 0.5e0))"
_METRICS = ("auc", "average_precision", "brier")
_MODEL_SQL = (
    f", {DRAW_SQL}, dp as (select * from dw union all select distinct -1, state, 1 from dw), "
    f"md as (select role, ProjectState as state, Y, 'first' as score, p from scored where {LATER} union all select role, ProjectState, Y, 'second', {_SECOND} from scored where {LATER}), "
    "mg as (select role, score, draw, p, sum(w * Y)::double as pos, sum(w * (1 - Y))::double as neg from md join dp using (state) group by all), "
    "mw as (select *, sum(neg) over up - neg as below, sum(pos) over down as cumpos, sum(pos + neg) over down as cumall from mg "
    "window up as (partition by role, score, draw order by p), down as (partition by role, score, draw order by p desc)), "
    "mt as (select role, score, draw, sum(pos) as tp, sum(neg) as tn, sum(pos * (below + 0.5 * neg)) as a, sum(coalesce(pos * cumpos / nullif(cumall, 0), 0)) as ap, "
    "sum(pos * (1 - p) ** 2 + neg * p ** 2) as b from mw group by all), "
    "mm as (" + " union all ".join(
        f"select role, score, draw, '{m}' as metric, case when tp > 0 and tn > 0 then {e} end as v from mt"
        for m, e in (("auc", "a / (tp * tn)"), ("average_precision", "ap / tp"), ("brier", "b / (tp + tn)"))
    ) + ")"
)
_BOUNDS = "round(quantile_cont(v, 0.025), 6) as lower, round(quantile_cont(v, 0.975), 6) as upper, count(v) as effective_draws, count(*) - count(v) as undefined_draws"


def _two_models(spark, sf):
    rows = scored(spark, sf).where(LATER).withColumnsRenamed({"p": "first"}).withColumn("second", F.expr(_SECOND.replace("p +", "first +").replace("e0", "D")))
    return paired.model_draws(rows, ["first", "second"], "role", "ProjectState", draw_schedule(spark, sf).withColumnRenamed("w", "weight"), metrics=_METRICS)


@query(
    "h06b_supplied_draws",
    with_tables("scored") + _MODEL_SQL + f", iv as (select role as cohort, score, metric, {_BOUNDS} from mm where draw >= 0 group by all) "
    "select iv.*, round(mm.v, 6) as value from iv join mm on mm.role = iv.cohort and mm.score = iv.score and mm.metric = iv.metric and mm.draw = -1",
)
def supplied_draws(spark, sf):
    drawn = staged(_two_models(spark, sf))
    keys = ["cohort", "score", "metric"]
    out = drawn.where("draw = -1").select(*keys, "value").join(comparison.percentile_interval(drawn.where("draw >= 0"), keys), keys)
    return _rounded(out, 6, "value", "lower", "upper")


@query(
    "h08b_metric_differences",
    with_tables("scored") + _MODEL_SQL + ", df as (select a.role as cohort, a.metric, 'first' as \"left\", 'second' as \"right\", a.draw, a.v - b.v as v from mm a join mm b using (role, metric, draw) "
    f"where a.score = 'first' and b.score = 'second'), iv as (select cohort, metric, \"left\", \"right\", {_BOUNDS} from df where draw >= 0 group by all) "
    "select iv.*, round(df.v, 6) as value from iv join df using (cohort, metric) where df.draw = -1",
)
def metric_differences(spark, sf):
    out = paired.difference_intervals(staged(paired.metric_differences(_two_models(spark, sf), [("first", "second")])))
    return _rounded(out, 6, "value", "lower", "upper")


@query(
    "h09_percentile_interval",
    """with dr as (select event_type, user_id % 30 as draw, case when user_id % 7 = 0 then null else avg(value) end as v from events group by 1, 2, user_id % 7)
    select event_type, case when count(v) >= 2 then round(quantile_cont(v, 0.025), 6) end as lower, case when count(v) >= 2 then round(quantile_cont(v, 0.975), 6) end as upper,
    count(v) as effective_draws, count(*) - count(v) as undefined_draws from dr group by 1""",
)
def percentile_interval(spark, sf):
    from .bindings import table

    means = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 30).alias("draw"), (F.col("user_id") % 7).alias("m")).agg(F.avg("value").alias("v"))
    value = F.when(F.col("m") == 0, F.lit(float("nan"))).otherwise(F.col("v"))
    out = comparison.percentile_interval(means.select("event_type", value.alias("value")), ["event_type"])
    return _rounded(out, 6, "lower", "upper")


@query(
    "h10_combine_point_and_draws",
    with_tables("scored") + f", {DRAW_SQL}, dr as ({_DRAW_RATES}), pt as (select 'with_rate' as variant, role, avg(p) as value from scored where {LATER} group by 2 "
    f"union all select 'recorded', role, avg(Y) from scored where {LATER} group by 2) "
    "select pt.role, pt.variant, round(pt.value, 6) as value, round(quantile_cont(dr.value, 0.025), 6) as lower, round(quantile_cont(dr.value, 0.975), 6) as upper, "
    "count(dr.value) as effective_draws, 0::bigint as undefined_draws, 40 as attempted_draws, 40 as successful_draws from pt join dr on pt.role = dr.role and pt.variant = dr.variant group by pt.role, pt.variant, pt.value",
)
def combine_point_and_draws(spark, sf):
    point = scored(spark, sf, "Y", "ProjectState").where(LATER).groupBy("role").agg(F.avg("p").alias("with_rate"), F.avg("Y").alias("recorded"))
    long = point.unpivot(["role"], ["with_rate", "recorded"], "variant", "value")
    out = comparison.combine(long, staged(draw_means(spark, sf)), ["role", "variant"], attempted=40)
    return _rounded(out, 6, "value", "lower", "upper")


@query(
    "h11_loss_allocation",
    with_tables("scored") + ", " + severity_sql() + """
    select e.role, count(*) as n, round(sum(p * lgd * GrossApproval), 2) as expected_loss, round(sum(p * lgd * GrossApproval * guarantee_share), 2) as sponsor_loss,
    round(sum(p * lgd * GrossApproval * (1 - guarantee_share)), 2) as lender_loss from scored e join lgd l on l.variant = 'primary' and l.loan_type = e.loan_type and l.size_band = e.size_band
    where guarantee_share is not null group by 1""",
)
def loss_allocation(spark, sf):
    rows = scored(spark, sf, *loss.SEVERITY_INPUTS)
    severity = loss.severity_table(rows.where("role = 'train'"), TEST)
    out = loss.accepted_summary(rows, severity, keys=["role"])
    return _rounded(out.select("role", "n", "expected_loss", "sponsor_loss", "lender_loss"), 2, "expected_loss", "sponsor_loss", "lender_loss")


@query(
    "h12_acceptance_diagnostic",
    with_tables("scored") + ", " + severity_sql() + f""", rk as (select *, row_number() over (partition by role order by p, row_id) as rn, count(*) over (partition by role) as total from scored where {LATER})
    select e.role, count(*) as n, round(avg(Y), 6) as recorded_rate, round(avg(p), 6) as mean_pd, round(sum(GrossApproval), 2) as exposure, round(sum(p * lgd * GrossApproval), 2) as expected_loss,
    round(sum(p * lgd * GrossApproval * guarantee_share), 2) as sponsor_loss, round(sum(p * lgd * GrossApproval * (1 - guarantee_share)), 2) as lender_loss
    from rk e join lgd l on l.variant = 'primary' and l.loan_type = e.loan_type and l.size_band = e.size_band where rn <= floor(0.7::double * total) and guarantee_share is not null group by 1""",
)
def acceptance_diagnostic(spark, sf):
    rows = scored(spark, sf, "row_id", *loss.SEVERITY_INPUTS)
    severity = loss.severity_table(rows.where("role = 'train'"), TEST)
    needed = rows.select("role", "p", "row_id", "Y", "guarantee_share", "GrossApproval", "loan_type", "size_band")
    accepted = ordered.lowest_fraction(needed.where(LATER), ["p", "row_id"], TEST.accept_fraction, by=["role"])
    out = loss.accepted_summary(accepted, severity, keys=["role"])
    return _rounded(_rounded(out, 6, "recorded_rate", "mean_pd"), 2, "exposure", "expected_loss", "sponsor_loss", "lender_loss")


STRESS_SQL = (
    "st as (select e.*, s.scenario, 1 / (1 + exp(-(-1.9e0 + 0.9e0 * coalesce(e.guarantee_share, 0.5e0) - 0.12e0 * coalesce(e.InitialInterestRate, 4e0) "
    "+ 0.25e0 * (e.log_approval - 10) + 0.08e0 * s.u0 + 0.1e0 * s.du - 0.004e0 * s.dh))) as ps "
    "from elig e left join scenario s using (ProjectState) where e.role = 'reference')"
)
_SUMS = "avg(ps) as pd, count(*) as pd_n, count(guarantee_share) as loss_n, sum(GrossApproval) filter (guarantee_share is not null) as exposure" + "".join(
    f", sum(ps * lgd_{v} * GrossApproval) filter (guarantee_share is not null) as {v}_total, sum(ps * lgd_{v} * GrossApproval * guarantee_share) as {v}_sponsor, "
    f"sum(ps * lgd_{v} * GrossApproval * (1 - guarantee_share)) as {v}_lender" for v in loss.VARIANTS
)
PROJECTION_SQL = (
    STRESS_SQL + ", " + severity_sql() + ", lw as (select loan_type, size_band, " + ", ".join(f"max(lgd) filter (variant = '{v}') as lgd_{v}" for v in loss.VARIANTS)
    + " from lgd group by 1, 2), sl as (select * from st join lw using (loan_type, size_band)), tot as (" + grouped_sql("sl", _SUMS, keys="scenario") + "), proj as ("
    + " union all ".join(
        f"select scenario, group_name, group_value, '{v}' as lgd_variant, '{m}' as metric, {e} as value, pd_n, loss_n, exposure from tot where scenario = '{s}'"
        for s, variants in loss.PROJECTED for v in variants
        for m, e in (("pd", "pd"), ("expected_loss", f"{v}_total"), ("sponsor_loss", f"{v}_sponsor"), ("lender_loss", f"{v}_lender"), ("loss_rate", f"{v}_total / exposure"))
    ) + ")"
)
_ROUND_SQL = "case when metric in ('pd', 'loss_rate', 'pd_change_pp', 'loss_rate_change') then round(value, 6) else round(value, 2) end"


def _round_metric(df):
    small = F.col("metric").isin("pd", "loss_rate", "pd_change_pp", "loss_rate_change")
    return df.withColumns({"value": F.when(small, F.round("value", 6)).otherwise(F.round("value", 2)), "exposure": F.round("exposure", 2)})


PROJECTED_ON = tuple(dict.fromkeys((*loss.SEVERITY_INPUTS, *GROUP_KEYS, *STRESSED_ON)))


def projection(spark, sf):
    rows = loans(spark, sf, *PROJECTED_ON)
    severity = loss.severity_table(rows.where("role = 'train'"), TEST)
    return loss.projection_metrics(loss.projection_totals(stressed(spark, sf, *PROJECTED_ON), severity))


@query("h13_scenario_projection", with_tables("elig", "scenario") + f", {PROJECTION_SQL} select * replace ({_ROUND_SQL} as value, round(exposure, 2) as exposure) from proj")
def scenario_projection(spark, sf):
    return _round_metric(projection(spark, sf))


@query(
    "h14_scenario_difference",
    with_tables("elig", "scenario") + f""", {PROJECTION_SQL}, dif as (select a.group_name, a.group_value, case when a.metric = 'pd' then 'pd_change_pp' else a.metric || '_change' end as metric,
    (a.value - b.value) * case when a.metric = 'pd' then 100 else 1 end as value, a.pd_n, a.loss_n, round(a.exposure, 2) as exposure
    from proj a join proj b using (group_name, group_value, metric) where a.scenario = 'adverse' and b.scenario = 'baseline' and a.lgd_variant = 'primary' and b.lgd_variant = 'primary')
    select * replace ({_ROUND_SQL} as value) from dif""",
)
def scenario_difference(spark, sf):
    return _round_metric(loss.scenario_difference(projection(spark, sf)))


@query("h15_drawwise_projection")
def drawwise_projection(spark, sf):
    return models.drawwise_example(complete(spark, sf).where("role = 'train'"), loans(spark, sf), scenarios(spark, sf), TEST)


# fixed refits of the stress scorecard, so that SQL can repeat them: (attempt, factor of all coefficients); attempt 2 failed
_MACRO_CARD = ["guarantee_share", "InitialInterestRate", "log_approval", "u0", "du", "dh"]
STRESS_CARD = Design(
    _MACRO_CARD, [], {"guarantee_share": 0.5, "InitialInterestRate": 4.0, "log_approval": 10.0, "u0": 0.0, "du": 0.0, "dh": 0.0},
    {"guarantee_share": 0.0, "InitialInterestRate": 0.0, "log_approval": 10.0, "u0": 0.0, "du": 0.0, "dh": 0.0}, dict.fromkeys(_MACRO_CARD, 1.0), {},
)
STRESS_CARD.names = list(STRESS_CARD.parts())
STRESS_CARD.keep = [i for i, n in enumerate(STRESS_CARD.names) if not n.endswith("__missing")]
STRESS_BETA = np.array([-1.9, 0.9, -0.12, 0.25, 0.08, 0.1, -0.004])
REFITS = ((0, 0.9), (1, 1.05), (2, None), (3, 1.2), (5, 0.97), (8, 1.01))
_REFIT_KEYS = "scenario, lgd_variant, group_name, group_value, metric"
_DRAWN = "(values (-1, 1.0::double), " + ", ".join(f"({k}, {f}::double)" for k, f in REFITS if f) + ") as drawn(draw, factor)"
_REFIT_SQL = (
    PROJECTION_SQL.replace("select e.*, s.scenario, 1 / (1 + exp(-(-1.9e0", "select e.*, s.scenario, drawn.draw, 1 / (1 + exp(-drawn.factor * (-1.9e0")
    .replace("from elig e left join scenario s using (ProjectState) where", f"from elig e left join scenario s using (ProjectState) cross join {_DRAWN} where")
    .replace(grouped_sql("sl", _SUMS, keys="scenario"), grouped_sql("sl", _SUMS, keys="draw, scenario"))
    .replace("select scenario, group_name", "select draw, scenario, group_name")
    + f", bound as (select {_REFIT_KEYS}, quantile_cont(value, 0.025) as lower, quantile_cont(value, 0.975) as upper from proj where draw >= 0 group by all)"
    + f" select p.* exclude (draw), b.lower, b.upper from proj p join bound b using ({_REFIT_KEYS}) where draw = -1"
)


def _round_bounds(df):
    small = F.col("metric").isin("pd", "loss_rate")
    return _round_metric(df).withColumns({c: F.when(small, F.round(c, 6)).otherwise(F.round(c, 2)) for c in ("lower", "upper")})


@query(
    "h15b_refit_projection",
    with_tables("elig", "scenario") + f""", {_REFIT_SQL.rsplit(" select p.*", 1)[0]}, whole as (select p.*{_REFIT_SQL.rsplit(" select p.*", 1)[1]})
    select * replace ({_ROUND_SQL} as value, {_ROUND_SQL.replace('value', 'lower')} as lower, {_ROUND_SQL.replace('value', 'upper')} as upper, round(exposure, 2) as exposure),
        5::bigint as effective_draws, 0::bigint as undefined_draws, 6 as attempted_draws, 5 as successful_draws from whole""",
)
def refit_projection(spark, sf):
    rows = loans(spark, sf)
    stored = [(k, f is not None, None if f is None else [float(b) for b in f * STRESS_BETA], STRESS_CARD.columns) for k, f in REFITS]
    refits = spark.createDataFrame(stored, "attempt int, successful boolean, beta array<double>, columns array<string>")
    severity = loss.severity_table(rows.where("role = 'train'"), TEST)
    out = attempts.refit_projection(rows.where("role = 'reference'"), panel.complete_scenarios(scenarios(spark, sf)), STRESS_CARD, STRESS_BETA, refits, severity)
    return _round_bounds(out)


@query("h16_tree_projection")
def tree_projection(spark, sf):
    rows = loans(spark, sf, "log_jobs", "d", *PROJECTED_ON)
    severity = loss.severity_table(rows.where("role = 'train'"), TEST)
    model = models.boosted_trees(complete(spark, sf, "log_jobs", *PROJECTED_ON).where("role = 'train'"), models.TREE_FEATURES, TEST.seed)
    inputs = linking.apply_scenarios(rows.where("role = 'reference'"), panel.complete_scenarios(scenarios(spark, sf)))
    scored_trees = models.tree_scores(model, inputs)
    return loss.projection_metrics(loss.projection_totals(scored_trees, severity))


