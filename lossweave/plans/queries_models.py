"""Registered queries: models (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CATEGORICAL, NUMERIC
from ..operators import attempts, bootstrap, elastic, models
from ..operators.design import Design, fit_design
from ..session import scratch_path
from .bindings import TEST
from .catalog import query
from .inputs import loans, scored
from .oracle_base import with_tables
from .queries_rows import grouped_sql

_NUM, _CAT = ["log_approval", "guarantee_share", "log_jobs"], ["loan_type", "size_band"]
_FITTED_ON, _TREE_CAT = ("ProjectState", "Y", *_NUM, *_CAT), ("loan_type", "size_band", "age_group")

# a scorecard with fixed coefficients, so that SQL can repeat every step
CARD = Design(
    ["log_approval", "log_jobs", "InitialInterestRate"], ["loan_type", "age_group"],
    {"log_approval": 10.0, "log_jobs": 3.0, "InitialInterestRate": 4.0}, {"log_approval": 10.0, "log_jobs": 3.0, "InitialInterestRate": 4.0},
    {"log_approval": 0.5, "log_jobs": 0.8, "InitialInterestRate": 2.5},
    {"loan_type": ["revolving", "term", "unknown"], "age_group": ["change_of_ownership", "existing", "missing", "new", "unanswered"]},
)
CARD.names = list(CARD.parts())
CARD.keep = [i for i, n in enumerate(CARD.names) if not n.endswith("__missing")]
CARD_BETA = {
    "intercept": -1.1, "log_approval": 0.2, "log_jobs": -0.15, "InitialInterestRate": 0.12, "loan_type_term": 0.3, "loan_type_unknown": -0.2,
    "age_group_existing": -0.25, "age_group_missing": 0.1, "age_group_new": 0.4, "age_group_unanswered": 0.05,
}
BETA = [CARD_BETA[n] for n in CARD.columns]
_ETA = (
    "(-1.1::double + 0.2 * (coalesce(log_approval, 10) - 10) / 0.5 - 0.15 * (coalesce(log_jobs, 3) - 3) / 0.8 + 0.12 * (coalesce(InitialInterestRate, 4) - 4) / 2.5 "
    "+ case loan_type when 'term' then 0.3 when 'unknown' then -0.2 else 0 end "
    "+ case age_group when 'existing' then -0.25 when 'missing' then 0.1 when 'new' then 0.4 when 'unanswered' then 0.05 else 0 end)"
)
_CARD_SQL = f", cs as (select *, {_ETA} as eta from elig)"


def _train_data(spark, sf):
    train = loans(spark, sf, *_FITTED_ON).where("role = 'train'")
    design = fit_design(train, _NUM, _CAT, TEST.pooling_threshold)
    rows = design.rows(train, [F.col("ProjectState").alias("state"), "Y"])
    return design, models.LogitData(rows, len(design.columns))


@query("g01_clustered_logit")
def clustered_logit(spark, sf):
    design, data = _train_data(spark, sf)
    out = models.fit_clustered(data)
    rows = [(n, float(b), float(out.covariance[i, i] ** 0.5), out.fit.converged, out.fit.iterations)
            for i, (n, b) in enumerate(zip(design.columns, out.fit.beta))]
    return spark.createDataFrame(rows, "column_name string, coefficient double, clustered_se double, converged boolean, iterations int")


@query("g02_penalised_logit")
def penalised_logit(spark, sf):
    design, data = _train_data(spark, sf)
    return models.fit_rows(spark, "layer1", design.columns, models.fit_penalised(data))


@query("g03_elastic_net_grid")
def elastic_net_grid(spark, sf):
    rows = loans(spark, sf, *_FITTED_ON)
    train, tune = rows.where("role = 'train'"), rows.where("role = 'tune'")
    design = fit_design(train, _NUM, _CAT, TEST.pooling_threshold)
    table, _ = models.elastic_net_grid(models.labelled(design, train), models.labelled(design, tune), [0.001, 0.1, 10.0], [0.0, 0.5, 1.0])
    return table


@query("g04_boosted_trees")
def boosted_trees(spark, sf):
    rows = loans(spark, sf, "Y", *_NUM, *_TREE_CAT)
    model = models.boosted_trees(rows.where("role = 'train'"), _NUM, TEST.seed)
    scored_rows = models.tree_scores(model, rows.where("role in ('crisis', 'oot')"))
    return scored_rows.groupBy("role").agg(F.count("*").alias("n"), F.avg("p").alias("mean_predicted"), F.avg("Y").alias("recorded_rate"))


@query("g03b_elastic_net_path")
def elastic_net_path(spark, sf):
    """The full grid of 10 strengths and 5 ratios on all inputs, and the loss of each setting on the tuning years."""
    rows = loans(spark, sf, "ProjectState", "Y", *NUMERIC, *CATEGORICAL)
    train, tune = rows.where("role = 'train'"), rows.where("role = 'tune'")
    design = fit_design(train, list(NUMERIC), list(CATEGORICAL), TEST.pooling_threshold)
    carried = [F.col("ProjectState").alias("state"), "Y"]
    data, later = (models.LogitData(design.rows(part, carried), len(design.columns)) for part in (train, tune))
    strengths = [10.0 ** (-4 + 6 * k / 9) for k in range(10)]
    return elastic.selected_path(spark, data, later, elastic.grid(strengths, [0, 0.25, 0.5, 0.75, 1]))[0]


@query("g04b_stopped_trees")
def stopped_trees(spark, sf):
    rows = loans(spark, sf, "Y", *_NUM, *_TREE_CAT)
    model, rounds = models.stopped_trees(rows.where("role = 'train'"), rows.where("role = 'tune'"), _NUM, TEST.seed, limit=60)
    later = models.tree_scores(model, rows.where("role in ('crisis', 'oot')"))
    return later.groupBy("role").agg(
        F.count("*").alias("n"), F.avg("p").alias("mean_predicted"), F.avg("Y").alias("recorded_rate"), F.lit(rounds).alias("rounds"), F.lit(60).alias("limit")
    )


@query("g05_sigmoid_calibration")
def sigmoid_calibration(spark, sf):
    rows = scored(spark, sf, "Y", "ProjectState")
    line = models.calibration_table(rows.where("role = 'calibrate'"), "role", "ProjectState").first()
    frozen = rows.where("role in ('crisis', 'oot')").withColumn("q", models.calibrated(F.col("p"), line["calibration_intercept"], line["calibration_slope"]))
    return frozen.groupBy("role").agg(
        F.count("*").alias("n"), F.avg("p").alias("raw_mean"), F.avg("q").alias("calibrated_mean"), F.avg("Y").alias("recorded_rate"),
        F.lit(line["calibration_intercept"]).alias("intercept"), F.lit(line["calibration_slope"]).alias("slope"),
    )


@query(
    "g06_batch_scoring",
    with_tables("elig") + _CARD_SQL + """ select row_id, ProjectState as state, Y, round(1 / (1 + exp(-eta)), 6) as raw,
    round(1 / (1 + exp(-(-0.1::double + 0.9::double * eta))), 6) as calibrated from cs""",
)
def batch_scoring(spark, sf):
    rows = CARD.linear(loans(spark, sf), BETA).withColumn("_p", F.expr("1 / (1 + exp(-eta))"))
    return rows.select(
        "row_id", F.col("ProjectState").alias("state"), "Y", F.round("_p", 6).alias("raw"),
        F.round(models.calibrated(F.col("_p"), -0.1, 0.9), 6).alias("calibrated"),
    )


@query("g07_multiplier_draws")
def multiplier_draws(spark, sf):
    counts = loans(spark, sf, "ProjectState").where("role = 'train'").groupBy(F.col("ProjectState").alias("state")).agg(F.count("*").alias("n"))
    levels = bootstrap.cluster_levels(counts)
    schedule = bootstrap.draw_table(spark, levels, bootstrap.multiplier_draws(levels, TEST.refit_attempts, TEST.seed))
    return bootstrap.normalized_weights(schedule, counts)


@query(
    "g07b_counter_multipliers",
    with_tables("elig") + """, c as (select ProjectState as state, count(*) as n from elig where role = 'train' group by 1),
    d as (select cast(g as int) as draw, state, n, -ln((cast('0x' || substr(md5('%d/' || g || '/' || state), 1, 13) as bigint)::double + 0.5) / 4503599627370496.0::double) as w
        from c cross join (select unnest(range(0, %d)) as g))
    select draw, state, n, round(w * (sum(n) over (partition by draw)) / (sum(w * n) over (partition by draw)), 9) as weight from d""" % (TEST.seed, TEST.refit_attempts),
)
def counter_multipliers(spark, sf):
    counts = loans(spark, sf, "ProjectState").where("role = 'train'").groupBy(F.col("ProjectState").alias("state")).agg(F.count("*").alias("n"))
    out = bootstrap.normalized_weights(bootstrap.counter_multipliers(counts, TEST.refit_attempts, TEST.seed), counts)
    return out.withColumn("weight", F.round("weight", 9))


@query("g08_refit_bootstrap")
def refit_bootstrap(spark, sf):
    design, data = _train_data(spark, sf)
    schedule = bootstrap.multiplier_draws(data.levels, TEST.refit_attempts, TEST.seed)
    store = attempts.AttemptStore(spark, scratch_path(spark, "attempts"))
    terms = attempts.contract(design, {"tolerance": models.TOLERANCE, "rounds": models.MAX_ITERATIONS}, data.rows)
    point = models.fit_penalised(data)[0]
    attempts.refit_stored(store, "layer1", data, design.columns, schedule, terms, point.beta if point.converged else None)
    return store.rows("layer1").drop("contract", "weights")


def _association_sql() -> str:
    s = "1 / (1 + exp(-({})))"
    p = s.format("eta")
    parts = [
        f"select '{c}' as feature, count(*) as n, round(100 * avg({p} * (1 - {p})) * {b} / {sc}, 6) as value from cs where role = 'crisis'"
        for c, b, sc in (("log_approval", 0.2, 0.5), ("log_jobs", -0.15, 0.8), ("InitialInterestRate", 0.12, 2.5))
    ]
    for c, effects in (("loan_type", {"term": 0.3, "unknown": -0.2}), ("age_group", {"existing": -0.25, "missing": 0.1, "new": 0.4, "unanswered": 0.05})):
        base = f"eta - case {c} " + " ".join(f"when '{k}' then {v}" for k, v in effects.items()) + " else 0 end"
        parts += [
            f"select '{c}_{k}', count(*), round(100 * avg({s.format(base + f' + ({v})')} - {s.format(base)}), 6) from cs where role = 'crisis'" for k, v in effects.items()
        ]
    return with_tables("elig") + _CARD_SQL + " " + " union all ".join(parts)


@query("g09_average_associations", _association_sql())
def average_associations(spark, sf):
    out = models.average_associations(loans(spark, sf).where("role = 'crisis'"), CARD, BETA)
    return out.withColumn("value", F.round("value", 6))


@query(
    "g10_finite_change",
    with_tables("elig") + _CARD_SQL + ", dl as (select *, 100 * (1 / (1 + exp(-(eta + 0.12::double / 2.5::double))) - 1 / (1 + exp(-eta))) as delta from cs where role = 'reference') "
    + grouped_sql("dl", "count(*) as n, round(avg(delta), 6) as value"),
)
def finite_change(spark, sf):
    out = models.finite_change(loans(spark, sf).where("role = 'reference'"), CARD, BETA, "InitialInterestRate")
    return out.withColumn("value", F.round("value", 6))


@query(
    "g11_linear_attribution",
    with_tables("elig") + """, smp as (select * from elig where role = 'oot')
    select 'log_approval' as feature, count(*) as n, round(avg(abs(0.2 * (coalesce(log_approval, 10) - 10) / 0.5)), 6) as value from smp
    union all select 'log_jobs', count(*), round(avg(abs(-0.15 * (coalesce(log_jobs, 3) - 3) / 0.8)), 6) from smp
    union all select 'InitialInterestRate', count(*), round(avg(abs(0.12 * (coalesce(InitialInterestRate, 4) - 4) / 2.5)), 6) from smp""",
)
def linear_attribution(spark, sf):
    out = models.linear_attribution(loans(spark, sf).where("role = 'oot'"), CARD, BETA)
    return out.withColumn("value", F.round("value", 6))
