"""Registered queries: preprocessing, drift and support (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CATEGORICAL, MACRO, NUMERIC
from ..operators import design, drift, metrics
from .bindings import TEST
from .catalog import query
from .inputs import loans, matched, scenarios, scored
from .oracle_base import with_tables

FEATURES = (*NUMERIC, "TermInMonths")
LATER = "role in ('crisis', 'oot')"


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


_CONTRACT = (
    "med as (" + " union all ".join(
        f"select '{c}' as feature, coalesce(quantile_cont({c}::double, 0.5), 0) as median from elig where role = 'train'" for c in FEATURES
    ) + "), contract as (" + " union all ".join(
        f"select '{c}' as feature, (select median from med where feature = '{c}') as median, "
        f"avg(coalesce({c}, (select median from med where feature = '{c}'))) as mean, "
        f"case when stddev_pop(coalesce({c}, (select median from med where feature = '{c}'))) < 1e-12 then 1 "
        f"else stddev_pop(coalesce({c}, (select median from med where feature = '{c}'))) end as scale from elig where role = 'train'"
        for c in FEATURES
    ) + ")"
)


@query("f01_numeric_contract", with_tables("elig") + f", {_CONTRACT} select feature, round(median, 6) as median, round(mean, 6) as mean, round(scale, 6) as scale from contract")
def numeric_contract(spark, sf):
    return _rounded(design.numeric_contract(loans(spark, sf, *FEATURES).where("role = 'train'"), FEATURES), "median", "mean", "scale")


_MAP = (
    "pmap as (select feature, level, training_n, training_n / total as frequency, "
    "case when feature <> 'ProjectState' and training_n / total < 0.001 then 'Other' else level end as pooled_level from ("
    + " union all ".join(
        f"select '{c}' as feature, {c} as level, count(*) as training_n, (select count(*)::double from elig where role = 'train') as total "
        "from elig where role = 'train' group by 2" for c in CATEGORICAL
    ) + "))"
)


@query("f02_frequency_pooling", with_tables("elig") + f", {_MAP} select feature, level, training_n, round(frequency, 6) as frequency, pooled_level from pmap")
def frequency_pooling(spark, sf):
    out = design.pooling_map(loans(spark, sf, *CATEGORICAL).where("role = 'train'"), CATEGORICAL, TEST.pooling_threshold, TEST.pooling_exempt)
    return _rounded(out, "frequency")


@query(
    "f03_apply_pooling",
    with_tables("elig") + f", {_MAP} " + " union all ".join(
        f"select e.role, '{c}' as feature, coalesce(m.pooled_level, case when exists(select 1 from pmap where feature = '{c}' and pooled_level = 'Other') "
        f"then 'Other' else '__unseen_not_fitted__' end) as pooled, count(*) as n from elig e left join pmap m on m.feature = '{c}' and m.level = e.{c} "
        "group by 1, 3" for c in ("BusinessType", "ProjectState", "naics2")
    ),
)
def apply_pooling(spark, sf):
    features = ["BusinessType", "ProjectState", "naics2"]
    rows = loans(spark, sf, *features)
    mapping = design.pooling_map(rows.where("role = 'train'"), features, TEST.pooling_threshold, TEST.pooling_exempt)
    pooled = design.apply_pooling(rows, mapping, features)
    from ..functions.shapes import stacked

    return stacked(pooled, ["role"], ["feature", "pooled"], [(c, F.col(c)) for c in features]).groupBy("role", "feature", "pooled").agg(F.count("*").alias("n"))


_DESIGN_NUM, _DESIGN_CAT = ("log_approval", "guarantee_share", "log_jobs"), ("loan_type", "size_band", "age_group")


def small_design(spark, sf, *keys, numeric=_DESIGN_NUM, categorical=_DESIGN_CAT):
    rows = loans(spark, sf, *keys, *numeric, *categorical)
    return rows, design.fit_design(rows.where("role = 'train'"), numeric, categorical, TEST.pooling_threshold)


_DESIGN_LONG = (
    "dl as (" + " union all ".join(
        [f"select row_id, role, 'intercept' as col_name, 1.0::double as val from elig"]
        + [f"select row_id, role, '{c}', (coalesce({c}, (select median from contract where feature = '{c}')) - (select mean from contract where feature = '{c}')) "
           f"/ (select scale from contract where feature = '{c}') from elig" for c in _DESIGN_NUM]
        + [f"select row_id, role, '{c}__missing', case when {c} is null then 1.0 else 0.0 end from elig" for c in _DESIGN_NUM]
        + [f"select e.row_id, e.role, '{c}_' || e.{c}, 1.0 from elig e where e.{c} in (select pooled_level from pmap where feature = '{c}') "
           f"and e.{c} > (select min(pooled_level) from pmap where feature = '{c}')" for c in _DESIGN_CAT]
    ) + ")"
)
_MAP_SMALL = _MAP.replace("select 'ProcessingMethod' as feature", "select 'size_band' as feature, size_band as level, count(*) as training_n, (select count(*)::double from elig where role = 'train') as total "
                          "from elig where role = 'train' group by 2 union all select 'age_group' as feature, age_group as level, count(*) as training_n, (select count(*)::double from elig where role = 'train') as total "
                          "from elig where role = 'train' group by 2 union all select 'ProcessingMethod' as feature")


@query(
    "f04_design_long_form",
    with_tables("elig") + f", {_CONTRACT}, {_MAP_SMALL}, {_DESIGN_LONG} select role, col_name, count(*) as n, round(sum(val), 4) as total, round(sum(val * val), 4) as squares "
    "from dl where val <> 0 and col_name in (select col_name from dl where role = 'train' group by 1 having sum(abs(val)) > 0) group by 1, 2",
)
def design_long_form(spark, sf):
    rows, fitted = small_design(spark, sf)
    long = design.design_long(rows, fitted, ["role"])  # entries are only counted and summed: no row needs its name
    return long.groupBy("role", F.col("column").alias("col_name")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum(F.col("value") * F.col("value")), 4).alias("squares")
    )


@query(
    "f05_gram_matrix",
    with_tables("elig") + f", {_CONTRACT}, {_MAP_SMALL}, {_DESIGN_LONG}, tr as (select * from dl where role = 'train') "
    "select i.col_name as row_name, j.col_name as col_name, round(sum(i.val * j.val) / (select count(*) from elig where role = 'train'), 6) as value "
    "from tr i join tr j using (row_id) group by 1, 2 having round(sum(i.val * j.val) / (select count(*) from elig where role = 'train'), 6) <> 0",
)
def gram_matrix(spark, sf):
    rows, fitted = small_design(spark, sf)
    gram = design.gram_matrix(fitted.rows(rows.where("role = 'train'"), []), len(fitted.columns))
    cells = [(a, b, float(gram[i, j])) for i, a in enumerate(fitted.columns) for j, b in enumerate(fitted.columns)]
    out = spark.createDataFrame(cells, "row_name string, col_name string, value double")
    return _rounded(out, "value").where("value <> 0")


@query("f06_rank_revealing_selection")
def rank_revealing_selection(spark, sf):
    rows = loans(spark, sf, "log_approval", "guarantee_share", "ProjectState", "loan_type").withColumn("share_copy", F.col("guarantee_share") * 2)
    train = rows.where("role = 'train'")
    fitted = design.fit_design(train, ["log_approval", "guarantee_share", "share_copy"], ["ProjectState", "loan_type"])
    kept = set(fitted.keep)
    return spark.createDataFrame(
        [(n, i in kept, len(fitted.keep), len(fitted.names)) for i, n in enumerate(fitted.names)],
        "column_name string, kept boolean, rank int, full_columns int",
    )


_SUPPORT_NUM, _SUPPORT_CAT = ("log_approval", "log_jobs", "TermInMonths"), ("ProjectState", "BusinessType", "naics2")


@query(
    "f07_training_support",
    with_tables("elig") + " union all ".join(
        [f"select role, '{c}' as feature, count(*) as n, count(*) - count({c}) as missing, "
         f"count(*) filter ({c} < (select min({c}) from elig where role = 'train') or {c} > (select max({c}) from elig where role = 'train')) as outside_train_range, "
         f"0::bigint as unseen_category from elig where {LATER} group by 1" for c in _SUPPORT_NUM]
        + [f"select role, '{c}', count(*), 0, 0, count(*) filter ({c} not in (select {c} from elig where role = 'train')) from elig where {LATER} group by 1" for c in _SUPPORT_CAT]
    ),
)
def training_support(spark, sf):
    rows = loans(spark, sf, *_SUPPORT_NUM, *_SUPPORT_CAT)
    return design.support_report(rows.where("role = 'train'"), rows.where(LATER), _SUPPORT_NUM, _SUPPORT_CAT, ["role"])


@query(
    "f08_preprocessing_counts",
    with_tables("elig") + f", {_MAP} " + " union all ".join(
        [f"select role as cohort, '{c}' as feature, count(*) as n, count(*) - count({c}) as missing_n, 0::bigint as unseen_n, "
         f"'training median plus missing flag' as unseen_action from elig where {LATER} group by 1" for c in NUMERIC]
        + [f"select role, '{c}', count(*), count(*) filter ({c} = '__missing__'), count(*) filter ({c} not in (select level from pmap where feature = '{c}')), "
           f"case when exists(select 1 from pmap where feature = '{c}' and pooled_level = 'Other') then 'fitted Other' else 'zero one-hot vector' end "
           f"from elig where {LATER} group by 1" for c in CATEGORICAL]
    ),
)
def preprocessing_counts(spark, sf):
    rows = loans(spark, sf, *NUMERIC, *CATEGORICAL)
    mapping = design.pooling_map(rows.where("role = 'train'"), CATEGORICAL, TEST.pooling_threshold, TEST.pooling_exempt)
    later = rows.where(LATER).withColumn("cohort", F.col("role"))
    return design.preprocessing_counts(later, mapping, NUMERIC, CATEGORICAL, ["cohort"])


_F9 = ("u0", "du", "h0", "dh")
_F9_OUT = {
    scope: {c: f"coalesce(s.{c} < {side}.lo_{c} or s.{c} > {side}.hi_{c}, false)" for c in _F9}
    for scope, side in (("state_specific", "b"), ("pooled_global", "g"))
}


def _f9_sql() -> str:
    bounds = ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in _F9)
    head = with_tables("matched", "scenario") + (
        f", b as (select ProjectState, {bounds} from matched where role = 'train' group by 1), g as (select {bounds} from matched where role = 'train'), "
        "x as (select s.scenario, e.GrossApproval as ead"
    )
    for scope, flags in _F9_OUT.items():
        for c, e in flags.items():
            head += f", {e} as {scope}_{c}"
        head += ", " + " or ".join(flags.values()) + f" as {scope}_any_numeric"
    head += " from elig e join scenario s using (ProjectState) left join b using (ProjectState) cross join g where e.role = 'reference') "
    return head + " union all ".join(
        f"select scenario, '{scope}' as scope, '{c}' as feature, count(*) filter ({scope}_{c}) as flagged_loan_n, "
        f"round(count(*) filter ({scope}_{c}) / count(*)::double, 6) as flagged_fraction, round(coalesce(sum(ead) filter ({scope}_{c}), 0), 2) as flagged_approval, "
        "count(*) as n from x group by 1"
        for scope in _F9_OUT for c in (*_F9, "any_numeric")
    )


@query("f09_scenario_support", _f9_sql())
def scenario_support(spark, sf):
    rows = matched(spark, sf)
    out = drift.scenario_support(rows.where("role = 'train'"), rows.where("role = 'reference'").drop("month", "macro_complete"), scenarios(spark, sf), MACRO)
    return out.withColumns({"flagged_fraction": F.round("flagged_fraction", 6), "flagged_approval": F.round("flagged_approval", 2)})


def _psi_numeric(c: str) -> str:
    cuts = (
        f"(select list_sort(list_distinct(quantile_cont({c}::double, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) from elig where role = 'train')"
    )
    bin_sql = f"case when {c} is null then -1 else len(list_filter((select inner_cuts from k), lambda v: v <= {c})) end"
    return (
        f"select feature, cohort, train_n, n, round(sum((b / sb - a / sa) * ln((b / sb) / (a / sa))), 6) as psi from ("
        f"select *, sum(a) over (partition by cohort) as sa, sum(b) over (partition by cohort) as sb from ("
        f"with k as (select list_slice(q, 2, len(q) - 1) as inner_cuts from (select {cuts} as q)), "
        f"l as (select {bin_sql} as bin, count(*) as a from elig where role = 'train' group by 1), "
        f"r as (select role as cohort, {bin_sql} as bin, count(*) as b from elig where {LATER} group by 1, 2), "
        "t as (select cohort, sum(b) as n from r group by 1), "
        "grid as (select t.cohort, t.n, unnest(range(-1, len((select inner_cuts from k)) + 1)) as bin from t) "
        f"select '{c}' as feature, g.cohort, cast((select sum(a) from l) as bigint) as train_n, cast(g.n as bigint) as n, "
        "greatest(coalesce(l.a, 0) / (select sum(a) from l)::double, 1e-6) as a, greatest(coalesce(r.b, 0) / g.n::double, 1e-6) as b "
        "from grid g left join l using (bin) left join r on r.cohort = g.cohort and r.bin = g.bin)) group by all"
    )


def _psi_categorical(c: str) -> str:
    return (
        f"select feature, cohort, train_n, n, round(sum((b / sb - a / sa) * ln((b / sb) / (a / sa))), 6) as psi from ("
        f"select *, sum(a) over (partition by cohort) as sa, sum(b) over (partition by cohort) as sb from ("
        f"with l as (select {c} as level, count(*) as a from elig where role = 'train' group by 1 union all select '__unseen__', 0), "
        f"r as (select role as cohort, case when {c} in (select level from l) then {c} else '__unseen__' end as level, count(*) as b from elig where {LATER} group by 1, 2), "
        "t as (select cohort, sum(b) as n from r group by 1) "
        f"select '{c}' as feature, t.cohort, cast((select sum(a) from l) as bigint) as train_n, cast(t.n as bigint) as n, "
        "greatest(l.a / (select sum(a) from l)::double, 1e-6) as a, greatest(coalesce(r.b, 0) / t.n::double, 1e-6) as b "
        "from t cross join l left join r on r.cohort = t.cohort and r.level = l.level)) group by all"
    )


_PSI_NUM, _PSI_CAT = ("log_approval", "guarantee_share", "TermInMonths"), ("BusinessType", "naics2", "age_group")


@query("f10_numeric_stability", with_tables("elig") + " union all ".join(_psi_numeric(c) for c in _PSI_NUM))
def numeric_stability(spark, sf):
    rows = loans(spark, sf, *_PSI_NUM).withColumn("cohort", F.col("role"))
    return _rounded(drift.numeric_psi(rows.where("role = 'train'"), rows.where(LATER), _PSI_NUM, "cohort"), "psi")


@query("f11_categorical_stability", with_tables("elig") + " union all ".join(_psi_categorical(c) for c in _PSI_CAT))
def categorical_stability(spark, sf):
    rows = loans(spark, sf, *_PSI_CAT).withColumn("cohort", F.col("role"))
    return _rounded(drift.categorical_psi(rows.where("role = 'train'"), rows.where(LATER), _PSI_CAT, "cohort"), "psi")


@query(
    "f12_drift_table",
    with_tables("elig") + " union all ".join([_psi_numeric(c) for c in (*NUMERIC, "TermInMonths")] + [_psi_categorical(c) for c in CATEGORICAL]),
)
def drift_table(spark, sf):
    rows = loans(spark, sf, *FEATURES, *CATEGORICAL).withColumn("cohort", F.col("role"))
    return _rounded(drift.drift_table(rows.where("role = 'train'"), rows.where(LATER), (*NUMERIC, "TermInMonths"), CATEGORICAL, "cohort"), "psi")


CUTS_SQL = (
    "k as (select list_slice(q, 2, len(q) - 1) as cuts from (select list_sort(list_distinct(quantile_cont(p, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) as q "
    "from scored where role = 'train'))"
)


@query(
    "f13_quantile_binning",
    with_tables("scored") + f", {CUTS_SQL} select role, cast(len(list_filter((select cuts from k), lambda v: v <= p)) as int) as bin, count(*) as n, min(p) as lowest, max(p) as highest "
    "from scored group by 1, 2",
)
def quantile_binning(spark, sf):
    from ..operators.ordered import bin_index

    rows = scored(spark, sf)
    cuts = metrics.training_cuts(rows.where("role = 'train'"), "p")
    binned = rows.withColumn("_cuts", cuts.scalar()).withColumn("bin", bin_index(F.col("p"), F.col("_cuts")))
    return binned.groupBy("role", "bin").agg(F.count("*").alias("n"), F.min("p").alias("lowest"), F.max("p").alias("highest"))
