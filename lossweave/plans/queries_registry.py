"""Registered queries: result registry and text checks (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounting, comparison, loss, profile, registry, textscan
from ..session import staged
from .bindings import snapshot, table
from .catalog import query
from .inputs import loans, scored
from .oracle_base import with_tables
from .queries_panels import _DRAW_RATES, DRAW_SQL, draw_means, draw_schedule
from .queries_results import LATER, PROJECTION_SQL, projection

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations",
)
_COUNTS = registry.Cells("cohort_counts", ("year", "LoanStatus", "role"), ("n", "events"))
_MEANS = registry.Cells("calibration_means", ("cohort",), ("n", "events", "mean_predicted", "recorded_rate"))
_STRESS = registry.Cells("stress", ("scenario", "lgd_variant", "group_name", "group_value", "metric"), ("value", "pd_n", "loss_n"))


def _result_tables(spark, sf):
    counts = accounting.cohort_counts(loans(spark, sf), ["year", "LoanStatus", "role"])
    means = comparison.calibration_means(scored(spark, sf).withColumn("cohort", F.col("role")), ["cohort"])
    return counts, means, projection(spark, sf)


def all_claims(spark, sf):
    """Saved results re-read as claims; staged because every check reads them more than once."""
    counts, means, stress = _result_tables(spark, sf)
    parts = [registry.claims(t, c) for t, c in ((counts, _COUNTS), (means, _MEANS), (stress, _STRESS))]
    return staged(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _claims_sql() -> str:
    def cell(source, keys, column, origin, value, unit):
        text = " || '|' || ".join(f"'{k}=' || cast({k} as varchar)" for k in keys)
        return (f"select '{source}' as source, {text} as selector_text, '{column}' as column_name, cast({value} as double) as value, {unit} as unit from {origin}")

    parts = [cell("cohort_counts", ("year", "LoanStatus", "role"), c, "t_counts", c, "'count'") for c in ("n", "events")]
    parts += [cell("calibration_means", ("cohort",), c, "t_means", c, "'count'" if c in ("n", "events") else "'fraction'") for c in ("n", "events", "mean_predicted", "recorded_rate")]
    keys = ("scenario", "lgd_variant", "group_name", "group_value", "metric")
    parts += [cell("stress", keys, "value", "proj", "value", "case when metric in ('pd', 'loss_rate') then 'fraction' else 'USD' end")]
    parts += [cell("stress", keys, c, "proj", c, "'count'") for c in ("pd_n", "loss_n")]
    return (
        with_tables("scored", "scenario") + f", {PROJECTION_SQL}, t_counts as (select year, LoanStatus, role, count(*) as n, sum(Y) as events from elig group by 1, 2, 3), "
        "t_means as (select role as cohort, count(*) as n, sum(Y) as events, avg(p) as mean_predicted, avg(Y) as recorded_rate from scored group by 1), "
        "cl0 as (" + " union all ".join(parts) + "), cl as (select 'N' || left(sha256(source || chr(10) || selector_text || chr(10) || column_name), 14) as id, * from cl0) "
    )


CLAIMS_SQL = _claims_sql()
_ROUND = "case when unit = 'USD' then round(value, 2) else round(value, 6) end"


@query("i01_unpivot_claims", CLAIMS_SQL + f"select id, source, selector_text, column_name, {_ROUND} as value from cl")
def unpivot_claims(spark, sf):
    out = all_claims(spark, sf)
    value = F.when(F.col("unit") == "USD", F.round("value", 2)).otherwise(F.round("value", 6))
    return out.select("id", "source", "selector_text", F.col("column").alias("column_name"), value.alias("value"))


@query("i02_unit_inference", CLAIMS_SQL + "select source, column_name, unit, count(*) as n from cl group by 1, 2, 3")
def unit_inference(spark, sf):
    return all_claims(spark, sf).groupBy("source", F.col("column").alias("column_name"), "unit").agg(F.count("*").alias("n"))


@query(
    "i03_scalar_typing",
    with_tables("snap") + """
    , raw as (select 'term' as field, TermInMonths as t from snap union all select 'rate', InitialInterestRate from snap union all select 'date', PaidInFullDate from snap
      union all select 'naics', NaicsCode from snap union all select 'odd', case LoanStatus when 'CHGOFF' then 'NaN' when 'EXEMPT' then 'Infinity' else '1e3' end from snap),
    k as (select field, t, try_cast(nullif(t, '') as double) as x from raw)
    select field, case when t = '' then 'null' when isfinite(x) and x = floor(x) then 'int' when isfinite(x) then 'float' else 'text' end as kind,
    count(*) as n, count(x) filter (isfinite(x)) as numbers, round(sum(x) filter (isfinite(x)), 3) as total from k group by 1, 2""",
)
def scalar_typing(spark, sf):
    from ..functions.shapes import stacked

    odd = F.when(F.col("LoanStatus") == "CHGOFF", "NaN").when(F.col("LoanStatus") == "EXEMPT", "Infinity").otherwise("1e3")
    raw = stacked(snapshot(spark, sf), [], ["field", "t"], [
        ("term", F.col("TermInMonths")), ("rate", F.col("InitialInterestRate")), ("date", F.col("PaidInFullDate")), ("naics", F.col("NaicsCode")), ("odd", odd)
    ])
    typed = raw.withColumn("s", registry.typed_scalar(F.col("t")))
    return typed.groupBy("field", F.col("s.kind").alias("kind")).agg(
        F.count("*").alias("n"), F.count("s.number").alias("numbers"), F.round(F.sum("s.number"), 3).alias("total")
    )


@query(
    "i04_derived_claims",
    with_tables("elig", "scenario") + f""", {PROJECTION_SQL}
    , sh as (select a.scenario, a.group_name, a.group_value, b.value / a.value as share from proj a join proj b using (scenario, lgd_variant, group_name, group_value)
      where a.metric = 'expected_loss' and b.metric = 'sponsor_loss' and lgd_variant = 'primary')
    select scenario || '|' || group_name || '|' || group_value || '|sponsor_share' as alias, 'divide' as operation, round(share * 100, 6) as value from sh
    union all select scenario || '|' || group_name || '|' || group_value || '|lender_share', 'complement', round(1 - share, 6) from sh""",
)
def derived_claims(spark, sf):
    stress = staged(registry.claims(projection(spark, sf), _STRESS).where(F.col("column") == "value"))
    primary = stress.where(F.col("selector")["lgd_variant"] == "primary")
    keys = [F.col("selector")[k].alias(k) for k in ("scenario", "group_name", "group_value")]
    ids = primary.groupBy(*keys).agg(*[
        F.max(F.when(F.col("selector")["metric"] == m, F.col("id"))).alias(m) for m in ("expected_loss", "sponsor_loss")
    ])
    name = F.concat_ws("|", "scenario", "group_name", "group_value")
    shares = ids.select(
        F.concat(name, F.lit("|sponsor_share")).alias("alias"), F.lit("divide").alias("operation"),
        F.col("sponsor_loss").alias("left_id"), F.col("expected_loss").alias("right_id"), F.lit(100.0).alias("scale"),
    )
    ratio = staged(registry.derived(stress, shares))
    basis = ratio.select(F.col("alias").alias("id"), (F.col("value") / 100).alias("value"))
    rest = ratio.select(
        F.regexp_replace("alias", "sponsor_share$", "lender_share").alias("alias"), F.lit("complement").alias("operation"),
        F.col("alias").alias("left_id"), F.lit(None).cast("string").alias("right_id"), F.lit(1.0).alias("scale"),
    )
    both = ratio.unionByName(registry.derived(basis, rest))
    return both.select("alias", "operation", F.round("value", 6).alias("value"))


@query(
    "i05_registry_verification",
    CLAIMS_SQL + """, tg as (select id, left(id, 2) as tag from cl)
    select 'claims' as "check", count(*) as n from tg union all select 'verified', count(*) filter (tag not in ('N0', 'N1', 'Na')) from tg
    union all select 'missing_source', count(*) filter (tag = 'N0') from tg union all select 'value_mismatch', count(*) filter (tag = 'N1') from tg
    union all select 'interval_mismatch', 0 from tg where false union all select 'unit_mismatch', count(*) filter (tag = 'Na') from tg""",
)
def registry_verification(spark, sf):
    source = all_claims(spark, sf)
    tag = F.substring("id", 1, 2)
    published = source.withColumn("value", F.when(tag == "N1", F.col("value") + 1).otherwise(F.col("value"))).withColumn(
        "unit", F.when(tag == "Na", "wrong").otherwise(F.col("unit"))
    )
    report = registry.verification(published, source.where(tag != "N0"))
    return report.where(~F.col("check").isin("interval_mismatch", "repeated_id"))


_CELL = ("scenario", "lgd_variant", "group_name", "group_value", "metric")
_LEVELS, _CHANGES = registry.Cells("stress", _CELL, ("value",)), registry.Cells("stress_change", _CELL, ("value",))
_BOUNDED = registry.Cells("intervals", ("role", "variant"), ("value", "effective_draws"), "lower", "upper")


def sealed_registry(spark, sf):
    """Projection levels, their changes and drawn intervals as claims with bounds, each with the digest of its written table."""
    levels = staged(projection(spark, sf))
    change = loss.scenario_difference(levels).select(F.lit("adverse_minus_baseline").alias("scenario"), F.lit("primary").alias("lgd_variant"), "*")
    point = scored(spark, sf).where(LATER).groupBy("role").agg(F.avg("p").alias("with_rate"), F.avg("Y").alias("recorded"))
    drawn = comparison.combine(point.unpivot(["role"], ["with_rate", "recorded"], "variant", "value"), staged(draw_means(spark, sf)), ["role", "variant"], attempted=40)
    parts = [registry.sealed_claims(t, c) for t, c in ((levels, _LEVELS), (staged(change), _CHANGES), (staged(drawn), _BOUNDED))]
    return staged(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _sealed_sql() -> str:
    def cell(source, keys, column, origin, unit, shown, bounds="null::double as lower, null::double as upper"):
        text = " || '|' || ".join(f"'{k}=' || cast({k} as varchar)" for k in keys)
        return (f"select '{source}' as source, {text} as selector_text, '{column}' as column_name, cast({column} as double) as value, {bounds}, {unit} as unit, "
                + ", ".join(f"{k if shown else 'null'} as {k}" for k in _CELL) + f" from {origin}")

    money = "when metric like '%expected_loss%' or metric like '%sponsor_loss%' or metric like '%lender_loss%' then 'USD'"
    parts = [
        cell("stress", _CELL, "value", "proj", f"case {money} else 'fraction' end", True),
        cell("stress_change", _CELL, "value", "dif", f"case {money} when metric = 'pd_change_pp' then 'probability percentage points' else 'fraction' end", True),
        cell("intervals", ("role", "variant"), "value", "iv", f"'{registry.OTHER_UNIT}'", False, "lower, upper"),
        cell("intervals", ("role", "variant"), "effective_draws", "iv", "'count'", False, "lower, upper"),
    ]
    return (
        with_tables("scored", "scenario") + f", {PROJECTION_SQL}, {DRAW_SQL}, dr as ({_DRAW_RATES}), "
        f"pt as (select 'with_rate' as variant, role, avg(p) as value from scored where {LATER} group by 2 union all select 'recorded', role, avg(Y) from scored where {LATER} group by 2), "
        "iv as (select pt.role, pt.variant, pt.value, quantile_cont(dr.value, 0.025) as lower, quantile_cont(dr.value, 0.975) as upper, count(dr.value) as effective_draws "
        "from pt join dr on pt.role = dr.role and pt.variant = dr.variant group by pt.role, pt.variant, pt.value), "
        "dif as (select 'adverse_minus_baseline' as scenario, 'primary' as lgd_variant, a.group_name, a.group_value, case when a.metric = 'pd' then 'pd_change_pp' else a.metric || '_change' end as metric, "
        "(a.value - b.value) * case when a.metric = 'pd' then 100 else 1 end as value from proj a join proj b using (group_name, group_value, metric) "
        "where a.scenario = 'adverse' and b.scenario = 'baseline' and a.lgd_variant = 'primary' and b.lgd_variant = 'primary'), "
        "cl0 as (" + " union all ".join(parts) + "), cl as (select 'N' || left(sha256(source || chr(10) || selector_text || chr(10) || column_name), 14) as id, * from cl0) "
    )


_SEALED_SQL = _sealed_sql()


@query("i01b_claims_with_bounds", _SEALED_SQL + f"select id, source, selector_text, column_name, {_ROUND} as value, round(lower, 6) as lower, round(upper, 6) as upper, unit from cl")
def claims_with_bounds(spark, sf):
    value = F.when(F.col("unit") == "USD", F.round("value", 2)).otherwise(F.round("value", 6))
    return sealed_registry(spark, sf).select(
        "id", "source", "selector_text", F.col("column").alias("column_name"), value.alias("value"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "unit"
    )


@query(
    "i05b_sealed_registry",
    _SEALED_SQL + """, tg as (select *, left(id, 2) as tag, source = 'intervals' and selector_text like 'role=oot|%' and column_name = 'value' as bent,
      source = 'stress_change' and left(id, 2) = 'Nb' as stale, value + case when left(id, 2) = 'N1' then 1000 else 0 end as v from cl),
    sums as (select scenario, lgd_variant, group_name, group_value, max(v) filter (metric = 'expected_loss') as t, max(v) filter (metric = 'sponsor_loss') as s,
      max(v) filter (metric = 'lender_loss') as l from tg where source = 'stress' group by 1, 2, 3, 4),
    prs as (select group_name, group_value, metric || '_change' as metric, max(v) filter (scenario = 'adverse') as a, max(v) filter (scenario = 'baseline') as b
      from tg where source = 'stress' and lgd_variant = 'primary' and metric in ('expected_loss', 'sponsor_loss', 'lender_loss') group by 1, 2, 3)
    select 'claims' as "check", count(*) as n from tg union all select 'verified', count(*) filter (tag not in ('N0', 'N1', 'Na', 'Nc') and not bent and not stale) from tg
    union all select 'missing_source', count(*) filter (tag = 'N0') from tg union all select 'value_mismatch', count(*) filter (tag = 'N1') from tg
    union all select 'interval_mismatch', count(*) filter (bent and tag <> 'N0') from tg union all select 'unit_mismatch', count(*) filter (tag = 'Na') from tg
    union all select 'repeated_id', count(*) filter (tag = 'Nc') from tg union all select 'digest_mismatch', count(*) filter (stale) from tg
    union all select 'open_allocations', count(*) filter (not coalesce(abs(t - s - l) <= 0.01, false)) from sums
    union all select 'unequal_changes', count(*) filter (not coalesce(abs(prs.a - prs.b - c.v) <= 0.01, false)) from prs full join
      (select group_name, group_value, metric, v from tg where source = 'stress_change' and metric in ('expected_loss_change', 'sponsor_loss_change', 'lender_loss_change')) c using (group_name, group_value, metric)""",
)
def sealed_verification(spark, sf):
    """A registry with a planted fault of each kind; every check must count exactly its own."""
    source = sealed_registry(spark, sf)
    tag = F.substring("id", 1, 2)
    bent = (F.col("source") == "intervals") & F.col("selector_text").startswith("role=oot|") & (F.col("column") == "value")
    published = source.withColumns({
        "value": F.when(tag == "N1", F.col("value") + 1000).otherwise(F.col("value")), "unit": F.when(tag == "Na", "wrong").otherwise(F.col("unit")),
        "lower": F.when(bent, F.col("lower") + 0.5).otherwise(F.col("lower")),
        "source_digest": F.when((F.col("source") == "stress_change") & (tag == "Nb"), "stale").otherwise(F.col("source_digest")),
    })
    published = published.unionByName(published.where(tag == "Nc"))
    return registry.verification(published, source.where(tag != "N0")).unionByName(registry.closures(published, "stress", "stress_change", 0.01))


_WIDE = ("pd", "expected_loss", "sponsor_loss", "lender_loss", "loss_rate")


@query(
    "i06_wide_pivot",
    with_tables("elig", "scenario") + f", {PROJECTION_SQL} select scenario, lgd_variant, group_name, group_value, " + ", ".join(
        f"round(max(value) filter (metric = '{m}'), {6 if m in ('pd', 'loss_rate') else 2}) as {m}" for m in _WIDE
    ) + " from proj group by 1, 2, 3, 4",
)
def wide_pivot(spark, sf):
    wide = registry.pivoted(projection(spark, sf), ["scenario", "lgd_variant", "group_name", "group_value"], _WIDE)
    return wide.withColumns({m: F.round(m, 6 if m in ("pd", "loss_rate") else 2) for m in _WIDE})


@query(
    "i07_estimate_formatting",
    with_tables("scored") + """
    , m as (select role, count(*) as n, avg(p) as v, min(p) as lo, max(p) as hi, case when role = 'tune' then null else avg(p) end as gap, sum(GrossApproval) as usd from scored group by 1)
    select role, format('{:,}', n) as n_text, printf('%.3f', v * 100) || ' [' || printf('%.3f', lo * 100) || ', ' || printf('%.3f', hi * 100) || ']' as pd_text,
    case when gap is null then 'unavailable' else printf('%.4f', gap) end as gap_text, printf('%.2f', usd * 0.000001::double) as usd_text from m""",
)
def estimate_formatting(spark, sf):
    means = scored(spark, sf).groupBy("role").agg(
        F.count("*").alias("n"), F.avg("p").alias("v"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.sum("GrossApproval").alias("usd")
    )
    gap = F.when(F.col("role") != "tune", F.col("v"))
    return means.select(
        "role", registry.formatted(F.col("n"), integer=True).alias("n_text"),
        registry.formatted(F.col("v"), F.col("lo"), F.col("hi"), scale=100, digits=3).alias("pd_text"),
        registry.formatted(gap, digits=4).alias("gap_text"), registry.formatted(F.col("usd"), scale=1e-6).alias("usd_text"),
    )


@query(
    "i08_interpretation_labels",
    with_tables("elig") + f"""
    , v as (select *, case when l = 'revolving' then 'layer2_term' when l = 'term' then 'layer2_peak' else 'layer1' end as variant from (select loan_type as l, role, count(*) as n from elig group by 1, 2))
    select variant, role, n, case when variant like '%\\_term' escape '\\' then '{registry.ROLE_TERM}' when variant like '%\\_peak' escape '\\' then '{registry.ROLE_PEAK}' else '{registry.ROLE_PRIMARY}' end as specification_role,
    case when variant like 'layer2%' then '{registry.LAYER2_LABEL}' else '{registry.LAYER1_LABEL}' end as layer_interpretation from v""",
)
def interpretation_labels(spark, sf):
    variant = F.when(F.col("loan_type") == "revolving", "layer2_term").when(F.col("loan_type") == "term", "layer2_peak").otherwise("layer1")
    rows = loans(spark, sf).groupBy(variant.alias("variant"), "role").agg(F.count("*").alias("n"))
    return registry.interpretation_labels(rows)


# the six fixed patterns match no generated text, so two planted phrases join the pattern list
_PATTERNS = (*textscan.ASSERTIONS, "released under", "all rights reserved")
_HEDGES = (*textscan.HEDGES, "mit")


@query(
    "i09_assertion_scan",
    "with c as (select doc_id, unnest(regexp_split_to_array(text, '(?i)[.;\\n]|\\b(?:but|however|yet)\\b')) as clause from documents) "
    + " union all ".join(
        f"select doc_id, {i} as pattern_no, regexp_replace(clause, '^\\s+|\\s+$', '', 'g') as clause from c where regexp_matches(clause, '(?i){p}') "
        f"and not regexp_matches(clause, '(?i)\\b(?:{'|'.join(_HEDGES)})\\b')" for i, p in enumerate(_PATTERNS)
    ),
)
def assertion_scan(spark, sf):
    out = textscan.assertion_scan(table(spark, sf, "documents"), "doc_id", "text", _PATTERNS, _HEDGES)
    return out.select("doc_id", "pattern_no", "clause")


_CREDENTIALS = textscan.CREDENTIALS | {"hex_token": 'token = "[0-9a-f]{20,}'}


@query(
    "i10_credential_scan",
    " union all ".join(
        f"select '{t}' as table_name, '{n}' as pattern, count(*) filter (regexp_matches({c}, '{p}')) as texts, "
        f"cast(coalesce(sum(len(regexp_extract_all({c}, '{p}'))), 0) as bigint) as hits from {t}"
        for t, c in (("documents", "text"), ("pages", "html")) for n, p in _CREDENTIALS.items()
    ),
)
def credential_scan(spark, sf):
    reports = [
        textscan.credential_scan(table(spark, sf, t), c, _CREDENTIALS).select(F.lit(t).alias("table_name"), "*")
        for t, c in (("documents", "text"), ("pages", "html"))
    ]
    return reports[0].unionByName(reports[1])


_WIDTH = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5,
          "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


@query(
    "i11_table_catalogue",
    " union all ".join(f"select '{t}' as table_name, count(*) as n_rows, {_WIDTH[t]} as n_columns from {t}" for t in TABLES),
)
def table_catalogue(spark, sf):
    return profile.catalogue({t: table(spark, sf, t) for t in TABLES})


@query(
    "i12_draw_integrity",
    with_tables("scored") + f", {DRAW_SQL}" + """
    , ps as (select ProjectState as state, sum(p) as total, sum(p * 0.25) as sponsor from scored where role = 'reference' group by 1),
    att as (select v.variant, g.draw from (values ('layer1'), ('layer2')) v(variant) cross join (select distinct draw from dw) g where not (variant = 'layer2' and draw = 7)
      union all select 'layer1', 3)
    select 'repeated_attempts' as "check", count(*) as violations from (select variant, draw from att group by 1, 2 having count(*) > 1)
    union all select 'missing_attempts', 80 - count(*) from (select distinct variant, draw from att)
    union all select 'nonpositive_weights', 2 * count(*) from dw where w <= 0
    union all select 'unshared_weights', count(*) from dw where draw = 5
    union all select 'open_allocations', 2 * 2 * count(distinct draw) from dw join ps using (state) where draw = 11
    union all select 'unequal_differences', 2 * count(distinct draw) from dw join ps using (state) where draw = 13""",
)
def draw_integrity(spark, sf):
    """Drawn sums of the reference portfolio with planted faults: each check must find exactly its own."""
    from ..functions.shapes import stacked

    schedule = draw_schedule(spark, sf)
    both = stacked(schedule, ["draw", "state", "w"], ["variant"], [("layer1",), ("layer2",)])
    bent = F.when((F.col("variant") == "layer2") & (F.col("draw") == 5), F.col("w") + 1).otherwise(F.col("w"))
    weights = both.select("variant", "draw", "state", F.col("w").alias("weight"))
    attempts = weights.select("variant", "draw").distinct().where("not (variant = 'layer2' and draw = 7)")
    attempts = attempts.unionByName(attempts.where("variant = 'layer1' and draw = 3"))
    per_state = scored(spark, sf).where("role = 'reference'").groupBy(F.col("ProjectState").alias("state")).agg(F.sum("p").alias("p"))
    sums = weights.join(per_state, "state").groupBy("variant", "draw").agg(F.sum(F.col("weight") * F.col("p")).alias("t"))
    loose = F.when(F.col("draw") == 11, 1.0).otherwise(0.0)
    rows = stacked(sums.withColumn("_x", loose), ["variant", "draw"], ["scenario", "total", "sponsor", "lender"], [
        ("baseline", F.col("t"), F.col("t") * 0.25, F.col("t") * 0.75 + F.col("_x")), ("adverse", F.col("t") * 2, F.col("t") * 0.5, F.col("t") * 1.5 + F.col("_x")),
        ("difference", F.col("t") + F.when(F.col("draw") == 13, 1.0).otherwise(0.0), F.lit(0.0), F.lit(0.0)),
    ])
    shared = both.select("variant", "draw", "state", bent.alias("weight"))
    report = registry.draw_integrity(attempts, weights, rows, expected=40).where("check <> 'unshared_weights'")
    return report.unionByName(registry.draw_integrity(attempts, shared, rows, expected=40).where("check = 'unshared_weights'"))
