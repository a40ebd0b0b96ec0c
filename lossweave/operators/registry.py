"""Published cells as data: claims unpivoted from result tables, derived, verified and rendered."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import count_where, holds
from ..functions.shapes import stacked

# Names that carry a unit.
COUNT_COLUMNS = (
    "n", "events", "non_events", "eligible_n", "macro_excluded_n", "excluded", "remaining", "attempted_draws",
    "effective_draws", "undefined_draws", "draws", "states", "rank", "full_columns", "iterations", "flagged_loan_n", "pd_n", "loss_n",
)
MONEY_WORDS = ("loss_usd", "expected_loss", "sponsor_loss", "lender_loss", "exposure", "flagged_approval")
FRACTION_COLUMNS = (
    "lower_edge", "upper_edge", "mean_predicted", "recorded_rate", "predicted_pd", "match_share", "flagged_fraction", "missing_share",
)
FRACTION_METRICS = ("pd", "loss_rate", "loss_rate_change")
UNITLESS_METRICS = ("auc", "average_precision", "brier", "calibration_intercept", "calibration_slope")
OTHER_UNIT = "source-defined; see source column and protocol"

# Labels in this library's own words; published tables may call the same things otherwise.
ROLE_TERM = "With-term sensitivity; reported-term timing unverified"
ROLE_PEAK = "Term-free peak-unemployment sensitivity"
ROLE_PRIMARY = "Term-free primary specification"
LAYER2_LABEL = "Realised-path association; not an approval-time forecast"
LAYER1_LABEL = "Approval-descriptor prediction"
SCENARIO_CONTEXT = "Stipulated baseline and adverse paths on a fixed portfolio; not out-of-sample validation"


@dataclass(frozen=True)
class Cells:
    """Which cells of a result table become claims."""

    source: str
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    lower: str | None = None
    upper: str | None = None


def unit_of(source: Column, column: Column, metric: Column) -> Column:
    """Unit of a cell from its table, column and metric; the first rule that applies wins."""
    metric = F.coalesce(metric, F.lit(""))
    money = F.lit(False)
    for word in MONEY_WORDS:
        money = money | column.contains(word) | metric.contains(word)
    return (
        F.when(column.isin(*COUNT_COLUMNS) | column.endswith("_n"), "count")
        .when(money, "USD")
        .when((source == "macro_associations") | metric.contains("change_pp"), "probability percentage points")
        .when(source == "average_associations", "probability percentage points per native input unit")
        .when(metric.isin(*UNITLESS_METRICS), F.concat(F.lit("unitless "), metric))
        .when(column.isin(*FRACTION_COLUMNS) | metric.isin(*FRACTION_METRICS), "fraction")
        .when(source == "coefficients", "log odds; train-standardised numeric columns")
        .when(column == "lgd", "charged-off dollars per approved dollar")
        .otherwise(OTHER_UNIT)
    )


def claim_id(source: Column, selector: Column, column: Column) -> Column:
    return F.concat(F.lit("N"), F.substring(F.sha2(F.concat_ws("\n", source, selector, column), 256), 1, 14))


def claims(table: DataFrame, cells: Cells) -> DataFrame:
    """``(id, source, selector, selector_text, column, raw_value, value, unit, lower, upper)``.

    One row per published cell. Two source rows with the same selector fail the job.
    """
    text = F.concat_ws("|", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in cells.keys])
    selector = F.map_from_arrays(
        F.array(*[F.lit(k) for k in cells.keys]), F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in cells.keys])
    )
    metric = F.col("metric") if "metric" in table.columns else F.lit(None).cast("string")
    bounds = [F.col(b).cast("double") if b else F.lit(None).cast("double") for b in (cells.lower, cells.upper)]
    rows = table.select(
        selector.alias("selector"), text.alias("selector_text"), metric.alias("_metric"), bounds[0].alias("lower"), bounds[1].alias("upper"),
        *[F.struct(F.col(c).cast("string").alias("t"), F.col(c).cast("double").alias("v")).alias(f"_{c}") for c in cells.columns],
    )
    long = stacked(rows, ["selector", "selector_text", "_metric", "lower", "upper"], ["column", "_cell"], [(c, F.col(f"_{c}")) for c in cells.columns])
    source = F.lit(cells.source)
    named = long.select(
        claim_id(source, F.col("selector_text"), F.col("column")).alias("id"), source.alias("source"), "selector", "selector_text", "column",
        F.col("_cell.t").alias("raw_value"), F.col("_cell.v").alias("value"), unit_of(source, F.col("column"), F.col("_metric")).alias("unit"), "lower", "upper",
    )
    others = [c for c in named.columns if c != "id"]
    grouped = named.groupBy("id").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in others])
    unique = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate selector "), F.col("selector_text")))).otherwise(F.col("source"))
    return grouped.withColumn("source", unique).select(*named.columns)


def source_digest(table: DataFrame) -> DataFrame:
    """One row ``digest`` for the content of a table: column names, and rows in any order, repeats counted.

    Every cell carries its length, so no two rows read alike; row hashes are added up, each as four 32-bit numbers. Numbers that
    were summed in another order may differ in the last digit, so digest a written table. An empty table has a digest too.
    """
    names = sorted(table.columns)
    cells = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in names]
    rows = table.select(F.md5(F.concat_ws(",", *cells)).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    totals = rows.agg(F.count("*").alias("n"), *parts)
    seal = F.concat_ws("/", F.lit("|".join(names)), F.col("n"), *[F.coalesce(F.col(f"s{i}"), F.lit(0)) for i in range(4)])
    return totals.select(F.sha2(seal, 256).alias("digest"))


def sealed_claims(table: DataFrame, cells: Cells) -> DataFrame:
    """Claims of a written table together with the digest of the table they were read from."""
    return claims(table, cells).withColumn("source_digest", source_digest(table).scalar())


def typed_scalar(raw: Column) -> Column:
    """Kind and number of a raw cell: blank is null, non-finite stays text, whole numbers are integers."""
    number = F.nullif(raw, F.lit("")).try_cast("double")
    whole = holds(number == F.floor(number))
    finite = holds(~F.isnan(number) & (F.abs(number) != float("inf")))
    kind = F.when(holds(raw == "") | raw.isNull(), "null").when(finite & whole, "int").when(finite, "float").otherwise("text")
    return F.struct(kind.alias("kind"), F.when(finite, number).alias("number"), F.when(kind == "text", raw).alias("text"))


def derived(claims_table: DataFrame, specs: DataFrame) -> DataFrame:
    """Ratios and complements of claims, without inventing an interval.

    ``specs`` holds ``(alias, operation, left_id, right_id, scale)`` with operation divide or complement.
    """
    left = claims_table.select(F.col("id").alias("left_id"), F.col("value").alias("_l"))
    right = claims_table.select(F.col("id").alias("right_id"), F.col("value").alias("_r"))
    rows = specs.join(left, "left_id", "left").join(right, "right_id", "left")
    value = F.when(F.col("operation") == "divide", F.try_divide("_l", "_r")).otherwise(1 - F.col("_l")) * F.col("scale")
    return rows.select("alias", "operation", "left_id", "right_id", "scale", value.alias("value"))


def verification(published: DataFrame, source: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Counts of published claims against freshly unpivoted sources: verified, missing, altered, repeated.

    If both sides carry a ``source_digest``, a claim read from another state of its table counts under ``digest_mismatch``.
    A claim published twice in different words is held against its source in each of its words.
    """
    sealed = "source_digest" in published.columns and "source_digest" in source.columns
    compared = ["value", "lower", "upper", "unit", *(["source_digest"] if sealed else [])]
    fresh = source.select("id", F.struct(*compared).alias("_s"), F.lit(True).alias("_found"))
    said = published.groupBy("id").agg(F.count("*").alias("_n"), F.collect_set(F.struct(*compared)).alias("_p"))
    rows = said.join(fresh, "id", "left")

    def same(field: str) -> Column:
        def one(p: Column) -> Column:
            near = holds(F.abs(p[field] - F.col("_s")[field]) <= tolerance) if field in ("value", "lower", "upper") else F.lit(False)
            return p[field].eqNullSafe(F.col("_s")[field]) | near

        return F.forall("_p", one)

    found, value = holds(F.col("_found")), same("value")
    bounds, unit = same("lower") & same("upper"), same("unit")
    seal = same("source_digest") if sealed else F.lit(True)
    checks = {
        "claims": F.lit(True), "verified": found & value & bounds & unit & seal & (F.col("_n") == 1), "missing_source": ~found,
        "value_mismatch": found & ~value, "interval_mismatch": found & ~bounds, "unit_mismatch": found & ~unit, "repeated_id": F.col("_n") > 1,
    }
    if sealed:
        checks["digest_mismatch"] = found & ~seal
    wide = rows.agg(*[count_where(c).alias(n) for n, c in checks.items()])
    return stacked(wide, [], ["check", "n"], [(n, F.col(n)) for n in checks])


def closures(claims_table: DataFrame, levels: str, changes: str, tolerance: float = 1e-5) -> DataFrame:
    """``(check, n)`` over projection claims of source ``levels``: groups whose two parts miss the total by more than
    ``tolerance``, and claims of source ``changes`` that are not adverse minus baseline. A missing cell counts as a miss."""
    key = F.col("selector")
    cells = claims_table.where(F.col("column") == "value").select(
        "source", *[key[k].alias(k) for k in ("scenario", "lgd_variant", "group_name", "group_value", "metric")], "value"
    ).distinct()
    at = cells.where(F.col("source") == levels)
    metric = {m: F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("expected_loss", "sponsor_loss", "lender_loss")}
    sums = at.groupBy("scenario", "lgd_variant", "group_name", "group_value").agg(*metric.values())
    shut = holds(F.abs(F.col("expected_loss") - F.col("sponsor_loss") - F.col("lender_loss")) <= tolerance)
    primary = at.where(F.col("lgd_variant") == "primary").where(F.col("metric").isin(*metric))
    pair = primary.groupBy("group_name", "group_value", F.concat("metric", F.lit("_change")).alias("metric")).agg(
        *[F.max(F.when(F.col("scenario") == s, F.col("value"))).alias(s) for s in ("adverse", "baseline")]
    )
    moved = cells.where((F.col("source") == changes) & F.col("metric").isin(*[f"{m}_change" for m in metric])).select("group_name", "group_value", "metric", "value")
    equal = holds(F.abs(F.col("adverse") - F.col("baseline") - F.col("value")) <= tolerance)
    both = pair.join(moved, ["group_name", "group_value", "metric"], "full")
    return sums.agg(count_where(~shut).alias("n")).select(F.lit("open_allocations").alias("check"), "n").unionByName(
        both.agg(count_where(~equal).alias("n")).select(F.lit("unequal_changes").alias("check"), "n")
    )


def allocation_identities(projection: DataFrame, keys: Sequence[str], tolerance: float = 1e-5) -> DataFrame:
    """Groups whose parts fail to add up to the total."""
    wide = pivoted(projection, keys, ["expected_loss", "sponsor_loss", "lender_loss"])
    return wide.where(F.abs(F.col("expected_loss") - F.col("sponsor_loss") - F.col("lender_loss")) > tolerance)


def require_verified(report: DataFrame) -> None:
    found = {r["check"]: r["n"] for r in report.collect()}
    if found["verified"] != found["claims"]:
        raise ValueError(f"claims do not verify: {found}")


def pivoted(long: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide form of long metrics; the metric list is given, so no extra job discovers it."""
    return long.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value"))


def formatted(value: Column, lower: Column | None = None, upper: Column | None = None, scale: float = 1.0, digits: int = 2, integer: bool = False) -> Column:
    """``value [lower, upper]`` as published text; thousands separators for counts; missing is ``unavailable``."""

    def text(c: Column, places: int) -> Column:
        # format_number rounds the exact binary value, half to even; format_string would round the
        # shortest decimal text of the number
        grouped = F.format_number(c.cast("double") * scale, places)
        return grouped if integer else F.replace(grouped, F.lit(","), F.lit(""))

    body = text(value, 0 if integer else digits)
    if lower is not None and upper is not None:
        bounds = F.concat(F.lit(" ["), text(lower, digits), F.lit(", "), text(upper, digits), F.lit("]"))
        body = F.when(lower.isNotNull() & upper.isNotNull(), F.concat(body, bounds)).otherwise(body)
    return F.when(value.isNull(), "unavailable").otherwise(body)


def interpretation_labels(df: DataFrame, variant: str = "variant", scenario: str | None = None) -> DataFrame:
    """Adds the role of the specification, the meaning of its layer, and the scenario context."""
    name = F.col(variant)
    out = df.withColumn(
        "specification_role", F.when(name.endswith("_term"), ROLE_TERM).when(name.endswith("_peak"), ROLE_PEAK).otherwise(ROLE_PRIMARY)
    ).withColumn("layer_interpretation", F.when(name.startswith("layer2"), LAYER2_LABEL).otherwise(LAYER1_LABEL))
    if scenario:
        out = out.withColumn("macro_context", F.when(F.col(scenario).isNotNull(), SCENARIO_CONTEXT))
    return out


def draw_integrity(attempts: DataFrame, weights: DataFrame, sums: DataFrame, expected: int, tolerance: float = 1e-5) -> DataFrame:
    """``(check, violations)`` over attempts, state weights and drawn loss sums.

    ``attempts(variant, draw)``, ``weights(variant, draw, state, weight)``,
    ``sums(variant, draw, scenario, total, sponsor, lender)`` plus stored ``difference`` rows.
    """
    per_draw = attempts.groupBy("variant", "draw").agg(F.count("*").alias("n"))
    per_variant = per_draw.groupBy("variant").agg(F.count("*").alias("k"), count_where(F.col("n") > 1).alias("rep"))
    once = per_variant.agg(F.sum("rep").alias("repeated_attempts"), F.sum(F.lit(expected) - F.col("k")).alias("missing_attempts"))
    positive = weights.agg(count_where(~holds(F.col("weight") > 0)).alias("nonpositive_weights"))
    shared = weights.groupBy("draw", "state").agg((F.min("weight") != F.max("weight")).alias("differs")).agg(
        count_where(F.col("differs")).alias("unshared_weights")
    )
    direct = sums.where("scenario <> 'difference'")
    closes = direct.agg(count_where(F.abs(F.col("total") - F.col("sponsor") - F.col("lender")) > tolerance).alias("open_allocations"))
    paired = sums.groupBy("variant", "draw").agg(*[F.max(F.when(F.col("scenario") == s, F.col("total"))).alias(s) for s in ("adverse", "baseline", "difference")])
    equal = paired.agg(count_where(~holds(F.abs(F.col("adverse") - F.col("baseline") - F.col("difference")) <= tolerance)).alias("unequal_differences"))
    out = None
    for report in (once, positive, shared, closes, equal):
        part = stacked(report, [], ["check", "violations"], [(c, F.col(c).cast("long")) for c in report.columns])
        out = part if out is None else out.unionByName(part)
    return out
