"""Severity ratios, loss allocation, scenario projection and grouped sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import GROUP_KEYS, LOAN_TYPES, Protocol
from ..functions.cleaning import count_where, holds
from ..functions.shapes import stacked
from ..session import lookup_join

VARIANTS = ("primary", "capped", "downturn")
PROJECTED = (("baseline", ("primary",)), ("adverse", VARIANTS))
SEVERITY_INPUTS = ("Y", "year", "loan_type", "size_band", "GrossChargeOffAmount", "GrossApproval")
METRICS = ("pd", "expected_loss", "sponsor_loss", "lender_loss", "loss_rate")


def group_sums(
    df: DataFrame, sums: dict[str, Column], keys: Sequence[str] = (), groups: Sequence[str] = GROUP_KEYS
) -> DataFrame:
    """Sums overall and over each single grouping key: ``(keys, group_name, group_value, sums)``.

    Rows are first combined on all grouping keys together, so only the few resulting
    combinations, never the loans, are multiplied by the number of groupings.
    """
    fine = df.groupBy(*keys, *groups).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    cells = [("overall", "all"), *[(g, F.col(g)) for g in groups]]
    long = stacked(fine, [*keys, *sums], ["group_name", "group_value"], cells)
    return long.groupBy(*keys, "group_name", "group_value").agg(*[F.sum(n).alias(n) for n in sums])


def severity_table(train: DataFrame, protocol: Protocol) -> DataFrame:
    """Pooled ratio of losses to exposure over the full grid of loan type and size band, per variant.

    A cell with too few valid events borrows its loan type's ratio, then the overall one. One
    aggregate yields at most 12 rows; all pooling happens on those.
    """
    loss, ead = F.col("GrossChargeOffAmount"), F.col("GrossApproval")
    bad = train.where("not (role <=> 'train')").select(F.count("*").alias("n"))
    events = train.where("Y = 1")
    ok = holds(loss >= 0)
    chosen = {"primary": F.lit(True), "capped": F.lit(True), "downturn": F.col("year").isin(*protocol.downturn_years)}
    amount = {"primary": loss, "capped": F.least(loss, ead), "downturn": loss}
    parts = []
    for v in VARIANTS:
        use = chosen[v] & ok
        parts += [
            count_where(chosen[v]).alias(f"{v}_events"), count_where(use).alias(f"{v}_n"),
            F.sum(F.when(use, amount[v])).alias(f"{v}_loss"), F.sum(F.when(use, ead)).alias(f"{v}_ead"),
            count_where(use & (loss > ead)).alias(f"{v}_over"),
        ]
    cells = events.groupBy("loan_type", "size_band").agg(*parts)
    fields = ("events", "n", "loss", "ead", "over")
    long = stacked(cells, ["loan_type", "size_band"], ["variant", *fields], [
        (v, *[F.col(f"{v}_{f}") for f in fields]) for v in VARIANTS
    ])
    axis = {"variant": VARIANTS, "loan_type": LOAN_TYPES, "size_band": protocol.size_labels}
    grid = train.sparkSession.range(1).withColumn("_impure", bad.scalar()).select("_impure")
    for name, values in axis.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    full = grid.join(F.broadcast(long), list(axis), "left").na.fill(0, ["events", "n", "over", "loss", "ead"])
    by_type, overall = Window.partitionBy("variant", "loan_type"), Window.partitionBy("variant")
    few = protocol.severity_minimum
    pool = F.when(F.col("n") >= few, "cell").when(F.sum("n").over(by_type) >= few, "loan_type").otherwise("overall")
    levels = full.select("*", pool.alias("pool"), *[
        F.sum(f).over(w).alias(f"{f}_{tag}") for f in ("n", "loss", "ead", "over") for tag, w in (("type", by_type), ("all", overall))
    ])

    def pooled(field: str) -> Column:
        return F.when(F.col("pool") == "cell", F.col(field)).when(
            F.col("pool") == "loan_type", F.col(f"{field}_type")).otherwise(F.col(f"{field}_all"))

    pure = F.when(F.col("_impure") > 0, F.raise_error(F.lit("severity may use training rows only"))).otherwise(F.col("variant"))
    return levels.select(
        pure.alias("variant"), "loan_type", "size_band", F.col("events").alias("cell_events"), F.col("n").alias("valid_cell_n"),
        (F.col("events") - F.col("n")).alias("excluded_n"), "pool", pooled("n").alias("pooled_n"),
        F.try_divide(pooled("loss"), pooled("ead")).alias("lgd"), pooled("over").alias("ratios_above_one"),
    )


def assign_severity(loans: DataFrame, severity: DataFrame, variants: Sequence[str] = VARIANTS) -> DataFrame:
    """Adds one ``lgd_<variant>`` column per variant from the 12-cell lookup."""
    wide = severity.groupBy("loan_type", "size_band").agg(
        *[F.max(F.when(F.col("variant") == v, F.col("lgd"))).alias(f"lgd_{v}") for v in variants]
    )
    return lookup_join(loans, wide, ["loan_type", "size_band"])


def allocate(score: Column, lgd: Column, ead: Column, share: Column) -> tuple[Column, Column, Column]:
    """Expected loss and its sponsor and lender parts; any invalid input fails the job."""
    finite = ~F.isnan(score) & ~F.isnan(lgd) & ~F.isnan(ead) & ~F.isnan(share)
    valid = finite & score.between(0, 1) & (lgd >= 0) & (lgd < float("inf")) & (ead > 0) & (ead < float("inf")) & share.between(0, 1)
    total = F.when(holds(valid), score * lgd * ead).otherwise(F.raise_error(F.lit("invalid score, severity, exposure or share")).cast("double"))
    return total, total * share, total * (1 - share)


def loss_population(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("reference_n"), F.count("guarantee_share").alias("valid_loss_n"),
        F.count_if(F.col("guarantee_share").isNull()).alias("excluded_invalid_share_n"),
    )


def projection_totals(
    scored: DataFrame, severity: DataFrame, score: str = "p", keys: Sequence[str] = (), groups: Sequence[str] = GROUP_KEYS
) -> DataFrame:
    """Wide sums per scenario and group: score over all loans, losses over loans with a valid share."""
    rows = assign_severity(scored, severity)
    share, ead = F.col("guarantee_share"), F.col("GrossApproval")
    ok = share.isNotNull()
    sums = {
        "pd_sum": F.col(score), "pd_n": F.lit(1).cast("long"), "loss_n": ok.cast("long"),
        "exposure": F.when(ok, ead).otherwise(0.0),
    }
    for v in VARIANTS:
        el = F.when(ok, F.col(score) * F.col(f"lgd_{v}") * ead).otherwise(0.0)
        sums |= {f"{v}_total": el, f"{v}_sponsor": F.coalesce(el * share, F.lit(0.0)), f"{v}_lender": F.coalesce(el * (1 - share), F.lit(0.0))}
    return group_sums(rows, sums, [*keys, "scenario"], groups)


def projection_metrics(totals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long projection: stressed severity variants only for the adverse scenario."""
    entries = []
    for scenario, variants in PROJECTED:
        for v in variants:
            values = {
                "pd": F.col("pd_sum") / F.col("pd_n"), "expected_loss": F.col(f"{v}_total"),
                "sponsor_loss": F.col(f"{v}_sponsor"), "lender_loss": F.col(f"{v}_lender"),
                "loss_rate": F.try_divide(F.col(f"{v}_total"), F.col("exposure")),
            }
            entries += [
                F.when(F.col("scenario") == scenario, F.struct(F.lit(v).alias("lgd_variant"), F.lit(m).alias("metric"), x.alias("value")))
                for m, x in values.items()
            ]
    kept = [*keys, "scenario", "group_name", "group_value"]
    return totals.withColumn("_e", F.explode(F.array_compact(F.array(*entries)))).select(
        *kept, "_e.*", "pd_n", "loss_n", "exposure"
    )


def scenario_difference(projection: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adverse minus baseline per group and metric under primary severity; probabilities in points."""
    primary = projection.where("lgd_variant = 'primary'")
    both = primary.groupBy(*keys, "group_name", "group_value", "metric").agg(
        F.max(F.when(F.col("scenario") == "adverse", F.col("value"))).alias("_a"),
        F.max(F.when(F.col("scenario") == "baseline", F.col("value"))).alias("_b"),
        F.max("pd_n").alias("pd_n"), F.max("loss_n").alias("loss_n"), F.max("exposure").alias("exposure"),
    )
    is_pd = F.col("metric") == "pd"
    return both.select(
        *keys, "group_name", "group_value", F.when(is_pd, "pd_change_pp").otherwise(F.concat("metric", F.lit("_change"))).alias("metric"),
        ((F.col("_a") - F.col("_b")) * F.when(is_pd, 100.0).otherwise(1.0)).alias("value"), "pd_n", "loss_n", "exposure",
    )


def accepted_summary(accepted: DataFrame, severity: DataFrame, score: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """Recorded rate, exposure and allocated losses of an accepted set, over loans with a valid share."""
    rows = assign_severity(accepted.where("guarantee_share is not null"), severity)
    total, sponsor, lender = allocate(F.col(score), F.col("lgd_primary"), F.col("GrossApproval"), F.col("guarantee_share"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("Y").alias("recorded_rate"), F.avg(score).alias("mean_pd"), F.sum("GrossApproval").alias("exposure"),
        F.sum(total).alias("expected_loss"), F.sum(sponsor).alias("sponsor_loss"), F.sum(lender).alias("lender_loss"),
    )
