"""Population stability and training-range support."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import UNSEEN
from ..functions.cleaning import count_where, holds, missing_token
from ..functions.shapes import stacked
from ..session import lookup_join, staged
from .design import finite
from .linking import apply_scenarios
from .ordered import bin_index, exact_quantiles, inner_cuts

FLOOR = 1e-6


def _index(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PSI from paired bin counts ``a`` (training) and ``b`` (target).

    With floored shares a, b and their sums A, B the index is
    ``sum(b ln(b/a)) / B - sum(a ln(b/a)) / A``: the renormalisation needs no pass of its own.
    """
    keys = list(keys)
    totals = counts.groupBy(*keys).agg(F.sum("a").alias("train_n"), F.sum("b").alias("n"))
    rows = counts.join(totals, keys)

    def share(n, total):
        return F.greatest(F.col(n) / F.greatest(F.col(total), F.lit(1)), F.lit(FLOOR))

    a, b = share("a", "train_n"), share("b", "n")
    ratio = F.ln(b / a)
    return rows.groupBy(*keys, "train_n", "n").agg(
        (F.sum(b * ratio) / F.sum(b) - F.sum(a * ratio) / F.sum(a)).alias("psi")
    )


def numeric_psi(train: DataFrame, target: DataFrame, features: Sequence[str], cohort: str, cells: int = 10) -> DataFrame:
    """PSI of each numeric feature and cohort over distinct training quantiles, open tails and a missing bin."""
    pairs = [(c, finite(F.col(c))) for c in features]
    base = stacked(train, [], ["feature", "value"], pairs)
    other = stacked(target, [cohort], ["feature", "value"], pairs)
    spots = [i / cells for i in range(cells + 1)]
    quantiles = exact_quantiles(base, "value", spots, by=["feature"])
    cuts = staged(quantiles.select("feature", inner_cuts(F.col("quantiles")).alias("cuts")))  # one row per feature, read three times
    bin_of = F.when(F.col("value").isNull(), -1).otherwise(bin_index(F.col("value"), F.col("cuts")))
    left = lookup_join(base, cuts, ["feature"]).groupBy("feature", bin_of.alias("bin")).agg(F.count("*").alias("a"))
    right = lookup_join(other, cuts, ["feature"]).groupBy(cohort, "feature", bin_of.alias("bin")).agg(F.count("*").alias("b"))
    cohorts = right.select(cohort, "feature").distinct()
    grid = cohorts.join(cuts, "feature").select(cohort, "feature", F.explode(F.sequence(F.lit(-1), F.size("cuts"))).alias("bin"))
    full = grid.join(left, ["feature", "bin"], "left").join(right, [cohort, "feature", "bin"], "left").na.fill(0, ["a", "b"])
    return _index(full, [cohort, "feature"])


def categorical_psi(train: DataFrame, target: DataFrame, features: Sequence[str], cohort: str) -> DataFrame:
    """PSI over training levels plus one bin for everything unseen; missing is a level only if training had it."""
    pairs = [(c, missing_token(F.col(c).cast("string"))) for c in features]
    left = stacked(train, [], ["feature", "level"], pairs).groupBy("feature", "level").agg(F.count("*").alias("a"))
    fine = stacked(target, [cohort], ["feature", "level"], pairs).groupBy(cohort, "feature", "level").agg(F.count("*").alias("b"))
    known = fine.join(left.select("feature", "level", F.lit(True).alias("_known")), ["feature", "level"], "left")
    level = F.when(F.col("_known"), F.col("level")).otherwise(UNSEEN)
    right = known.groupBy(cohort, "feature", level.alias("level")).agg(F.sum("b").alias("b"))
    unseen = left.select("feature").distinct().select("feature", F.lit(UNSEEN).alias("level"), F.lit(0).cast("long").alias("a"))
    cohorts = fine.select(cohort, "feature").distinct()
    grid = left.unionByName(unseen).join(cohorts, "feature")
    full = grid.join(right, [cohort, "feature", "level"], "left").na.fill(0, ["b"])
    return _index(full, [cohort, "feature"])


def drift_table(train: DataFrame, target: DataFrame, numeric: Sequence[str], categorical: Sequence[str], cohort: str) -> DataFrame:
    return numeric_psi(train, target, numeric, cohort).unionByName(categorical_psi(train, target, categorical, cohort))


def training_bounds(train: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    parts = [x for c in features for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    return train.groupBy(*keys).agg(F.struct(*parts).alias("_bounds"))


def scenario_support_states(train: DataFrame, scenarios: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(ProjectState, scenario, feature, value, lo, hi, outside)`` against the state's own training range."""
    rows = lookup_join(scenarios, training_bounds(train, features, ["ProjectState"]), ["ProjectState"])
    return stacked(
        rows, ["ProjectState", "scenario"], ["feature", "value", "lo", "hi", "outside"],
        [(c, F.col(c), F.col(f"_bounds.lo_{c}"), F.col(f"_bounds.hi_{c}"),
          holds((F.col(c) < F.col(f"_bounds.lo_{c}")) | (F.col(c) > F.col(f"_bounds.hi_{c}")))) for c in features],
    )


def scenario_support(train: DataFrame, portfolio: DataFrame, scenarios: DataFrame, features: Sequence[str]) -> DataFrame:
    """Flagged loans per scenario, scope and feature, and their union as ``any_numeric``."""
    inputs = apply_scenarios(portfolio, scenarios)
    local = training_bounds(train, features, ["ProjectState"]).withColumnRenamed("_bounds", "_state")
    whole = training_bounds(train, features)
    rows = lookup_join(inputs, local, ["ProjectState"]).withColumn("_global", whole.scalar())

    def outside(c, side):
        return holds((F.col(c) < F.col(f"{side}.lo_{c}")) | (F.col(c) > F.col(f"{side}.hi_{c}")))

    scopes = {"state_specific": "_state", "pooled_global": "_global"}
    parts, flags = [F.count("*").alias("n")], {}
    for scope, side in scopes.items():
        each = {c: outside(c, side) for c in features}
        union = F.lit(False)
        for flag in each.values():
            union = union | flag
        flags[scope] = each | {"any_numeric": union}
        for c, flag in flags[scope].items():
            parts += [count_where(flag).alias(f"{scope}_{c}_n"), F.sum(F.when(flag, F.col("GrossApproval")).otherwise(0.0)).alias(f"{scope}_{c}_usd")]
    wide = rows.groupBy("scenario").agg(*parts)
    return stacked(
        wide, ["scenario"], ["scope", "feature", "flagged_loan_n", "flagged_fraction", "flagged_approval", "n"],
        [(s, c, F.col(f"{s}_{c}_n"), F.col(f"{s}_{c}_n") / F.col("n"), F.col(f"{s}_{c}_usd"), F.col("n")) for s in flags for c in flags[s]],
    )
