"""Score metrics that treat ties exactly, from score groups and running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import count_where
from .ordered import bin_index, exact_quantiles, inner_cuts, running_totals


def score_groups(scored: DataFrame, keys: Sequence[str], score: str = "p") -> DataFrame:
    """``(keys, p, pos, neg)``: equal scores are one group, however many rows share them."""
    return scored.groupBy(*keys, F.col(score).alias("p")).agg(F.sum("Y").alias("pos"), F.sum(1 - F.col("Y")).alias("neg"))


def tie_sweep(scored: DataFrame, keys: Sequence[str], score: str = "p") -> DataFrame:
    """Cumulative positives and negatives from the highest score down, per cohort."""
    keys = list(keys)
    groups = score_groups(scored, keys, score)
    # ascending totals over (cohort, score), turned around with the cohort's end totals
    swept = running_totals(groups, [*keys, "p"], {"_pos": "pos", "_neg": "neg"})
    if keys:
        ends = swept.groupBy(*keys).agg(F.max("_pos").alias("_end_pos"), F.max("_neg").alias("_end_neg"))
        swept = swept.join(ends, keys)
    else:
        ends = swept.agg(F.struct(F.max("_pos").alias("a"), F.max("_neg").alias("b")).alias("_e"))
        swept = swept.withColumn("_e", ends.scalar()).withColumns({"_end_pos": F.col("_e.a"), "_end_neg": F.col("_e.b")})
    return swept.select(
        *keys, "p", "pos", "neg", (F.col("_end_pos") - F.col("_pos") + F.col("pos")).alias("cumpos"),
        (F.col("_end_neg") - F.col("_neg") + F.col("neg")).alias("cumneg"),
    )


def ranking_metrics(scored: DataFrame, keys: Sequence[str], score: str = "p") -> DataFrame:
    """AUC (ties count half) and step-form average precision per cohort; NULL for one-class cohorts."""
    sweep = tie_sweep(scored, keys, score)
    pos, neg = F.sum("pos"), F.sum("neg")
    # negatives scored lower than the group: all, minus those at or above
    part = F.sum(F.col("pos") * (0.5 * F.col("neg") - F.col("cumneg")))
    precision = F.sum(F.col("pos") * (F.col("cumpos") / (F.col("cumpos") + F.col("cumneg"))))
    both = (pos > 0) & (neg > 0)
    return sweep.groupBy(*keys).agg(
        pos.alias("events"), neg.alias("non_events"),
        F.when(both, F.try_divide(part + pos * neg, pos.cast("double") * neg)).alias("auc"),
        F.when(both, F.try_divide(precision, pos)).alias("average_precision"),
    )


def brier(scored: DataFrame, keys: Sequence[str], score: str = "p") -> DataFrame:
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("Y") - F.col(score), 2)).alias("brier"))


def score_validity(scored: DataFrame, keys: Sequence[str], score: str = "p") -> DataFrame:
    """Scores that are missing or not finite, scores outside [0, 1], and whether both classes occur."""
    p = F.col(score)
    odd = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"), count_where(odd).alias("non_finite"), count_where(~odd & ~p.between(0, 1)).alias("out_of_range"),
        (F.min("Y") == F.max("Y")).alias("one_class"),
    )


def require_valid(report: DataFrame) -> None:
    bad = report.where("non_finite > 0 or out_of_range > 0").limit(1).collect()
    if bad:
        raise ValueError(f"invalid scores: {bad[0].asDict()}")


def training_cuts(train: DataFrame, score: str, cells: int = 10) -> DataFrame:
    """One row with the inner edges of the training score's quantile bins."""
    spots = [i / cells for i in range(cells + 1)]
    return exact_quantiles(train.select(score), score, spots, name="_q").select(inner_cuts(F.col("_q")).alias("cuts"))


def calibration_table(train: DataFrame, test: DataFrame, keys: Sequence[str], score: str = "p", cells: int = 10) -> DataFrame:
    """Per cohort and training-quantile bin: count, mean score, recorded rate and edges; empty bins stay."""
    keys = list(keys)
    edges = training_cuts(train, score, cells)
    binned = test.withColumn("_cuts", edges.scalar()).withColumn("bin", bin_index(F.col(score), F.col("_cuts")))
    sums = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.sum(score).alias("_p"), F.sum("Y").alias("events"))
    cohorts = sums.groupBy(*keys).agg(F.max("bin").alias("_m")).withColumn("_cuts", edges.scalar())
    grid = cohorts.select(*keys, "_cuts", F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("bin"))
    full = grid.join(sums, [*keys, "bin"], "left").na.fill(0, ["n", "events"])
    return full.select(
        *keys, (F.col("bin") + 1).alias("bin"), F.get("_cuts", F.col("bin") - 1).alias("lower_edge"), F.get("_cuts", "bin").alias("upper_edge"),
        "n", "events", F.try_divide("_p", "n").alias("mean_predicted"), F.try_divide("events", "n").alias("recorded_rate"),
    )
