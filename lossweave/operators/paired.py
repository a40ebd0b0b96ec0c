"""Bootstrap differences of metrics between models that score the same rows.

All models share one compacted table and one draw table, so a draw reweights the same states for each of them. Rows count only if every
model scores them. Loans are combined once on all scores together; what is then told apart by model is short.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from ..sources.files import finite_or_null
from . import bootstrap
from .comparison import percentile_interval

SEPARATOR = "\x1f"


def joint_groups(scored: DataFrame, scores: Sequence[str], cohort: str, state: str) -> DataFrame:
    """Counts (cohort, p, state, pos, neg), where the cohort is that of the row and the name of the score."""
    clean = scored.select(F.col(cohort).cast("string").alias("c"), F.col(state).alias("state"), "Y", *[finite_or_null(F.col(s)).alias(f"p{k}") for k, s in enumerate(scores)])
    names = [f"p{k}" for k in range(len(scores))]
    once = clean.na.drop(subset=["c", "Y", *names]).groupBy("c", "state", *names).agg(F.sum("Y").alias("pos"), F.sum(1 - F.col("Y")).alias("neg"))
    told = F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(n).alias("p")) for s, n in zip(scores, names)]))
    each = once.select("c", "state", "pos", "neg", told.alias("m"))
    return each.groupBy(F.concat_ws(SEPARATOR, "c", "m.score").alias("cohort"), F.col("m.p").alias("p"), "state").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def model_draws(scored: DataFrame, scores: Sequence[str], cohort: str, state: str, weights: np.ndarray | DataFrame | None = None,
                draws: int = 999, seed: int = 20261008, metrics: Sequence[str] = bootstrap.METRICS) -> DataFrame:
    """``(cohort, score, metric, draw, value)`` of every model on the same draws; draw -1 is the point estimate."""
    if len(set(scores)) < len(scores) or any(SEPARATOR in s for s in scores):
        raise ValueError("scores need different names")
    out = bootstrap.group_draws(staged(joint_groups(scored, scores, cohort, state)), weights, draws, seed, metrics)
    parts = F.split("cohort", SEPARATOR)
    return out.select(parts[0].alias("cohort"), parts[1].alias("score"), "metric", "draw", "value")


def metric_differences(drawn: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(cohort, metric, left, right, draw, difference)`` for the named pairs of scores, one aggregate and no self-join.

    A draw that is undefined for either score is undefined for the difference.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs])).alias("pair")
    rows = drawn.select("*", sides).where((F.col("score") == F.col("pair.left")) | (F.col("score") == F.col("pair.right")))
    side = lambda name: F.max(F.when(F.col("score") == F.col(f"pair.{name}"), F.col("value")))
    keys = ["cohort", "metric", F.col("pair.left").alias("left"), F.col("pair.right").alias("right"), "draw"]
    return rows.groupBy(*keys).agg((side("left") - side("right")).alias("difference"))


def difference_intervals(differences: DataFrame) -> DataFrame:
    """Point difference, percentile bounds and undefined draws for each cohort, metric and pair."""
    keys = ["cohort", "metric", "left", "right"]
    point = differences.where("draw = -1").select(*keys, F.col("difference").alias("value"))
    return point.join(percentile_interval(differences.where("draw >= 0"), keys, "difference"), keys)
