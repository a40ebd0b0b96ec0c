"""State-cluster bootstrap of score metrics from sufficient statistics.

Draws reweight whole states, so almost everything is linear or bilinear in the 51 state weights:
loans are compacted once to (cohort, score, state) counts and the draws only touch state vectors.
Average precision and the calibration line are not, so they run per score bucket and per draw
batch in vectorised kernels, summed across buckets by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from .comparison import percentile_interval
from .design import summed
from .ordered import with_bucket

METRICS = ("auc", "average_precision", "brier", "calibration_intercept", "calibration_slope")
MAX_CLUSTERS = 2_000
DRAW_CHUNK = 64


def compacted(scored: DataFrame, cohort: str, state: str, score: str = "p") -> DataFrame:
    """``(cohort, p, state, pos, neg)`` counts."""
    return scored.groupBy(F.col(cohort).alias("cohort"), F.col(score).alias("p"), F.col(state).alias("state")).agg(
        F.sum("Y").alias("pos"), F.sum(1 - F.col("Y")).alias("neg")
    )


def cluster_levels(df: DataFrame, state: str = "state") -> list[str]:
    """Sorted cluster names; clusters are few by design and the limit is checked."""
    levels = [r[0] for r in df.select(state).distinct().limit(MAX_CLUSTERS + 1).collect()]
    if len(levels) > MAX_CLUSTERS:
        raise ValueError("too many clusters for a cluster bootstrap")
    return sorted(levels)


def multinomial_draws(levels: list[str], draws: int, seed: int) -> np.ndarray:
    k = len(levels)
    return np.random.default_rng(seed).multinomial(k, np.full(k, 1 / k), size=draws)


def multiplier_draws(levels: list[str], draws: int, seed: int) -> np.ndarray:
    raw = np.random.default_rng(seed).exponential(1.0, (draws, len(levels)))
    if not (raw > 0).all():
        raise ValueError("a scheduled multiplier is not positive")
    return raw


def counter_multipliers(states: DataFrame, draws: int, seed: int, state: str = "state") -> DataFrame:
    """``(draw, state, weight)`` with exponential weights that are a function of seed, draw and state alone.

    52 bits of an MD5 digest make a uniform number inside (0, 1), its logarithm an exponential one. So no matrix is built on
    the driver, draws can be made in any order or part, and SQL can repeat them.
    """
    name = F.concat_ws("/", F.lit(str(seed)), F.col("draw").cast("string"), F.col("state"))
    bits = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double")
    long = states.select(F.col(state).alias("state")).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), "state")
    return long.select("draw", "state", (-F.log((bits + 0.5) / F.lit(2.0**52))).alias("weight"))


def draw_table(spark: SparkSession, levels: list[str], weights: np.ndarray) -> DataFrame:
    """``(draw, state, weight)``: draws x states, both fixed by the protocol."""
    rows = [(d, s, float(w)) for d, line in enumerate(weights) for s, w in zip(levels, line)]
    return spark.createDataFrame(rows, "draw int, state string, weight double")


def normalized_weights(schedule: DataFrame, counts: DataFrame) -> DataFrame:
    """Multipliers scaled so that each draw's loan weights add up to the number of loans."""
    rows = schedule.join(F.broadcast(counts.select("state", "n")), "state")
    totals = rows.groupBy("draw").agg((F.sum("n") / F.sum(F.col("weight") * F.col("n"))).alias("_f"))
    return rows.join(totals, "draw").select("draw", "state", "n", (F.col("weight") * F.col("_f")).alias("weight"))


def _dense(pdf: pd.DataFrame, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores in ascending order with per-state positive and negative counts."""
    scores, row = np.unique(pdf["p"].to_numpy(), return_inverse=True)
    col = pdf["state"].map(index).to_numpy()
    pos, neg = (np.zeros((len(scores), len(index))) for _ in range(2))
    np.add.at(pos, (row, col), pdf["pos"].to_numpy())
    np.add.at(neg, (row, col), pdf["neg"].to_numpy())
    return scores, pos, neg


def _bucket_stats(index: dict[str, int]):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        p, pos, neg = _dense(pdf, index)
        below = np.cumsum(neg, axis=0) - neg
        pairs = pos.T @ (below + 0.5 * neg)
        loss = (pos * ((1 - p) ** 2)[:, None] + neg * (p**2)[:, None]).sum(axis=0)
        return pd.DataFrame({
            "cohort": [pdf["cohort"].iloc[0]], "bucket": [int(pdf["_bucket"].iloc[0])], "pos": [pos.sum(axis=0).tolist()],
            "neg": [neg.sum(axis=0).tolist()], "loss": [loss.tolist()], "pairs": [pairs.ravel().tolist()],
        })

    return kernel


def _precision_sums(index: dict[str, int], above: dict, weights: np.ndarray):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        cohort, bucket = pdf["cohort"].iloc[0], int(pdf["_bucket"].iloc[0])
        _, pos, neg = _dense(pdf, index)
        up, un = above[(cohort, bucket)]
        cumpos = np.cumsum(pos[::-1], axis=0)[::-1] + up
        cumall = np.cumsum((pos + neg)[::-1], axis=0)[::-1] + up + un
        out = np.zeros(len(weights))
        for start in range(0, len(weights), DRAW_CHUNK):
            w = weights[start:start + DRAW_CHUNK].T
            seen = cumall @ w
            part = (pos @ w) * np.divide(cumpos @ w, seen, out=np.zeros_like(seen), where=seen > 0)
            out[start:start + DRAW_CHUNK] = part.sum(axis=0)
        return pd.DataFrame({"cohort": [cohort], "v": [out.tolist()]})

    return kernel


def calibration_lines(
    groups: DataFrame, levels: list[str], weights: np.ndarray, iterations: int = 100, tolerance: float = 1e-8
) -> dict[str, np.ndarray]:
    """Intercept and slope of outcome on logit score for every cohort and draw; NaN where undefined.

    Damped Newton for all draws at once: an iteration is one pass over the compacted table, and
    each partition returns five sums per cohort and active draw.
    """
    index = {s: i for i, s in enumerate(levels)}
    cohorts = sorted(r[0] for r in groups.select("cohort").distinct().collect())
    line = {c: np.tile([0.0, 1.0], (len(weights), 1)) for c in cohorts}
    active = {c: np.arange(len(weights)) for c in cohorts}
    done = {c: np.zeros(len(weights), dtype=bool) for c in cohorts}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for cohort, part in batch.groupby("cohort", sort=False):
                draws = active[cohort]
                if not len(draws):
                    continue
                p = np.clip(part["p"].to_numpy(), 1e-12, 1 - 1e-12)
                z = np.log(p) - np.log1p(-p)
                code = part["state"].map(index).to_numpy()
                pos, n = part["pos"].to_numpy(), part["pos"].to_numpy() + part["neg"].to_numpy()
                sums = totals.setdefault(cohort, np.zeros((len(draws), 5)))
                for start in range(0, len(draws), DRAW_CHUNK):
                    d = draws[start:start + DRAW_CHUNK]
                    a, b = line[cohort][d].T
                    q = 1 / (1 + np.exp(-np.clip(a + np.outer(z, b), -35, 35)))
                    w = weights[d][:, code].T
                    error, v = w * (pos[:, None] - n[:, None] * q), w * n[:, None] * q * (1 - q)
                    sums[start:start + DRAW_CHUNK] += np.stack(
                        [error.sum(0), z @ error, v.sum(0), z @ v, (z * z) @ v], axis=1
                    )
        for cohort, sums in totals.items():
            yield pd.DataFrame({"cohort": [cohort], "v": [sums.ravel().tolist()]})

    for _ in range(iterations):
        if not any(len(a) for a in active.values()):
            break
        found = {r["cohort"]: r["v"].toArray().reshape(-1, 5) for r in
                 summed(groups.mapInPandas(partial, "cohort string, v array<double>"), "v", ["cohort"]).collect()}
        for cohort, sums in found.items():
            d = active[cohort]
            g0, g1, h00, h01, h11 = sums.T
            det = h00 * h11 - h01 * h01
            good = det > 1e-14
            safe = np.where(good, det, 1.0)
            step = np.stack([(h11 * g0 - h01 * g1) / safe, (h00 * g1 - h01 * g0) / safe], axis=1)
            size = np.abs(step).max(axis=1)
            line[cohort][d[good]] += (step * np.minimum(1.0, 1.0 / np.maximum(size, 1e-30))[:, None])[good]
            finished = good & (size < tolerance)
            done[cohort][d[finished]] = True
            active[cohort] = d[good & ~finished]
    for cohort in cohorts:
        line[cohort][~done[cohort]] = np.nan
    return line


def metric_draws(scored: DataFrame, cohort: str, state: str, weights: np.ndarray | DataFrame | None = None, score: str = "p",
                 draws: int = 999, seed: int = 20261008) -> DataFrame:
    """``(cohort, metric, draw, value)``; draw -1 is the point estimate, NULL marks an undefined draw.

    The same draws serve every cohort and every model scored on these states (pairing).
    """
    return group_draws(staged(compacted(scored, cohort, state, score)), weights, draws, seed)


def supplied_weights(levels: list[str], schedule: DataFrame) -> np.ndarray:
    """A draw table (draw, state, weight) as draws x levels. Draws are numbered from 0 without holes; every state needs a weight in each."""
    wanted = schedule.where(F.col("state").isin(levels)).groupBy("draw").agg(F.map_from_entries(F.collect_list(F.struct("state", "weight"))).alias("w"))
    rows = wanted.orderBy("draw").collect()  # draws x states, both fixed by the protocol
    if [r.draw for r in rows] != list(range(len(rows))) or any(set(r.w) != set(levels) or None in r.w.values() for r in rows):
        raise ValueError("a draw table needs draws from 0 on and a weight for each of the states in each draw")
    return np.array([[r.w[s] for s in levels] for r in rows], dtype=float).reshape(len(rows), len(levels))


def group_draws(groups: DataFrame, weights: np.ndarray | DataFrame | None = None, draws: int = 999, seed: int = 20261008,
                metrics: Sequence[str] = METRICS) -> DataFrame:
    """``metric_draws`` of a written table of counts (cohort, p, state, pos, neg)."""
    spark = groups.sparkSession
    levels = cluster_levels(groups)
    index = {s: i for i, s in enumerate(levels)}
    if isinstance(weights, DataFrame):
        weights = supplied_weights(levels, weights)
    drawn = multinomial_draws(levels, draws, seed) if weights is None else weights
    table = np.vstack([np.ones(len(levels)), drawn]).astype(float)
    # equal scores share a bucket; cut on the cohort too so that every cohort is spread; written once, read twice
    bucketed = staged(with_bucket(groups, ["cohort", "p"]))
    stats = staged(bucketed.groupBy("cohort", "_bucket").applyInPandas(
        _bucket_stats(index),
        "cohort string, bucket int, pos array<double>, neg array<double>, loss array<double>, pairs array<double>",
    ))
    inside = {r["cohort"]: r["pairs"].toArray() for r in summed(stats.select("cohort", "pairs"), "pairs", ["cohort"]).collect()}
    ends: dict[str, list] = {c: [] for c in inside}
    for r in stats.select("cohort", "bucket", "pos", "neg", "loss").collect():  # one short row per bucket
        ends[r["cohort"]].append((r["bucket"], np.array(r["pos"]), np.array(r["neg"]), np.array(r["loss"])))
    above, totals = {}, {}
    for name, parts in ends.items():
        parts.sort(key=lambda t: t[0])
        pos, neg, loss = (np.array([p[i] for p in parts]) for i in (1, 2, 3))
        lower = np.cumsum(neg, axis=0) - neg
        pairs = inside[name].reshape(len(levels), -1) + pos.T @ lower
        tops = [x.sum(axis=0) - np.cumsum(x, axis=0) for x in (pos, neg)]
        for i, part in enumerate(parts):
            above[(name, part[0])] = (tops[0][i], tops[1][i])
        totals[name] = (pos.sum(axis=0), neg.sum(axis=0), loss.sum(axis=0), pairs)
    precision = summed(
        bucketed.groupBy("cohort", "_bucket").applyInPandas(_precision_sums(index, above, table), "cohort string, v array<double>"), "v", ["cohort"]
    )
    steps = {r["cohort"]: r["v"].toArray() for r in precision.collect()}
    line = any(m.startswith("calibration") for m in metrics)
    lines = calibration_lines(groups, levels, table) if line else {name: np.full((len(table), 2), np.nan) for name in totals}
    rows = []
    for name, (pos, neg, loss, pairs) in totals.items():
        p, n = table @ pos, table @ neg
        defined = (p > 0) & (n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            values = {
                "auc": np.einsum("ds,st,dt->d", table, pairs, table) / (p * n), "average_precision": steps[name] / p,
                "brier": (table @ loss) / (p + n), "calibration_intercept": lines[name][:, 0], "calibration_slope": lines[name][:, 1],
            }
        for metric, v in ((m, values[m]) for m in metrics):
            rows += [(name, metric, d - 1, float(x) if ok and np.isfinite(x) else None) for d, (x, ok) in enumerate(zip(v, defined))]
    return spark.createDataFrame(rows, "cohort string, metric string, draw int, value double")


def metric_intervals(draws: DataFrame) -> DataFrame:
    """Point value, percentile bounds and the number of undefined draws per cohort and metric."""
    point = draws.where("draw = -1").select("cohort", "metric", "value")
    return point.join(percentile_interval(draws.where("draw >= 0"), ["cohort", "metric"]), ["cohort", "metric"])


def bin_bands(binned: DataFrame, schedule: DataFrame, keys: list[str]) -> DataFrame:
    """Bootstrap band of the recorded rate per bin: loans shrink to (bin, state) before draws multiply them."""
    per_state = binned.groupBy(*keys, "bin", "state").agg(F.count("*").alias("n"), F.sum("Y").alias("y"))
    rates = per_state.join(schedule, "state").groupBy(*keys, "bin", "draw").agg(
        F.try_divide(F.sum(F.col("weight") * F.col("y")), F.sum(F.col("weight") * F.col("n"))).alias("value")
    )
    return percentile_interval(rates, [*keys, "bin"])
