"""A store of refit attempts: what is in it is never fitted again, and never under other terms.

The store is a Parquet folder to which finished batches are appended, so a killed run loses at most the batch it was in.
An attempt is known by variant and number. Beside it stand two digests: of the contract (design, settings and training rows) and
of its state weights. A run asks which scheduled attempts are missing by an anti-join; an attempt that is there under another
digest fails the run. Attempts that did not converge are stored like others and keep their number. Should two runs
append the same attempt, equal rows count once and different ones fail.

The schedule is attempts x states, both fixed by the protocol; so is the number of coefficients. Training rows and portfolios stay distributed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from . import comparison, models
from .design import Design

SCHEMA = (
    "variant string, attempt int, contract string, weights string, successful boolean, message string, iterations int, "
    "objective double, columns array<string>, beta array<double>"
)


def row_digest(rows: DataFrame) -> str:
    """An order-independent digest of a table: its size and two sums of 64-bit hashes of whole rows, modulo 2^64 each."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    own = F.sha2(whole, 256)
    sums = [F.sum(F.conv(F.substring(own, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    found = rows.agg(F.count("*"), *sums).first()
    return hashlib.sha256("/".join(str(int(v or 0)) for v in found).encode()).hexdigest()


def contract(design: Design, settings: dict, rows: DataFrame) -> str:
    """Digest of everything but the weights that decides what an attempt comes to. ``rows``: what the design learned from."""
    terms = {"design": asdict(design), "settings": settings, "rows": row_digest(rows)}
    return hashlib.sha256(json.dumps(terms, sort_keys=True, default=str).encode()).hexdigest()


def weight_digests(levels: Sequence[str], schedule: np.ndarray) -> list[str]:
    names = json.dumps(list(levels)).encode()
    return [hashlib.sha256(names + np.ascontiguousarray(line, "<f8").tobytes()).hexdigest() for line in schedule]


@dataclass
class AttemptStore:
    """Attempts under ``path``, a folder that driver and executors share."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self.spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(self.path)

    def rows(self, variant: str | None = None) -> DataFrame:
        """One row for each stored attempt. An attempt stored twice with different outcomes fails the job."""
        found = self.spark.read.schema(SCHEMA).parquet(self.path)
        found = found if variant is None else found.where(F.col("variant") == variant)
        cells = [c for c in found.columns if c not in ("variant", "attempt")]
        once = found.groupBy("variant", "attempt").agg(F.min(F.struct(*cells)).alias("a"), F.max(F.struct(*cells)).alias("b"))
        clash = F.raise_error(F.concat(F.lit("two outcomes are stored for attempt "), F.col("attempt").cast("string")))
        checked = F.when(F.col("a").eqNullSafe(F.col("b")), F.col("a")).otherwise(clash)
        return once.select("variant", "attempt", checked.alias("a")).select("variant", "attempt", "a.*")

    def missing(self, variant: str, terms: str, digests: Sequence[str]) -> list[int]:
        """Scheduled attempts that are not stored; refuses a store whose digests differ from the schedule's."""
        wanted = self.spark.createDataFrame([(variant, k, terms, d) for k, d in enumerate(digests)], "variant string, attempt int, contract string, weights string")
        there = self.rows(variant).select("variant", "attempt", F.col("contract").alias("c"), F.col("weights").alias("w"))
        met = wanted.join(there, ["variant", "attempt"])
        other = met.select("attempt", (F.col("contract") != F.col("c")).alias("terms"), (F.col("weights") != F.col("w")).alias("drawn")).where("terms or drawn").orderBy("attempt").collect()
        if other:
            what = "contract" if any(r.terms for r in other) else "state weights"
            raise ValueError(f"{len(other)} stored attempts of {variant}, from number {other[0].attempt} on, were made under a different {what}")
        return sorted(r.attempt for r in wanted.join(there, ["variant", "attempt"], "left_anti").collect())

    def append(self, variant: str, terms: str, digests: Sequence[str], columns: Sequence[str], fits: Sequence[models.Fit]) -> None:
        rows = [
            (variant, f.attempt, terms, digests[f.attempt], f.converged, f.message, f.iterations, float(f.objective), list(columns),
             [float(b) for b in f.beta] if f.converged else None)
            for f in fits
        ]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def refit_stored(store: AttemptStore, variant: str, data: models.LogitData, columns: Sequence[str], schedule: np.ndarray, terms: str,
                 start: np.ndarray | None = None, batch: int = models.FIT_BATCH) -> list[int]:
    """Fits what is missing, batch by batch, from ``start`` (the point estimate) if given. Returns the numbers fitted in this run."""
    digests = weight_digests(data.levels, schedule)
    todo = store.missing(variant, terms, digests)
    for lo in range(0, len(todo), batch):
        part = todo[lo : lo + batch]
        store.append(variant, terms, digests, columns, models.fit_penalised(data, part, schedule[part], start=start))
    return todo


def refit_projection(portfolio: DataFrame, scenarios: DataFrame, design: Design, point: np.ndarray, stored: DataFrame, severity: DataFrame) -> DataFrame:
    """The scenario projection at the point estimate, with percentile intervals over the stored refits.

    ``stored``: attempts of one variant. Those that failed count as attempted but are not projected; numbers with holes are
    fine. Every draw must have the statistics of the point estimate, no more and no less. Without a successful attempt the bounds are NULL.
    """
    slim = stored.select("attempt", "successful", "beta", "columns").orderBy("attempt").collect()  # as many as the schedule
    if len({r.attempt for r in slim}) < len(slim):
        raise ValueError("an attempt number occurs twice: project one variant at a time")
    good = [r for r in slim if r.successful]
    if any(list(r["columns"]) != design.columns for r in good):
        raise ValueError("stored attempts are of a design with other columns")
    betas = np.vstack([point, *[np.array(r.beta) for r in good]])
    rows = staged(models.drawwise_projection(portfolio, scenarios, design, betas, severity, draws=[-1, *[r.attempt for r in good]]))
    keys = ["scenario", "lgd_variant", "group_name", "group_value", "metric"]
    at_point = rows.where("draw = -1").drop("draw")
    if not good:
        empty = {"lower": "double", "upper": "double", "effective_draws": "long", "undefined_draws": "long", "attempted_draws": "int", "successful_draws": "int"}
        values = {c: F.lit(None if t == "double" else 0).cast(t) for c, t in empty.items()} | {"attempted_draws": F.lit(len(slim))}
        return at_point.withColumns(values)
    return comparison.combine(at_point, rows.where("draw >= 0"), keys, len(slim))
