"""Turning wide aggregate rows into long ones."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(names: Sequence[str], rows: Iterable[Sequence[object]]) -> Column:
    """An array of equally named structs; plain values become literals."""
    return F.array(*[
        F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows
    ])


def stacked(df: DataFrame, keep: Sequence[str], names: Sequence[str], rows: Iterable[Sequence[object]]) -> DataFrame:
    """One output row per entry, next to the kept columns; no join and no shuffle."""
    long = df.withColumn("_e", F.explode(entries(names, rows)))
    return long.select(*[c for c in keep], "_e.*")
