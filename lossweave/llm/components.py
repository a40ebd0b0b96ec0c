"""Connected components of an edge table by repeated contraction, with every level a written table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossweave.session import staged

FEW_EDGES = 50_000  # counted edges up to this number are contracted in one task, without shuffles


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the edges and, for each, the smallest one of its component."""
    ends, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    label, (i, j) = np.arange(len(ends)), np.split(at, 2)
    while len(i):
        x, y = label[i], label[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(after := label[label], label):
            label = after
    return ends, ends[label]


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), which are longs; all nodes of a component share one root.

    A level hooks every node to its smallest neighbour, itself included, and contracts the edges to the
    hooks; hooks only lead downwards, so they never form a circle. What is left of few edges is contracted in one
    task. The levels are then read back from the last to the first. Smallest neighbours are combined before the
    shuffle, and a node with very many neighbours only meets equi-joins, which adaptive execution splits.
    """

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [[b.column(c).to_numpy() for c in ("a", "b")] for b in batches]
        if own:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, labels(*map(np.concatenate, zip(*own))))), names=["node", "root"])

    live = staged(edges.select("a", "b").where("a <> b").distinct())
    levels: list[DataFrame] = []
    while live.count() > FEW_EDGES:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("hook")).withColumn("hook", F.least("node", "hook")))
        levels.append(hook)
        moved = live.join(hook.toDF("a", "x"), "a").join(hook.toDF("b", "y"), "b").where("x <> y")
        live = staged(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    roots = staged(live.coalesce(1).mapInArrow(rest, "node long, root long"))
    for hook in reversed(levels):
        roots = staged(hook.join(roots.toDF("hook", "root"), "hook", "left").select("node", F.coalesce("root", "hook").alias("root")))
    return roots
