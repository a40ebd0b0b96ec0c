"""Where stage tables live, and the join that broadcasts only what was measured to be small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


# Session settings the plans rely on.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # generated methods above 8000 bytes of bytecode are never JIT-compiled; wide projections
    # run several times faster when Spark splits them instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configured(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Hash-spreads a scan that has fewer splits than the session has cores; leaves larger scans alone."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the directory set on the context.

    A session whose executors are threads of the driver may go without and gets a throw-away folder; any
    other session must name one, since executors would write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut the lineage with a written table: it outlives executors, keeps column pruning, and knows its size.

    ``by`` lays the table out in directories for partition pruning, without a shuffle.
    """
    path = scratch_path(df.sparkSession, "stage")
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_join(
    facts: DataFrame, dimension: DataFrame, keys: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Many-to-one join with both promises checked before the facts are read.

    The dimension is materialised once, its keys are proven unique and its rows counted.
    It is broadcast only within ``max_rows``; beyond that Spark plans a shuffled join, where
    adaptive execution splits skewed keys.
    """
    dim = staged(dimension)
    rows, distinct = dim.agg(F.count("*"), F.count_distinct(F.struct(*keys))).first()
    if rows != distinct:
        raise ValueError(f"dimension is not unique on {keys}: {rows} rows, {distinct} keys")
    return facts.join(F.broadcast(dim) if rows <= max_rows else dim, keys, how)
