"""Train-only preprocessing: numeric contract, frequency pooling, sparse design rows and reports."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MISSING, NOT_FITTED, POOLED
from ..functions.cleaning import count_where, holds, missing_token
from ..functions.shapes import stacked
from ..session import staged
from .ordered import exact_quantiles

CONSTANT_SCALE = 1e-12
DIRECT_PARTITIONS = 16  # square root of the partitions from which arrays are added in two rounds
RANK_TOLERANCE = 1e-10


def finite(column: Column) -> Column:
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column.cast("double"))


def numeric_contract(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, median, mean, scale)``: exact median of finite values, moments after imputation."""
    long = stacked(train, [], ["feature", "value"], [(c, finite(F.col(c))) for c in features])
    medians = exact_quantiles(long, "value", [0.5], by=["feature"]).select("feature", F.get("quantiles", F.lit(0)).alias("median"))
    sums = long.groupBy("feature").agg(
        F.count("*").alias("n"), F.count("value").alias("k"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    # moments after imputation follow from the observed moments: no second pass over the rows
    joined = sums.join(F.broadcast(medians), "feature", "left").na.fill(0.0, ["median", "m", "v"])
    share = F.col("k") / F.col("n")
    mean = share * F.col("m") + (1 - share) * F.col("median")
    spread = share * (F.col("v") + F.pow(F.col("m") - mean, 2)) + (1 - share) * F.pow(F.col("median") - mean, 2)
    scale = F.sqrt(F.greatest(spread, F.lit(0.0)))
    return joined.select(
        "feature", "median", mean.alias("mean"), F.when(scale < CONSTANT_SCALE, 1.0).otherwise(scale).alias("scale")
    )


def pooling_map(train: DataFrame, features: Sequence[str], threshold: float, exempt: Sequence[str]) -> DataFrame:
    """``(feature, level, training_n, frequency, pooled_level)``; the outcome is never read."""
    long = stacked(train, [], ["feature", "level"], [(c, missing_token(F.col(c).cast("string"))) for c in features])
    counts = long.groupBy("feature", "level").agg(F.count("*").alias("training_n"))
    total = train.agg(F.count("*").alias("n"))
    share = F.col("training_n") / total.scalar()
    rare = ~F.col("feature").isin(*exempt) & (F.col("frequency") < threshold)
    return counts.withColumn("frequency", share).withColumn("pooled_level", F.when(rare, POOLED).otherwise(F.col("level")))


def apply_pooling(df: DataFrame, mapping: DataFrame, features: Sequence[str], suffix: str = "") -> DataFrame:
    """Pooled levels per feature; unseen levels become ``Other`` where fitted, else a zero-vector marker.

    Only levels that stand for themselves are looked up, at most ``1 / threshold`` per pooled
    feature: a rare level and an unseen one both fall through to ``Other``.
    """
    own = F.col("pooled_level") == F.col("level")
    maps = mapping.groupBy("feature").agg(
        F.collect_list(F.when(own, F.col("level"))).alias("_own"), F.max(F.col("pooled_level") == POOLED).alias("_other")
    ).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("_own", "_other")))).alias("_maps"))
    out = df.withColumn("_maps", maps.scalar())
    pooled = {}
    for c in features:
        entry, level = F.col("_maps")[c], missing_token(F.col(c).cast("string"))
        fallback = F.when(entry["_other"], POOLED).otherwise(NOT_FITTED)
        pooled[c + suffix] = F.when(F.array_contains(entry["_own"], level), level).otherwise(fallback)
    return out.withColumns(pooled).drop("_maps")


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _finite_sql(c: str) -> str:
    return f"case when not isnan({c}) and abs({c}) <> double('Infinity') then cast({c} as double) end"


@dataclass
class Design:
    """Frozen columns of a fitted design: everything scoring needs, none of the training rows."""

    numeric: list[str]
    categorical: list[str]
    median: dict[str, float]
    mean: dict[str, float]
    scale: dict[str, float]
    levels: dict[str, list[str]]
    names: list[str] = field(default_factory=list)
    keep: list[int] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [self.names[i] for i in self.keep]

    def pooled(self, c: str) -> str:
        own = ", ".join(_text(v) for v in self.levels[c])
        fallback = _text(POOLED if POOLED in self.levels[c] else NOT_FITTED)
        level = f"coalesce(nullif(cast({c} as string), ''), {_text(MISSING)})"
        return f"case when {level} in ({own}) then {level} else {fallback} end"

    def parts(self) -> dict[str, str]:
        """Every full-design column by name, as SQL text over the numeric inputs and ``_pool_<feature>``."""
        cols = {"intercept": "1.0D"}
        for c in self.numeric:
            cols[c] = f"((coalesce({_finite_sql(c)}, {self.median[c]!r}D) - {self.mean[c]!r}D) / {self.scale[c]!r}D)"
        for c in self.numeric:
            cols[c + "__missing"] = f"(case when {_finite_sql(c)} is null then 1.0D else 0.0D end)"
        for c in self.categorical:
            for level in self.levels[c][1:]:
                cols[f"{c}_{level}"] = f"(case when _pool_{c} = {_text(level)} then 1.0D else 0.0D end)"
        return cols

    def _with_pools(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"_pool_{c}": F.expr(self.pooled(c)) for c in self.categorical}) if self.categorical else df

    def rows(self, df: DataFrame, keep: Sequence[str], reduced: bool = True) -> DataFrame:
        """The kept columns plus ``x``, the design row as an array of doubles."""
        parts = self.parts()
        chosen = self.columns if reduced else self.names
        return self._with_pools(df).select(*keep, F.expr(f"array({', '.join(parts[n] for n in chosen)})").alias("x"))

    def predictor(self, beta: Sequence[float]) -> str:
        """The linear predictor as SQL text."""
        parts = self.parts()
        return " + ".join(f"({float(b)!r}D) * {parts[n]}" for n, b in zip(self.columns, beta, strict=True))

    def linear(self, df: DataFrame, beta: Sequence[float], name: str = "eta") -> DataFrame:
        """Adds the linear predictor as one native expression."""
        scored = self._with_pools(df).withColumn(name, F.expr(self.predictor(beta)))
        return scored.drop(*[f"_pool_{c}" for c in self.categorical])


def summed(partials: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Element-wise sum of equally long arrays: positions are summed map-side, then put in order."""
    cells = partials.select(*keys, F.posexplode(value).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.sum("_x").alias("_x"))
    rows = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_a"))
    return rows.select(*keys, array_to_vector(F.col("_a._x")).alias(value))


def array_totals(partials: DataFrame, partitions: int) -> dict[int, np.ndarray]:
    """Sums of arrays by ``k``. ``partials`` holds (part, k, v), where ``v`` is an array as the bytes of its doubles.

    Arrays stay whole on the way: one task adds those of a ``k`` one after the other. Where very many partitions
    send some, a round over about the square root of their number goes first. The driver gets one array for each ``k``.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist()):
                values = np.frombuffer(blob)
                totals[k] = totals[k] + values if k in totals else values
        if totals:
            yield array_batch({"part": [0] * len(totals), "k": list(totals), "v": [v.tobytes() for v in totals.values()]})

    schema = "part long, k long, v binary"
    root = math.isqrt(partitions)
    if root > DIRECT_PARTITIONS:
        partials = partials.repartition(root, F.pmod("part", F.lit(root)), "k").mapInArrow(add, schema)
    summed_up = partials.repartition("k").mapInArrow(add, schema)
    return {r["k"]: np.frombuffer(r["v"]) for r in summed_up.collect()}


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """A column of equally long arrays as a matrix, without touching single rows."""
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def array_batch(values: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(values)


def gram_matrix(design_rows: DataFrame, columns: int) -> np.ndarray:
    """X'X / n. Each partition adds up the upper triangle of its own product; only those are shuffled, as whole arrays."""
    upper = np.triu_indices(columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((columns, columns)), 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                total += x.T @ x
                n += len(x)
        if n:
            cells = np.append(total[upper], float(n))
            yield array_batch({"part": [TaskContext.get().partitionId()], "k": [0], "v": [cells.tobytes()]})

    partials = design_rows.select("x").mapInArrow(partial, "part long, k long, v binary")
    gram = np.zeros((columns, columns))
    sums = array_totals(partials, partials.rdd.getNumPartitions()).get(0)
    if sums is not None:
        gram[upper] = sums[:-1] / sums[-1]
    return gram + np.triu(gram, 1).T


def independent_columns(gram: np.ndarray, priority: Sequence[int], tolerance: float = RANK_TOLERANCE) -> list[int]:
    """Columns not explained by earlier ones, in priority order: pivots of a growing Cholesky factor."""
    size = len(gram)
    order = list(priority) + [i for i in range(size) if i not in set(priority)]
    floor = max(float(np.diag(gram).max()), 1.0) * tolerance
    left = gram.astype(float).copy()
    kept: list[int] = []
    for i in order:
        if left[i, i] > floor:
            kept.append(i)
            left -= np.outer(left[:, i], left[i, :]) / left[i, i]
    return sorted(kept)


def fit_design(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], threshold: float = 0.001,
    exempt: Sequence[str] = ("ProjectState",),
) -> Design:
    """Contract, maps and independent columns from training rows only."""
    train = staged(train.select("role", *numeric, *categorical))
    if train.where("not (role <=> 'train')").limit(1).count():
        raise ValueError("a design is learned from rows with the role train and no others")
    numbers = {r["feature"]: r for r in numeric_contract(train, numeric).collect()} if numeric else {}
    levels: dict[str, set[str]] = {c: set() for c in categorical}
    if categorical:
        pooled = pooling_map(train, categorical, threshold, exempt).select("feature", "pooled_level").distinct()
        for r in pooled.collect():
            levels[r["feature"]].add(r["pooled_level"])
    design = Design(
        list(numeric), list(categorical), {c: numbers[c]["median"] for c in numeric}, {c: numbers[c]["mean"] for c in numeric},
        {c: numbers[c]["scale"] for c in numeric}, {c: sorted(levels[c]) for c in categorical},
    )
    design.names = list(design.parts())
    states = [i for i, n in enumerate(design.names) if n.startswith("ProjectState_")]
    gram = gram_matrix(design.rows(train, [], reduced=False), len(design.names))
    design.keep = independent_columns(gram, [0, *states])
    if not set(states) <= set(design.keep):
        raise ValueError(f"no independent column is left for: {sorted(set(design.names[i] for i in set(states) - set(design.keep)))}")
    return design


def design_long(df: DataFrame, design: Design, key: Sequence[str]) -> DataFrame:
    """Sparse long form ``(key, column, value)`` of non-zero entries."""
    rows = design.rows(df, key)
    names = F.expr(f"array({', '.join(_text(n) for n in design.columns)})")
    return rows.select(*key, F.explode(F.arrays_zip(names.alias("column"), F.col("x").alias("value"))).alias("_e")).select(
        *key, F.col("_e.column").alias("column"), F.col("_e.value").alias("value")
    ).where("value <> 0")


def support_report(train: DataFrame, target: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per feature: missing values, values outside the training range, categories never seen."""
    bounds = train.agg(F.struct(*[x for c in numeric for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).alias("_b"))
    seen = stacked(train, [], ["feature", "level"], [(c, F.col(c)) for c in categorical]).distinct()
    ranged = target.withColumn("_b", bounds.scalar())
    wide = ranged.groupBy(*keys).agg(F.count("*").alias("n"), *[
        x for c in numeric for x in (
            count_where(F.col(c).isNull()).alias(f"m_{c}"),
            count_where((F.col(c) < F.col(f"_b.lo_{c}")) | (F.col(c) > F.col(f"_b.hi_{c}"))).alias(f"o_{c}"))
    ])
    numbers = stacked(wide, keys, ["feature", "n", "missing", "outside_train_range", "unseen_category"],
                      [(c, F.col("n"), F.col(f"m_{c}"), F.col(f"o_{c}"), F.lit(0).cast("long")) for c in numeric])
    levels = stacked(target, keys, ["feature", "level"], [(c, F.col(c)) for c in categorical]).groupBy(*keys, "feature", "level").agg(F.count("*").alias("_n"))
    marked = levels.join(seen.withColumn("_seen", F.lit(True)), ["feature", "level"], "left")
    zero = F.lit(0).cast("long")
    categories = marked.groupBy(*keys, "feature").agg(
        F.sum("_n").alias("n"), F.sum(F.when(F.col("_seen").isNull(), F.col("_n")).otherwise(0)).alias("unseen_category")
    ).select(*keys, "feature", "n", zero.alias("missing"), zero.alias("outside_train_range"), "unseen_category")
    return numbers.unionByName(categories)


def preprocessing_counts(target: DataFrame, mapping: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``(keys, feature, n, missing_n, unseen_n, unseen_action)`` for every feature of a cohort."""
    keys = list(keys)
    token = {c: missing_token(F.col(c).cast("string")) for c in categorical}
    levels = stacked(target, keys, ["feature", "level"], list(token.items())).groupBy(*keys, "feature", "level").agg(F.count("*").alias("_n"))
    pooled = mapping.groupBy("feature").agg(F.max(F.col("pooled_level") == POOLED).alias("_other"))
    known = levels.join(mapping.select("feature", "level", F.lit(True).alias("_known")), ["feature", "level"], "left").join(pooled, "feature", "left")
    unseen = F.when(F.col("_known").isNull(), F.col("_n")).otherwise(0)
    absent = F.when(F.col("level") == "__missing__", F.col("_n")).otherwise(0)
    action = F.when(holds(F.max("_other")), "fitted Other").otherwise("zero one-hot vector")
    categories = known.groupBy(*keys, "feature").agg(
        F.sum("_n").alias("n"), F.sum(absent).alias("missing_n"), F.sum(unseen).alias("unseen_n"), action.alias("unseen_action")
    )
    wide = target.groupBy(*keys).agg(F.count("*").alias("n"), *[count_where(finite(F.col(c)).isNull()).alias(f"m_{c}") for c in numeric])
    numbers = stacked(wide, keys, ["feature", "n", "missing_n", "unseen_n", "unseen_action"],
                      [(c, F.col("n"), F.col(f"m_{c}"), F.lit(0).cast("long"), "training median plus missing flag") for c in numeric])
    return numbers.unionByName(categories)
