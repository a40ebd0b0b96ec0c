"""Logistic models as iterative Spark jobs: every pass sums small matrices, never moves rows.

A fit holds its design rows as a written table. Each iteration sends the current coefficients of
all active fits to the partitions and gets back one array per partition and fit, added up whole
in tasks. Many reweighted fits therefore share each pass over the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GROUP_KEYS, MACRO, Protocol
from ..functions.shapes import stacked
from ..session import staged
from . import bootstrap, loss
from .design import Design, array_batch, array_totals, fit_design, matrix, summed
from .linking import apply_scenarios
from .panel import complete_scenarios

# Numerical settings of the penalised fits.
MAX_ITERATIONS = 100
MAX_STEP = 5.0
MAX_HALVINGS = 25
TOLERANCE = 1e-5
ACCEPTED_DROP = 1e-8
CONDITION_LIMIT = 1e14
FIT_BATCH = 64
TREE_FEATURES = ("log_approval", "guarantee_share", "log_jobs", "u0", "du", "h0", "dh")
OUT_OF_ROUNDS = "iteration limit"


@dataclass
class Fit:
    """What an attempt came to. Only a converged one hands out its coefficients; ``message`` says why another did not."""

    attempt: int
    beta: np.ndarray
    converged: bool = False
    message: str = OUT_OF_ROUNDS
    iterations: int = 0
    objective: float = np.nan
    score_max: float = np.inf
    condition: float = np.inf

    def coefficients(self) -> np.ndarray:
        if not self.converged:
            raise ValueError(f"attempt {self.attempt} has no coefficients: {self.message}")
        return self.beta


def _logistic(eta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(eta, -700, 700)))


def triangles(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Upper triangles of X' diag(w) X, one row for each column w of ``v``, all weights in the same products.

    A column meets the columns that are at least as full. Mostly empty ones, such as levels, are multiplied on their own rows alone.
    """
    p = x.shape[1]
    spot, upper = np.empty((p, p), np.int64), np.triu_indices(p)
    spot[upper] = spot.T[upper] = np.arange(len(upper[0]))
    order = np.argsort(np.count_nonzero(x, axis=0), kind="stable")
    x, out = x[:, order], np.empty((v.shape[1], len(upper[0])))
    for at, i in enumerate(order):
        rows = np.flatnonzero(x[:, at])
        if 2 * len(rows) > len(x):
            rows = slice(None)
        out[:, spot[i, order[at:]]] = (v[rows] * x[rows, at, None]).T @ x[rows, at:]
    return out


def each(kernel):
    """A kernel of one fit as one of all fits of a pass."""
    return lambda keys, x, y, code: [kernel(k, x, y, code) for k in keys]


class LogitData:
    """Design rows ``(state, Y, x)`` of one model, staged once, with the passes over them."""

    def __init__(self, rows: DataFrame, columns: int):
        slim = staged(rows.select("state", F.col("Y").cast("double"), "x"))
        counts = slim.groupBy("state").agg(F.count("*").alias("n"), F.sum("Y").alias("y"))
        self.levels = bootstrap.cluster_levels(counts)
        table = {r["state"]: (r["n"], r["y"]) for r in counts.collect()}
        self.n = np.array([table[s][0] for s in self.levels], dtype=float)
        self.events = np.array([table[s][1] for s in self.levels], dtype=float)
        self.columns = columns
        codes = F.array(*[F.lit(s) for s in self.levels])
        self.rows = slim.select((F.array_position(codes, F.col("state")) - 1).alias("code"), "Y", "x")
        self.partitions = slim.rdd.getNumPartitions()

    def weights(self, raw: np.ndarray | None) -> np.ndarray:
        """State weights per fit, scaled to add up to the number of rows; ones without a schedule."""
        if raw is None:
            return np.ones((1, len(self.levels)))
        if not (np.isfinite(raw).all() and (raw > 0).all()):
            raise ValueError("a state weight is zero, negative or not a number")
        return raw * (self.n.sum() / (raw @ self.n))[:, None]

    def _pass(self, kernel, keys: Sequence[int]) -> dict[int, np.ndarray]:
        """``kernel`` returns an array for each of the keys, in their order; those of all batches are added."""

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                if batch.num_rows:
                    x, y, code = matrix(batch), batch.column("Y").to_numpy(), batch.column("code").to_numpy()
                    for k, part in zip(keys, kernel(keys, x, y, code)):
                        totals[k] = part if k not in totals else totals[k] + part
            if totals:
                own = TaskContext.get().partitionId()
                yield array_batch({"part": [own] * len(totals), "k": [int(k) for k in totals], "v": [v.tobytes() for v in totals.values()]})

        return array_totals(self.rows.mapInArrow(partial, "part long, k long, v binary"), self.partitions)

    def _answers(self, asked: dict[int, tuple], weights: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """One pass that serves every fit with what it asked for.

        ``(beta, None)`` asks for the weighted log-likelihood and the upper triangle of the expected information,
        ``(beta, inverse)`` for the score with the bias-reducing leverage term, ``(beta, False)`` for the plain score.
        """
        upper = np.triu_indices(self.columns)

        def kernel(k, x, y, code):
            beta, inverse = asked[k]
            eta = x @ beta
            q, w = _logistic(eta), weights[k][code]
            v = w * q * (1 - q)
            if inverse is None:
                return np.r_[np.dot(w, y * eta - np.logaddexp(0, eta)), ((x * v[:, None]).T @ x)[upper]]
            residual = w * (y - q)
            if inverse is not False:
                residual = residual + v * ((x @ inverse) * x).sum(axis=1) * (0.5 - q)
            return x.T @ residual

        return self._pass(each(kernel), list(asked))

    def square(self, triangle: np.ndarray) -> np.ndarray:
        """The symmetric matrix with this upper triangle."""
        full = np.zeros((self.columns, self.columns))
        full[np.triu_indices(self.columns)] = triangle
        return full + np.triu(full, 1).T

    def information(self, betas: dict[int, np.ndarray], weights: dict[int, np.ndarray]):
        """Weighted log-likelihood and expected information per fit."""
        found = self._answers({k: (b, None) for k, b in betas.items()}, weights)
        return {k: (float(v[0]), self.square(v[1:])) for k, v in found.items()}

    def gradient(self, betas: dict[int, np.ndarray], weights: dict[int, np.ndarray], inverses: dict[int, np.ndarray] | None = None):
        """Score per fit; with ``inverses`` the bias-reducing leverage term is added."""
        return self._answers({k: (b, inverses[k] if inverses else False) for k, b in betas.items()}, weights)

    def score_and_information(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Unweighted log-likelihood, score and information at one point, in a single pass."""
        p, upper = self.columns, np.triu_indices(self.columns)

        def kernel(_, x, y, code):
            eta = x @ beta
            q = _logistic(eta)
            info = (x * (q * (1 - q))[:, None]).T @ x
            return np.r_[np.dot(y, eta) - np.logaddexp(0, eta).sum(), x.T @ (y - q), info[upper]]

        v = self._pass(each(kernel), [0])[0]
        return float(v[0]), v[1:p + 1], self.square(v[p + 1:])

    def state_scores(self, beta: np.ndarray) -> np.ndarray:
        """Sum of score contributions per state: states x columns."""
        size, p = len(self.levels), self.columns

        def kernel(_, x, y, code):
            out = np.zeros((size, p))
            np.add.at(out, code, x * (y - _logistic(x @ beta))[:, None])
            return out.ravel()

        return self._pass(each(kernel), [0])[0].reshape(size, p)


class Climb:
    """The ascent of one fit as questions and answers, so that fits in different phases share a pass.

    Firth's estimate is the mode of the likelihood times the square root of the information determinant (Jeffreys'
    prior). ``question`` is what the fit waits for: the height of a trial point, or the slope where it stands.
    A slope leads to a trial one scoring step up, at most ``MAX_STEP`` in any coordinate; a trial that lies lower
    comes back at half the distance. A fit is done when slope, last move and last gain are all within ``TOLERANCE``.
    """

    def __init__(self, attempt: int, beta: np.ndarray, rounds: int):
        self.fit, self.rounds, self.open = Fit(attempt, beta), rounds, rounds > 0
        self.height = -np.inf
        self.step, self.halved = np.zeros_like(beta), 0
        self.moved = self.gained = np.inf
        self.inverse: np.ndarray | None = None

    @property
    def question(self) -> tuple[np.ndarray, np.ndarray | None]:
        return self.fit.beta + self.step, self.inverse

    def close(self, message: str, converged: bool = False) -> None:
        self.fit.message, self.fit.converged, self.open = message, converged, False

    def hear_height(self, loglik: float, info: np.ndarray) -> None:
        sign, logdet = np.linalg.slogdet(info)
        height = loglik + 0.5 * logdet if sign > 0 else np.nan
        started = np.isfinite(self.height)
        if np.isfinite(height) and height >= self.height - ACCEPTED_DROP:
            if started:
                self.moved, self.gained = float(np.abs(self.step).max()), abs(height - self.height)
            self.fit.beta, self.height = self.fit.beta + self.step, height
            self.step, self.halved = np.zeros_like(self.step), 0
            self.fit.condition = float(np.linalg.cond(info))
            if self.fit.condition <= CONDITION_LIMIT:
                self.inverse = np.linalg.inv(info)
            else:
                self.close("near-singular information")
        elif not started:
            self.close("singular information at the start")
        elif self.halved == MAX_HALVINGS:
            self.close("no higher point along the step")
        else:
            self.step, self.halved = self.step / 2, self.halved + 1

    def hear_slope(self, slope: np.ndarray) -> None:
        fit = self.fit
        fit.iterations, fit.objective, fit.score_max = fit.iterations + 1, self.height, float(np.abs(slope).max())
        if max(fit.score_max, self.moved, self.gained) <= TOLERANCE:
            self.close("converged", True)
        elif fit.iterations >= self.rounds:
            self.close(OUT_OF_ROUNDS)
        else:
            step = self.inverse @ slope
            longest = float(np.abs(step).max())
            self.step, self.inverse = step * (MAX_STEP / longest if longest > MAX_STEP else 1.0), None


def fit_penalised(data: LogitData, attempts: Sequence[int] = (0,), raw_weights: np.ndarray | None = None,
                  max_iterations: int = MAX_ITERATIONS, start: np.ndarray | None = None) -> list[Fit]:
    """Bias-reduced weighted logits, one Fit for each attempt; what fails is recorded and keeps its number.

    State weights count in the likelihood and in the information, hence in the leverages. Up to ``FIT_BATCH``
    climbs are under way together; all of them get their next answer from one pass over the data. They start at ``start``,
    or else at the intercept of the weighted event rate.
    """
    scaled = data.weights(raw_weights)
    waiting = list(range(len(attempts)))[::-1]
    climbs: dict[int, Climb] = {}
    while waiting or any(c.open for c in climbs.values()):
        active = [i for i, c in climbs.items() if c.open]
        while waiting and len(active) < FIT_BATCH:
            i = waiting.pop()
            events = float(scaled[i] @ data.events + 0.5)
            others = float(scaled[i] @ (data.n - data.events) + 0.5)
            beta = np.zeros(data.columns) if start is None else np.array(start, dtype=float)
            if start is None:
                beta[0] = np.log(events / others)
            climbs[i] = Climb(attempts[i], beta, max_iterations)
            if climbs[i].open:
                active.append(i)
        if not active:
            continue
        found = data._answers({i: climbs[i].question for i in active}, {i: scaled[i] for i in active})
        for i in active:
            if climbs[i].inverse is None:
                climbs[i].hear_height(float(found[i][0]), data.square(found[i][1:]))
            else:
                climbs[i].hear_slope(found[i])
    return [climbs[i].fit for i in range(len(attempts))]


@dataclass
class ClusteredFit:
    fit: Fit
    covariance: np.ndarray


def fit_clustered(data: LogitData, max_iterations: int = 50, tolerance: float = 1e-8) -> ClusteredFit:
    """Unpenalised maximum likelihood with a state-cluster sandwich covariance.

    Under separation the likelihood has no maximum: the coefficients run away, the fit is reported
    as not converged and the covariance is NaN.
    """
    p = data.columns
    fit = Fit(0, np.zeros(p))
    info = np.eye(p)
    for iteration in range(1, max_iterations + 1):
        loglik, score, info = data.score_and_information(fit.beta)
        fit.iterations, fit.objective, fit.score_max = iteration, loglik, float(np.abs(score).max())
        fit.condition = float(np.linalg.cond(info))
        if not fit.condition <= CONDITION_LIMIT or np.abs(fit.beta).max() > 50:
            fit.message = "no finite maximum: separation or a singular design"
            break
        step = np.linalg.solve(info, score)
        if fit.score_max <= tolerance * max(data.n.sum(), 1) and np.abs(step).max() <= 1e-6:
            fit.converged, fit.message = True, "score and step criteria satisfied"
            break
        fit.beta = fit.beta + step * min(1.0, MAX_STEP / max(float(np.abs(step).max()), 1e-30))
    if not fit.converged:
        return ClusteredFit(fit, np.full((p, p), np.nan))
    scores = data.state_scores(fit.beta)
    groups, n = len(data.levels), data.n.sum()
    correction = groups / (groups - 1) * (n - 1) / (n - p)
    bread = np.linalg.inv(info)
    return ClusteredFit(fit, correction * bread @ (scores.T @ scores) @ bread)


def refit_attempts(data: LogitData, schedule: np.ndarray, done: Sequence[int] = ()) -> list[Fit]:
    """Re-estimates every scheduled attempt not in ``done``; failures are recorded once, never redrawn."""
    todo = [i for i in range(len(schedule)) if i not in set(done)]
    return fit_penalised(data, todo, schedule[todo]) if todo else []


def fit_rows(spark, variant: str, columns: Sequence[str], fits: Sequence[Fit]) -> DataFrame:
    """The attempt table: one row per (variant, attempt), coefficients as an array."""
    rows = [(variant, f.attempt, f.converged, f.message, f.iterations, float(f.objective), list(columns), [float(b) for b in f.beta]) for f in fits]
    return spark.createDataFrame(
        rows, "variant string, attempt int, successful boolean, message string, iterations int, objective double, columns array<string>, beta array<double>"
    )


# ---- Spark ML models ------------------------------------------------------------------------


def elastic_net_grid(train: DataFrame, validation: DataFrame, strengths: Sequence[float], ratios: Sequence[float],
                     max_iterations: int = 200, parallelism: int = 4) -> tuple[DataFrame, object]:
    """Fixed chronological validation over a grid of (C, l1 ratio); returns the table and the best model.

    Inputs carry ``label`` and vector ``features``; fits run side by side on the same staged rows.
    """
    train, validation = staged(train.select("label", "features")), staged(validation.select("label", "features"))
    n = train.count()

    def one(setting):
        c, ratio = setting
        model = LogisticRegression(
            regParam=1 / (c * n), elasticNetParam=ratio, standardization=False, family="binomial", maxIter=max_iterations, tol=1e-6
        ).fit(train)
        p = F.least(F.greatest(F.get(vector_to_array("probability"), F.lit(1)), F.lit(1e-15)), F.lit(1 - 1e-15))
        loss_col = -(F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p))
        value = model.transform(validation).agg(F.avg(loss_col)).first()[0]
        iterations = model.summary.totalIterations
        return c, ratio, float(value), int(iterations), iterations < max_iterations, model

    with ThreadPoolExecutor(parallelism) as pool:
        results = list(pool.map(one, [(c, r) for c in strengths for r in ratios]))
    usable = [r for r in results if r[4]]
    best = min(usable, key=lambda r: r[2]) if usable else None
    rows = [(float(c), float(r), v, i, ok, best is not None and (c, r) == best[:2]) for c, r, v, i, ok, _ in results]
    table = train.sparkSession.createDataFrame(
        rows, "c double, l1_ratio double, validation_log_loss double, iterations int, converged boolean, selected boolean"
    )
    return table, best and best[5]


def labelled(design: Design, df: DataFrame) -> DataFrame:
    keep = [c for c in ("row_id", "label") if c == "label" or c in df.columns]
    rows = design.rows(df.withColumn("label", F.col("Y").cast("double")), keep)
    return rows.select(*keep, array_to_vector("x").alias("features"))


def boosted_trees(train: DataFrame, numeric: Sequence[str], seed: int, categorical: Sequence[str] = ("loan_type", "size_band", "age_group"),
                  rounds: int = 20, depth: int = 4):
    """A boosted-tree benchmark with fixed settings; a table that lacks an input is refused."""
    lacking = sorted({*numeric, *categorical} - set(train.columns))
    if lacking:
        raise ValueError(f"training rows lack {', '.join(lacking)}")
    stages = [
        Imputer(inputCols=list(numeric), outputCols=[f"_n_{c}" for c in numeric], strategy="median"),
        StringIndexer(inputCols=list(categorical), outputCols=[f"_c_{c}" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=[f"_n_{c}" for c in numeric] + [f"_c_{c}" for c in categorical], outputCol="features"),
        GBTClassifier(labelCol="label", maxDepth=depth, maxIter=rounds, stepSize=0.1, minInstancesPerNode=50, subsamplingRate=0.8,
                      featureSubsetStrategy="all", seed=seed),
    ]
    rows = staged(train.select(F.col("Y").cast("double").alias("label"), *numeric, *categorical))
    return Pipeline(stages=stages).fit(rows)


def stopped_trees(train: DataFrame, validation: DataFrame, numeric: Sequence[str], seed: int, categorical: Sequence[str] = ("loan_type", "size_band", "age_group"),
                  limit: int = 200, depth: int = 4, tolerance: float = 1e-3):
    """Boosted trees that stop on later rows; returns the model and its number of rounds.

    Medians and categories come from training rows alone. Boosting ends when a round lowers the loss on the validation rows by less
    than ``tolerance``, relative to that loss, or at ``limit``; trees after the best round are cut off, so what remains is the
    fit of the training rows at the chosen number of rounds. ``boosted_trees(rounds=...)`` repeats it on other rows.
    """
    lacking = sorted({*numeric, *categorical} - (set(train.columns) & set(validation.columns)))
    if lacking:
        raise ValueError(f"training or validation rows lack {', '.join(lacking)}")
    inputs = [F.col("Y").cast("double").alias("label"), *numeric, *categorical]
    rows = staged(train.select(*inputs, F.lit(False).alias("_later")).unionByName(validation.select(*inputs, F.lit(True).alias("_later"))))
    shape = Pipeline(stages=[
        Imputer(inputCols=list(numeric), outputCols=[f"_n_{c}" for c in numeric], strategy="median"),
        StringIndexer(inputCols=list(categorical), outputCols=[f"_c_{c}" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=[f"_n_{c}" for c in numeric] + [f"_c_{c}" for c in categorical], outputCol="features"),
    ]).fit(rows.where("not _later"))
    trees = GBTClassifier(labelCol="label", maxDepth=depth, maxIter=limit, stepSize=0.1, minInstancesPerNode=50, subsamplingRate=0.8,
                          featureSubsetStrategy="all", seed=seed, validationIndicatorCol="_later", validationTol=tolerance)
    model = trees.fit(staged(shape.transform(rows).select("label", "features", "_later")))
    return PipelineModel([*shape.stages, model]), model.getNumTrees


def tree_scores(model, df: DataFrame, name: str = "p") -> DataFrame:
    scored = model.transform(df.withColumn("label", F.lit(0.0)))
    extra = [c for c in scored.columns if c not in df.columns and c != "probability"]
    return scored.withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop(*extra, "probability")


# ---- calibration, associations, projections -------------------------------------------------


def calibration_table(scored: DataFrame, cohort: str, state: str, score: str = "p") -> DataFrame:
    """Intercept and slope of the outcome on the logit score, per cohort."""
    groups = staged(bootstrap.compacted(scored, cohort, state, score))
    levels = bootstrap.cluster_levels(groups)
    lines = bootstrap.calibration_lines(groups, levels, np.ones((1, len(levels))))
    rows = [(c, *(None if np.isnan(v) else float(v) for v in line[0])) for c, line in lines.items()]
    return scored.sparkSession.createDataFrame(rows, "cohort string, calibration_intercept double, calibration_slope double")


def logit(p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.ln(clipped / (1 - clipped))


def calibrated(p: Column, intercept: float, slope: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(float(intercept)) + F.lit(float(slope)) * logit(p))))


def average_associations(df: DataFrame, design: Design, beta: Sequence[float]) -> DataFrame:
    """Mean derivative of numeric inputs and mean discrete contrast of category levels, in points.

    All contrasts are columns of one aggregate over one scan.
    """
    weights = dict(zip(design.columns, map(float, beta), strict=True))
    rows = design.linear(df, beta)
    rows = rows.withColumns({f"_pool_{c}": F.expr(design.pooled(c)) for c in design.categorical})
    cells: list[tuple[str, str]] = []
    sigma = "1 / (1 + exp(-({})))"
    for c in design.numeric:
        if c in weights:
            p = sigma.format("eta")
            cells.append((c, f"100 * avg(({p}) * (1 - ({p}))) * {weights[c]!r}D / {design.scale[c]!r}D"))
    for c in design.categorical:
        own = [lv for lv in design.levels[c][1:] if f"{c}_{lv}" in weights]
        effect = " ".join(f"when '{lv}' then {weights[f'{c}_{lv}']!r}D" for lv in own)
        base = f"(eta - case _pool_{c} {effect} else 0D end)" if own else "eta"
        for lv in own:
            lifted = sigma.format(f"{base} + {weights[f'{c}_{lv}']!r}D")
            cells.append((f"{c}_{lv}", f"100 * avg({lifted} - {sigma.format(base)})"))
    wide = rows.agg(F.count("*").alias("n"), *[F.expr(f"{sql} as _a{i}") for i, (_, sql) in enumerate(cells)])
    return stacked(wide, ["n"], ["feature", "value"], [(name, F.col(f"_a{i}")) for i, (name, _) in enumerate(cells)])


def finite_change(df: DataFrame, design: Design, beta: Sequence[float], feature: str, groups: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """Mean change in points when the feature rises by one unit, overall and by group."""
    weights = dict(zip(design.columns, map(float, beta), strict=True))
    if feature not in weights:
        raise ValueError(f"{feature} is not identified in this design")
    step = weights[feature] / design.scale[feature]
    rows = design.linear(df, beta).withColumn("_d", F.expr(f"100 * (1 / (1 + exp(-(eta + {step!r}D))) - 1 / (1 + exp(-eta)))"))
    sums = loss.group_sums(rows, {"n": F.lit(1).cast("long"), "_s": F.col("_d")}, groups=groups)
    return sums.select("group_name", "group_value", "n", (F.col("_s") / F.col("n")).alias("value"))


def linear_attribution(df: DataFrame, design: Design, beta: Sequence[float]) -> DataFrame:
    """Mean absolute contribution of numeric inputs over all rows, in one aggregation."""
    weights = dict(zip(design.columns, map(float, beta), strict=True))
    parts = design.parts()
    used = [c for c in design.numeric if c in weights]
    wide = df.agg(F.count("*").alias("n"), *[F.expr(f"avg(abs({weights[c]!r}D * {parts[c]})) as _{c}") for c in used])
    return stacked(wide, ["n"], ["feature", "value"], [(c, F.col(f"_{c}")) for c in used])


def eigen_root(covariance: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    """A matrix R with R R' the covariance; an eigenvalue below zero beyond rounding is refused."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    if values.min() < -tolerance * max(values.max(), 1e-30):
        raise ValueError(f"a covariance has the eigenvalue {values.min():.3g}")
    return vectors * np.sqrt(np.clip(values, 0, None))


def normal_draws(beta: np.ndarray, covariance: np.ndarray, draws: int, seed: int) -> np.ndarray:
    noise = np.random.default_rng(seed).standard_normal((draws, len(beta)))
    return beta + noise @ eigen_root(covariance).T


def drawwise_projection(portfolio: DataFrame, scenarios: DataFrame, design: Design, betas: np.ndarray, severity: DataFrame,
                        groups: Sequence[str] = GROUP_KEYS, draws: Sequence[int] | None = None) -> DataFrame:
    """The scenario projection for every coefficient draw: ``draw`` joins the long metrics, numbered from 0 or as ``draws`` says.

    Rows are never multiplied by draws. A partition turns its rows into one vector of length
    ``draws`` per sum and group, a product of a group indicator with the score matrix, and only
    those vectors are shuffled.
    """
    inputs = apply_scenarios(portfolio, scenarios)
    with_lgd = loss.assign_severity(inputs, severity)
    lgd = [f"lgd_{v}" for v in loss.VARIANTS]
    rows = design.rows(with_lgd, ["scenario", *groups, "guarantee_share", "GrossApproval", *lgd])
    names = ["pd_sum", *[f"{v}_{part}" for v in loss.VARIANTS for part in ("total", "sponsor", "lender")]]
    keys = ["scenario", "group_name", "group_value"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.drop_columns(["x"]).to_pandas()
            share, ead = flat["guarantee_share"].to_numpy(dtype=float), flat["GrossApproval"].to_numpy(dtype=float)
            ok = np.isfinite(share)
            g, exposure = np.where(ok, share, 0.0), np.where(ok, ead, 0.0)
            scale = [np.ones(len(flat))]
            for c in lgd:
                el = flat[c].to_numpy(dtype=float) * exposure
                scale += [el, el * g, el * (1 - g)]
            p = _logistic(matrix(batch) @ betas.T)
            counts = np.stack([scale[0], ok.astype(float), exposure], axis=1)
            labels: list[tuple] = []
            rows_of: list[np.ndarray] = []
            for name in ("overall", *groups):
                by = ["scenario"] if name == "overall" else ["scenario", name]
                for key, at in flat.groupby(by, sort=False).indices.items():
                    key = key if isinstance(key, tuple) else (key,)
                    labels.append((key[0], name, "all" if name == "overall" else key[1]))
                    rows_of.append(at)
            inside = np.zeros((len(labels), len(flat)))
            for i, at in enumerate(rows_of):
                inside[i, at] = 1.0
            sums = np.concatenate([(inside * s) @ p for s in scale] + [inside @ counts], axis=1)
            for label, part in zip(labels, sums):
                totals[label] = part if label not in totals else totals[label] + part
        if totals:
            cols = {k: [t[i] for t in totals] for i, k in enumerate(keys)}
            yield array_batch({**cols, "v": [v.tolist() for v in totals.values()]})

    schema = ", ".join(f"{k} string" for k in keys) + ", v array<double>"
    grouped = summed(rows.mapInArrow(partial, schema), "v", keys).withColumn("v", vector_to_array("v"))
    size = len(betas)
    numbers = F.array(*[F.lit(int(d)) for d in (range(size) if draws is None else draws)])
    per_draw = grouped.select("*", F.posexplode(numbers).alias("_at", "draw"))
    tail = len(names) * size
    totals = per_draw.select(
        "draw", "scenario", "group_name", "group_value", *[F.get("v", F.col("_at") + i * size).alias(n) for i, n in enumerate(names)],
        F.get("v", F.lit(tail)).cast("long").alias("pd_n"), F.get("v", F.lit(tail + 1)).cast("long").alias("loss_n"), F.get("v", F.lit(tail + 2)).alias("exposure"),
    )
    return loss.projection_metrics(totals, ["draw"])


def drawwise_example(train: DataFrame, loans: DataFrame, scenarios: DataFrame, protocol: Protocol) -> DataFrame:
    """Clustered fit with macro inputs, normal coefficient draws, projection and percentile intervals.

    ``train`` holds the rows to fit on, complete in the macro inputs; severity comes from all training loans.
    ``status`` is ``ok``, or why the fit failed; the values and bounds of a failed fit are NULL.
    """
    from .comparison import percentile_interval

    design = fit_design(train, ["log_approval", "guarantee_share", "log_jobs", *MACRO], ["loan_type", "size_band"], protocol.pooling_threshold)
    data = LogitData(design.rows(train, [F.col("ProjectState").alias("state"), "Y"]), len(design.columns))
    clustered = fit_clustered(data)
    fit = clustered.fit
    if fit.converged:
        betas, scenarios = np.vstack([fit.beta, normal_draws(fit.beta, clustered.covariance, protocol.refit_attempts, protocol.seed)]), complete_scenarios(scenarios)
    else:
        betas = np.zeros((2, len(design.columns)))
    severity = loss.severity_table(loans.where("role = 'train'"), protocol)
    rows = staged(drawwise_projection(loans.where("role = 'reference'"), scenarios, design, betas, severity))
    keys = ["scenario", "lgd_variant", "group_name", "group_value", "metric"]
    point = rows.where("draw = 0").drop("draw")
    out = point.join(percentile_interval(rows.where("draw > 0"), keys), keys).withColumn("status", F.lit("ok" if fit.converged else fit.message))
    if fit.converged:
        return out
    return out.withColumns({c: F.lit(None).cast("double") for c in ("value", "lower", "upper")} | {"effective_draws": F.lit(0).cast("long")})
