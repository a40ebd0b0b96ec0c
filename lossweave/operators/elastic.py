"""Elastic-net logits for a whole grid of penalties, all settings on the same passes over the data.

Minimised is ``-loglik + (ratio * |b|_1 + (1 - ratio) / 2 * |b|_2^2) / c`` with a free intercept (column 0). Every round is
one pass: each partition returns one height, slope and information per open setting. The driver then minimises the penalised
quadratic of a setting coordinate by coordinate (a columns x columns problem) and asks for the next trial point.
A trial that does not lower the objective comes back at half the distance. A setting is done when its largest
subgradient is below a tolerance per row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .models import FIT_BATCH, OUT_OF_ROUNDS, Fit, LogitData, _logistic, each, triangles

TOLERANCE = 1e-7
SWEEPS = 2_000
SMALLEST_STEP = 2.0**-25
CLIP = 1e-15


class Descent:
    """One setting: where it stands, and the trial point it waits to hear about."""

    def __init__(self, attempt: int, c: float, ratio: float, start: np.ndarray, rounds: int):
        self.fit, self.rounds, self.open = Fit(attempt, start), rounds, rounds > 0
        self.lasso = np.full(len(start), ratio / c)
        self.ridge = np.full(len(start), (1 - ratio) / c)
        self.lasso[0] = self.ridge[0] = 0.0
        self.cost = np.inf
        self.step, self.scale = np.zeros_like(start), 1.0

    @property
    def question(self) -> np.ndarray:
        return self.fit.beta + self.scale * self.step

    def penalty(self, b: np.ndarray) -> float:
        return float(self.lasso @ np.abs(b) + 0.5 * self.ridge @ (b * b))

    def violation(self, slope: np.ndarray, b: np.ndarray) -> float:
        """Largest distance of a subgradient of the objective from zero; ``slope`` is that of the log-likelihood."""
        g = self.ridge * b - slope
        return float(np.where(b != 0, np.abs(g + self.lasso * np.sign(b)), np.maximum(np.abs(g) - self.lasso, 0)).max())

    def direction(self, slope: np.ndarray, info: np.ndarray) -> np.ndarray:
        """Step to the minimum of the penalised quadratic: sweeps over the coordinates find which ones are zero and the signs
        of the others, and one linear system then gives the minimum itself, if its own signs and slopes agree."""
        b, at = self.fit.beta, self.fit.beta.copy()
        curved, pull = np.diag(info) + self.ridge, slope.copy()  # pull: slope of the quadratic at ``at``
        target, scale = slope + info @ b, max(1.0, float(np.abs(b).max()))
        for turn in range(SWEEPS):
            moved = 0.0
            for j in np.flatnonzero(curved > 0):
                aim = pull[j] + info[j, j] * at[j]
                new = np.sign(aim) * max(abs(aim) - self.lasso[j], 0.0) / curved[j]
                if new != at[j]:
                    pull -= info[:, j] * (new - at[j])
                    moved = max(moved, abs(new - at[j]))
                    at[j] = new
            if moved <= 1e-12 * scale:
                break
            if turn % 4 == 3 and (exact := self.on_support(at, target, info)) is not None:
                return exact - b
        return at - b

    def on_support(self, at: np.ndarray, target: np.ndarray, info: np.ndarray) -> np.ndarray | None:
        """The minimum among points with the zeros and signs of ``at``, or None if it is not the minimum of all points."""
        support = (at != 0) | (self.lasso == 0)
        cell = info[np.ix_(support, support)] + np.diag(self.ridge[support])
        signs = np.sign(at[support])
        try:
            values = np.linalg.solve(cell, target[support] - self.lasso[support] * signs)
        except np.linalg.LinAlgError:
            return None
        if not np.isfinite(values).all() or ((np.sign(values) != signs) & (self.lasso[support] > 0)).any():
            return None
        found = np.zeros_like(at)
        found[support] = values
        outside = np.abs(target - info @ found)[~support] <= self.lasso[~support]
        return found if outside.all() else None

    def hear(self, loglik: float, slope: np.ndarray, info: np.ndarray, rows: float) -> None:
        point = self.question
        cost = self.penalty(point) - loglik
        if cost <= self.cost + 1e-12 * max(1.0, abs(cost)):
            fit = self.fit
            fit.beta, self.cost, self.scale = point, cost, 1.0
            fit.iterations, fit.objective, fit.score_max = fit.iterations + 1, -cost, self.violation(slope, point)
            if fit.score_max <= TOLERANCE * rows:
                fit.converged, fit.message, self.open = True, "converged", False
            elif fit.iterations >= self.rounds:
                fit.message, self.open = OUT_OF_ROUNDS, False
            else:
                self.step = self.direction(slope, info)
        elif self.scale > SMALLEST_STEP:
            self.scale /= 2
        else:
            self.fit.message, self.open = "no lower point along the step", False


def fit_settings(data: LogitData, settings: Sequence[tuple[float, float]], rounds: int = 100, start: np.ndarray | None = None) -> list[Fit]:
    """One Fit for each ``(c, l1 ratio)``. They start at ``start`` (say, an optimum found before) or at the intercept of the event rate."""
    first = np.zeros(data.columns)
    if start is None:
        events, rows = data.events.sum(), data.n.sum()
        first[0] = np.log((events + 0.5) / (rows - events + 0.5))
    else:
        first[:] = start
    runs = [Descent(i, c, ratio, first.copy(), rounds) for i, (c, ratio) in enumerate(settings)]
    p = data.columns
    while any(r.open for r in runs):
        asked = {r.fit.attempt: r.question for r in runs if r.open}
        asked = dict(list(asked.items())[:FIT_BATCH])

        def kernel(keys, x, y, code):
            eta = x @ np.array([asked[k] for k in keys]).T  # noqa: B023
            q = _logistic(eta)
            height = y @ eta - np.logaddexp(0, eta).sum(axis=0)
            return np.c_[height, (y[:, None] - q).T @ x, triangles(x, q * (1 - q))]

        for k, v in data._pass(kernel, list(asked)).items():
            runs[k].hear(float(v[0]), v[1 : p + 1], data.square(v[p + 1 :]), float(data.n.sum()))
    return [r.fit for r in runs]


def log_losses(data: LogitData, betas: Sequence[np.ndarray]) -> np.ndarray:
    """Mean log loss of each coefficient vector, all in one pass."""

    def kernel(k, x, y, code):
        q = np.clip(_logistic(x @ betas[k]), CLIP, 1 - CLIP)
        return np.array([-(y * np.log(q) + (1 - y) * np.log1p(-q)).sum()])

    found = data._pass(each(kernel), range(len(betas)))
    return np.array([found[k][0] for k in range(len(betas))]) / data.n.sum()


def grid(strengths: Sequence[float], ratios: Sequence[float]) -> list[tuple[float, float]]:
    """Settings ratio by ratio, strengths ascending: of equal losses the first one wins."""
    return [(float(c), float(r)) for r in ratios for c in sorted(strengths)]


def selected_path(spark: SparkSession, train: LogitData, validation: LogitData, settings: Sequence[tuple[float, float]],
                  rounds: int = 100) -> tuple[DataFrame, Fit | None]:
    """Table of all settings with their loss on later rows, and the converged fit with the lowest one (None without any)."""
    fits = fit_settings(train, settings, rounds)
    losses = log_losses(validation, [f.beta for f in fits])
    usable = [i for i, f in enumerate(fits) if f.converged]
    best = min(usable, key=lambda i: losses[i]) if usable else None
    rows = [(*settings[i], float(losses[i]), f.iterations, int(np.count_nonzero(f.beta[1:])), f.converged, i == best) for i, f in enumerate(fits)]
    table = spark.createDataFrame(
        rows, "c double, l1_ratio double, validation_log_loss double, iterations int, nonzero int, converged boolean, selected boolean"
    )
    return table, None if best is None else fits[best]
