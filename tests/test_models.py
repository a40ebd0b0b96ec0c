import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lossweave.operators import bootstrap, design, models


def data_of(spark, x, y, state):
    pdf = pd.DataFrame({"state": state, "Y": np.asarray(y, dtype=float), "x": [list(map(float, r)) for r in x]})
    return models.LogitData(spark.createDataFrame(pdf, "state string, Y double, x array<double>").repartition(4), x.shape[1])


def sigma(v):
    return 1 / (1 + np.exp(-v))


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    x = np.c_[np.ones(600), rng.normal(size=(600, 2))]
    y = (rng.random(600) < sigma(x @ [-1.0, 0.6, -0.4])).astype(float)
    return x, y, np.array([f"s{i % 6}" for i in range(600)])


def test_penalised_intercept_matches_closed_form(spark):
    y, state = np.array([1.0] * 7 + [0.0] * 33), np.array(["a", "b"] * 20)
    data = data_of(spark, np.ones((40, 1)), y, state)
    assert models.fit_penalised(data)[0].beta[0] == pytest.approx(np.log(7.5 / 33.5), abs=1e-6)
    raw = np.array([[2.0, 1.0]])
    fit = models.fit_penalised(data, raw_weights=raw)[0]
    w = data.weights(raw)[0][(state == "b").astype(int)]
    rate = (w @ y + 0.5) / (w.sum() + 1)
    assert fit.converged and w.sum() == pytest.approx(40) and fit.beta[0] == pytest.approx(np.log(rate / (1 - rate)), abs=1e-6)


def test_penalised_score_vanishes_and_gradient_is_right(spark, sample):
    x, y, state = sample
    data = data_of(spark, x, y, state)
    fit = models.fit_penalised(data)[0]

    def objective(b):
        eta = x @ b
        info = (x * (sigma(eta) * (1 - sigma(eta)))[:, None]).T @ x
        return (y * eta - np.logaddexp(0, eta)).sum() + 0.5 * np.linalg.slogdet(info)[1]

    assert fit.converged and fit.objective == pytest.approx(objective(fit.beta), abs=1e-8)
    at = fit.beta + 0.3
    ones = {0: np.ones(6)}
    info = data.information({0: at}, ones)[0][1]
    got = data.gradient({0: at}, ones, {0: np.linalg.inv(info)})[0]
    eye = np.eye(3) * 1e-5
    want = [(objective(at + e) - objective(at - e)) / 2e-5 for e in eye]
    np.testing.assert_allclose(got, want, rtol=1e-5)
    assert all(objective(fit.beta) >= objective(fit.beta + s * e * 1e3) for e in eye for s in (-1, 1))


def test_one_factor_fits_have_a_closed_form_also_where_a_level_is_pure(spark):
    """With one dummy per level each fitted rate is (events + 1/2) / (rows + 1), whatever the other levels hold."""
    rows, events = np.array([17, 42, 23]), np.array([0, 11, 23])
    level = np.repeat(np.arange(3), rows)
    y = np.concatenate([np.arange(n) < k for n, k in zip(rows, events)]).astype(float)
    x = np.c_[np.ones(len(y)), level == 1, level == 2].astype(float)
    data = data_of(spark, x, y, np.array(["u", "v", "w"])[np.arange(len(y)) % 3])
    fit = models.fit_penalised(data)[0]
    assert fit.converged
    np.testing.assert_allclose(sigma(fit.beta[0] + np.r_[0, fit.beta[1:]]), (events + 0.5) / (rows + 1), atol=1e-6)
    plain = models.fit_clustered(data)
    assert not plain.fit.converged and np.isnan(plain.covariance).all()
    with pytest.raises(ValueError):
        plain.fit.coefficients()


def test_singular_design_is_a_recorded_failure(spark, sample):
    x, y, state = sample
    fit = models.fit_penalised(data_of(spark, np.c_[x, x[:, 1]], y, state))[0]
    assert not fit.converged and fit.message


def test_clustered_covariance_matches_dense_algebra(spark, sample):
    x, y, state = sample
    out = models.fit_clustered(data_of(spark, x, y, state))
    q = sigma(x @ out.fit.beta)
    assert np.abs(x.T @ (y - q)).max() < 1e-4
    bread = np.linalg.inv((x * (q * (1 - q))[:, None]).T @ x)
    s = np.array([(x[state == g] * (y - q)[state == g, None]).sum(axis=0) for g in np.unique(state)])
    want = 6 / 5 * 599 / 597 * bread @ s.T @ s @ bread
    np.testing.assert_allclose(out.covariance, want, rtol=1e-6)


def test_refits_resume_to_the_same_result_and_record_failures(spark, sample):
    x, y, state = sample
    data = data_of(spark, x, y, state)
    schedule = bootstrap.multiplier_draws(data.levels, 8, 11)
    whole = {f.attempt: f for f in models.refit_attempts(data, schedule)}
    rest = {f.attempt: f for f in models.refit_attempts(data, schedule, done=[0, 1, 2, 3, 4])}
    assert sorted(rest) == [5, 6, 7] and sorted(whole) == list(range(8))
    for k in rest:
        np.testing.assert_allclose(rest[k].beta, whole[k].beta, atol=1e-9)
    stopped = models.fit_penalised(data, max_iterations=1)[0]
    table = models.fit_rows(spark, "layer1", ["a", "b", "c"], [stopped]).first()
    assert not table.successful and table.message == "iteration limit"


def newton_line(y, p, w):
    z = np.log(p) - np.log1p(-p)
    b = np.array([0.0, 1.0])
    d = np.c_[np.ones(len(z)), z]
    for _ in range(60):
        q = sigma(d @ b)
        b = b + np.linalg.solve((d * (w * q * (1 - q))[:, None]).T @ d, d.T @ (w * (y - q)))
    return b


def test_cluster_bootstrap_equals_weighted_brute_force(spark):
    rng = np.random.default_rng(9)
    n = 800
    p = rng.uniform(0.02, 0.7, n).round(2)
    pdf = pd.DataFrame({"p": p, "Y": (rng.random(n) < p).astype(int), "state": rng.choice(list("abcd"), n, p=[0.6, 0.2, 0.1, 0.1]), "cohort": rng.choice(["x", "y"], n)})
    weights = np.array([[1, 1, 1, 1], [2, 0, 1, 1], [0, 3, 0, 1], [0, 0, 0, 4]])
    out = bootstrap.metric_draws(spark.createDataFrame(pdf), "cohort", "state", weights).toPandas()
    got = out.set_index(["cohort", "metric", "draw"]).value
    for cohort, part in pdf.groupby("cohort"):
        y, s = part.Y.to_numpy(), part.p.to_numpy()
        for draw, line in enumerate(np.vstack([np.ones(4), weights])):
            w = line[part.state.map({k: i for i, k in enumerate("abcd")})]
            pos, neg = w * y, w * (1 - y)
            auc = (pos[:, None] * neg * ((s[:, None] > s) + 0.5 * (s[:, None] == s))).sum() / (pos.sum() * neg.sum())
            ap = sum(pos[s == v].sum() / pos.sum() * pos[s >= v].sum() / w[s >= v].sum() for v in np.unique(s) if w[s >= v].sum() > 0)
            line_fit = newton_line(y, s, w)
            want = [auc, ap, (w * (y - s) ** 2).sum() / w.sum(), *line_fit]
            have = [got[cohort, m, draw - 1] for m in bootstrap.METRICS]
            np.testing.assert_allclose(have, want, atol=1e-7)
    table = bootstrap.metric_intervals(spark.createDataFrame(out))
    assert table.count() == 10


def test_all_zero_outcomes_leave_every_draw_undefined(spark):
    pdf = pd.DataFrame({"p": [0.1, 0.2, 0.3, 0.4], "Y": [0, 0, 0, 0], "state": list("abab"), "cohort": "x"})
    out = bootstrap.metric_draws(spark.createDataFrame(pdf), "cohort", "state", draws=5, seed=1)
    assert out.where("value is not null").count() == 0


def test_multiplier_weights_add_up_to_the_rows(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 30)], "state string, n long")
    schedule = bootstrap.draw_table(spark, ["a", "b"], bootstrap.multiplier_draws(["a", "b"], 3, 20261008))
    sums = bootstrap.normalized_weights(schedule, counts).groupBy("draw").agg(F.sum(F.col("weight") * F.col("n")).alias("t")).collect()
    assert len(sums) == 3 and all(r.t == pytest.approx(40) for r in sums)


def test_normal_draws_refuse_an_indefinite_covariance():
    root = models.eigen_root(np.array([[2.0, 0.5], [0.5, 1.0]]))
    np.testing.assert_allclose(root @ root.T, [[2.0, 0.5], [0.5, 1.0]])
    with pytest.raises(ValueError):
        models.eigen_root(np.array([[1.0, 0.0], [0.0, -0.5]]))


def test_gram_matrix_is_the_same_in_one_round_and_in_two(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(200, 3))
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(9)
    for direct in (design.DIRECT_PARTITIONS, 1):
        monkeypatch.setattr(design, "DIRECT_PARTITIONS", direct)
        np.testing.assert_allclose(design.gram_matrix(rows, 3), x.T @ x / 200, rtol=1e-12)
    assert (design.gram_matrix(rows.where("false"), 3) == 0).all()


def test_a_batch_smaller_than_the_attempts_gives_the_same_fits(spark, sample, monkeypatch):
    x, y, state = sample
    data = data_of(spark, x, y, state)
    raw = np.random.default_rng(4).uniform(0.5, 2, size=(3, 6))
    together = models.fit_penalised(data, range(3), raw)
    monkeypatch.setattr(models, "FIT_BATCH", 2)
    for a, b in zip(together, models.fit_penalised(data, range(3), raw), strict=True):
        assert a.converged and b.converged and a.attempt == b.attempt and a.iterations == b.iterations
        np.testing.assert_allclose(a.beta, b.beta, atol=1e-9)
