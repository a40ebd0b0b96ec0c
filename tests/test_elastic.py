import numpy as np
import pytest

from lossweave.operators import elastic, models
from tests.test_models import data_of, sigma


@pytest.fixture(scope="module")
def cohorts(spark):
    rng = np.random.default_rng(11)
    x = np.c_[np.ones(900), rng.normal(size=(900, 5))]
    y = (rng.random(900) < sigma(x @ [-0.8, 1.0, -0.7, 0.0, 0.0, 0.3])).astype(float)
    state = np.array([f"s{i % 5}" for i in range(900)])
    return (x[:600], y[:600]), (x[600:], y[600:]), data_of(spark, x[:600], y[:600], state[:600]), data_of(spark, x[600:], y[600:], state[600:])


SETTINGS = elastic.grid(np.logspace(-4, 2, 10), [0, 0.25, 0.5, 0.75, 1])


def test_every_setting_is_at_its_minimum(cohorts):
    (x, y), _, train, _ = cohorts
    fits = elastic.fit_settings(train, SETTINGS)
    assert len(fits) == 50 and all(f.converged for f in fits)
    rng = np.random.default_rng(2)
    for (c, ratio), fit in zip(SETTINGS, fits):
        def cost(b, c=c, ratio=ratio):
            return np.logaddexp(0, x @ b).sum() - y @ (x @ b) + (ratio * np.abs(b[1:]).sum() + (1 - ratio) / 2 * (b[1:] ** 2).sum()) / c

        g = x.T @ (sigma(x @ fit.beta) - y) + np.r_[0, (1 - ratio) / c * fit.beta[1:]]
        away = np.where(fit.beta != 0, g + np.r_[0, np.full(5, ratio / c)] * np.sign(fit.beta), np.sign(g) * np.maximum(np.abs(g) - np.r_[0, np.full(5, ratio / c)], 0))
        assert np.abs(away).max() <= 1e-6 * len(y)
        assert all(cost(fit.beta) <= cost(fit.beta + 1e-3 * rng.normal(size=6)) + 1e-9 for _ in range(5))
    strong = fits[SETTINGS.index((SETTINGS[0][0], 1.0))]
    assert not strong.beta[1:].any() and strong.beta[0] == pytest.approx(np.log(y.mean() / (1 - y.mean())), abs=1e-5)


def test_path_selects_the_lowest_later_loss_and_a_refit_starts_there(spark, cohorts):
    _, (x, y), train, later = cohorts
    table, best = elastic.selected_path(spark, train, later, SETTINGS)
    rows = table.toPandas()
    fits = elastic.fit_settings(train, SETTINGS)
    q = [sigma(x @ f.beta) for f in fits]
    np.testing.assert_allclose(rows.validation_log_loss, [-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() for p in q], rtol=1e-9)
    at = int(rows.validation_log_loss.idxmin())
    assert rows.selected.tolist() == [i == at for i in range(50)] and np.array_equal(best.beta, fits[at].beta)
    again = elastic.fit_settings(train, [SETTINGS[at]], start=best.beta)[0]
    assert again.converged and again.iterations == 1
    table, best = elastic.selected_path(spark, train, later, SETTINGS[:3], rounds=1)
    assert best is None and not table.where("converged or selected").count()


def test_all_settings_share_a_pass(cohorts, monkeypatch):
    train, passes = cohorts[2], []
    plain = models.LogitData._pass
    monkeypatch.setattr(models.LogitData, "_pass", lambda self, kernel, keys: passes.append(len(keys)) or plain(self, kernel, keys))
    fits = elastic.fit_settings(train, SETTINGS)
    assert passes[0] == 50 and len(passes) <= max(f.iterations for f in fits) + 5


def test_information_of_all_settings_comes_from_the_same_products():
    rng = np.random.default_rng(4)
    level = rng.integers(0, 7, 400)
    x = np.c_[np.ones(400), rng.normal(size=(400, 3)), level[:, None] == np.arange(1, 7), np.zeros(400)]
    v = rng.random((400, 9))
    plain = [((x * w[:, None]).T @ x)[np.triu_indices(11)] for w in v.T]
    np.testing.assert_allclose(models.triangles(x, v), plain, rtol=1e-12, atol=1e-12)
