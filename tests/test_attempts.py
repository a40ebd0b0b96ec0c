import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lossweave.operators import attempts, bootstrap, loss, models
from lossweave.operators.comparison import percentile_interval
from lossweave.operators.design import Design
from lossweave.operators.linking import apply_scenarios
from lossweave.plans import inputs
from lossweave.plans.bindings import TEST
from lossweave.plans.queries_models import BETA, CARD

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["intercept", "x"]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(1 - x))).astype(int)
    rows = [(str(k % 5), int(b), [1.0, float(a)]) for k, (a, b) in enumerate(zip(x, y))]
    data = models.LogitData(spark.createDataFrame(rows, "state string, Y int, x array<double>"), 2)
    return data, bootstrap.multiplier_draws(data.levels, 7, 3)


@pytest.fixture
def store(spark, tmp_path):
    return attempts.AttemptStore(spark, str(tmp_path / "attempts"))


def test_a_killed_run_goes_on_with_what_is_missing(spark, store, fitted, monkeypatch):
    data, schedule = fitted
    whole = {f.attempt: f for f in models.fit_penalised(data, range(7), schedule)}
    fit, calls = models.fit_penalised, []

    def dies_in_the_third_batch(*args, **kwargs):
        calls.append(args)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return fit(*args, **kwargs)

    monkeypatch.setattr(models, "fit_penalised", dies_in_the_third_batch)
    with pytest.raises(KeyboardInterrupt):
        attempts.refit_stored(store, "v", data, COLUMNS, schedule, "terms", batch=2)
    monkeypatch.setattr(models, "fit_penalised", fit)
    again = attempts.AttemptStore(spark, store.path)  # as a new process would
    assert sorted(r.attempt for r in again.rows("v").collect()) == [0, 1, 2, 3]
    assert attempts.refit_stored(again, "v", data, COLUMNS, schedule, "terms", batch=2) == [4, 5, 6]
    first = sorted(again.rows("v").collect())
    assert [r.attempt for r in first] == list(range(7))
    for r in first:
        np.testing.assert_allclose(r.beta, whole[r.attempt].beta, atol=1e-9)
    assert attempts.refit_stored(again, "v", data, COLUMNS, schedule, "terms") == [] and sorted(again.rows("v").collect()) == first
    assert attempts.refit_stored(again, "other", data, COLUMNS, schedule[:2], "terms") == [0, 1]


def test_changed_weights_or_terms_are_refused(store, fitted):
    data, schedule = fitted
    attempts.refit_stored(store, "v", data, COLUMNS, schedule[:3], "terms")
    changed = schedule.copy()
    changed[1, 0] *= 1.5
    with pytest.raises(ValueError, match="1 stored attempts of v, from number 1 on, .* state weights"):
        attempts.refit_stored(store, "v", data, COLUMNS, changed, "terms")
    with pytest.raises(ValueError, match="contract"):
        attempts.refit_stored(store, "v", data, COLUMNS, schedule, "new terms")
    assert store.rows("v").count() == 3
    names = attempts.weight_digests(["a", "b"], schedule[:1, :2]) + attempts.weight_digests(["a", "c"], schedule[:1, :2])
    assert names[0] != names[1]


def test_failures_are_stored_once_and_keep_their_number(store, fitted, monkeypatch):
    data, schedule = fitted
    fit = models.fit_penalised
    monkeypatch.setattr(models, "fit_penalised", lambda d, part, raw, start=None: fit(d, part, raw, max_iterations=1 if 1 in part else 100, start=start))
    attempts.refit_stored(store, "v", data, COLUMNS, schedule[:3], "terms", batch=1)
    monkeypatch.setattr(models, "fit_penalised", fit)
    assert attempts.refit_stored(store, "v", data, COLUMNS, schedule[:3], "terms") == []
    got = {r.attempt: r for r in store.rows("v").collect()}
    assert [got[k].successful for k in range(3)] == [True, False, True]
    assert got[1].beta is None and got[1].message == models.OUT_OF_ROUNDS


def test_equal_repeats_count_once_and_different_ones_fail(store, fitted):
    data, schedule = fitted
    digests = attempts.weight_digests(data.levels, schedule)
    fits = models.fit_penalised(data, [0], schedule[:1])
    for _ in range(2):
        store.append("v", "terms", digests, COLUMNS, fits)
    assert store.rows().count() == 1
    fits[0].beta = fits[0].beta + 1
    store.append("v", "terms", digests, COLUMNS, fits)
    with pytest.raises(PySparkException, match="two outcomes are stored for attempt 0"):
        store.rows().collect()


def test_a_warm_start_ends_where_a_cold_one_does(fitted):
    data, schedule = fitted
    cold = models.fit_penalised(data, range(3), schedule[:3])
    warm = models.fit_penalised(data, range(3), schedule[:3], start=models.fit_penalised(data)[0].beta)
    for a, b in zip(cold, warm):
        np.testing.assert_allclose(a.beta, b.beta, atol=1e-4)


def test_contracts_tell_designs_settings_and_rows_apart(spark):
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, 0.5), ("b", 2, 0.5)], "s string, n int, v double")
    same = rows.orderBy(F.desc("n")).repartition(3).select("v", "n", "s")
    design = Design(["x"], [], {"x": 0.0}, {"x": 0.0}, {"x": 1.0}, {})
    own = attempts.contract(design, {"t": 1}, rows)
    assert own == attempts.contract(design, {"t": 1}, same)
    others = [
        attempts.contract(design, {"t": 2}, rows), attempts.contract(Design(["x"], [], {"x": 0.5}, {"x": 0.0}, {"x": 1.0}, {}), {"t": 1}, rows),
        attempts.contract(design, {"t": 1}, rows.distinct()), attempts.contract(design, {"t": 1}, rows.fillna(0.0)), attempts.contract(design, {"t": 1}, rows.limit(0)),
    ]
    assert len({own, *others}) == 6


def test_projection_from_attempts_with_holes(spark):
    loans = inputs.loans(spark, SF_DIR)
    portfolio, scenarios = loans.where("role = 'reference'"), inputs.scenarios(spark, SF_DIR)
    severity = loss.severity_table(loans.where("role = 'train'"), TEST)
    factors = {1: 0.8, 4: 1.1, 6: 1.3}
    stored = spark.createDataFrame(
        [(k, k in factors, [float(b) * factors[k] for b in BETA] if k in factors else None, CARD.columns) for k in (6, 1, 2, 4, 5)],
        "attempt int, successful boolean, beta array<double>, columns array<string>",
    )
    keys = ["scenario", "lgd_variant", "group_name", "group_value", "metric"]
    got = {tuple(r[k] for k in keys): r for r in attempts.refit_projection(portfolio, scenarios, CARD, np.array(BETA), stored, severity).collect()}

    def one(factor):
        scored = CARD.linear(apply_scenarios(portfolio, scenarios), [b * factor for b in BETA]).withColumn("p", F.expr("1 / (1 + exp(-eta))"))
        return loss.projection_metrics(loss.projection_totals(scored, severity)).withColumn("draw", F.lit(factor))

    want = {tuple(r[k] for k in keys): r for r in one(1.0).collect()}
    bounds = {tuple(r[k] for k in keys): r for r in percentile_interval(one(0.8).unionByName(one(1.1)).unionByName(one(1.3)), keys).collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        assert r.value == pytest.approx(want[k].value) and (r.attempted_draws, r.successful_draws, r.effective_draws) == (5, 3, 3)
        assert (r.lower, r.upper) == pytest.approx((bounds[k].lower, bounds[k].upper))
    none = attempts.refit_projection(portfolio, scenarios, CARD, np.array(BETA), stored.where("not successful"), severity).collect()
    assert all((r.lower, r.upper, r.attempted_draws, r.successful_draws) == (None, None, 2, 0) for r in none) and len(none) == len(got)
    with pytest.raises(ValueError, match="twice"):
        attempts.refit_projection(portfolio, scenarios, CARD, np.array(BETA), stored.union(stored), severity)
    with pytest.raises(ValueError, match="other columns"):
        attempts.refit_projection(portfolio, scenarios, CARD, np.array(BETA), stored.withColumn("columns", F.array(F.lit("x"))), severity)


def test_a_scenario_given_twice_does_not_stand_for_another(spark):
    portfolio = spark.createDataFrame([(1, "NY"), (2, "TX")], "row_id int, ProjectState string")
    rows = [("NY", "baseline", 1.0), ("NY", "baseline", 2.0), ("TX", "adverse", 1.0), ("TX", "baseline", 0.5)]
    with pytest.raises(PySparkException, match="not every scenario covers state NY"):
        apply_scenarios(portfolio, spark.createDataFrame(rows, "ProjectState string, scenario string, u0 double")).collect()
    good = apply_scenarios(portfolio.where("ProjectState = 'TX'"), spark.createDataFrame(rows[2:], "ProjectState string, scenario string, u0 double"))
    assert sorted((r.scenario, r.u0) for r in good.collect()) == [("adverse", 1.0), ("baseline", 0.5)]
