import numpy as np
import pandas as pd
import pytest

from lossweave.operators import bootstrap, paired

STATES = list("abcd")


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(12)
    n = 600
    first = rng.uniform(0.02, 0.8, n).round(2)
    frame = pd.DataFrame({"first": first, "second": np.clip(first + rng.normal(0, 0.2, n), 0.01, 0.99).round(3), "third": 0.3})
    frame["Y"] = (rng.random(n) < first).astype(int)
    frame["state"], frame["cohort"] = rng.choice(STATES, n, p=[0.6, 0.2, 0.1, 0.1]), rng.choice(["x", "y"], n)
    frame.loc[frame.index[:9], "second"] = np.nan  # not scored by every model
    return frame


WEIGHTS = np.array([[1.0, 1, 1, 1], [2, 0, 1, 1], [0, 3, 0, 1], [0.5, 0.25, 4, 1]])


def line_of(p, y, w):
    """Intercept and slope of the outcome on the logit of the score, by short Newton steps."""
    d, b = np.c_[np.ones(len(p)), np.log(p) - np.log1p(-p)], np.array([0.0, 1.0])
    for _ in range(300):
        q = 1 / (1 + np.exp(-d @ b))
        step = np.linalg.solve((d * (w * q * (1 - q))[:, None]).T @ d, d.T @ (w * (y - q)))
        b = b + step * min(1.0, 0.5 / max(np.abs(step).max(), 1e-30))
    return b


def brute(p, y, w):
    keep = w > 0
    p, y, w = p[keep], y[keep], w[keep]
    a, b = w * y, w * (1 - y)
    auc = sum(x * (b[p < q].sum() + b[p == q].sum() / 2) for x, q in zip(a, p)) / (a.sum() * b.sum())
    ap = sum(a[p == q].sum() * a[p >= q].sum() / w[p >= q].sum() for q in np.unique(p)) / a.sum()
    line = line_of(p, y, w)
    return {"auc": auc, "average_precision": ap, "brier": (w * (p - y) ** 2).sum() / w.sum(), "calibration_intercept": line[0], "calibration_slope": line[1]}


def test_differences_equal_brute_force_on_every_draw(spark, sample):
    drawn = paired.model_draws(spark.createDataFrame(sample), ["first", "second"], "cohort", "state", WEIGHTS[1:])
    got = {(r.cohort, r.metric, r.draw): r.difference for r in paired.metric_differences(drawn, [("first", "second")]).collect()}
    whole = sample.dropna()
    seen = 0
    for cohort, part in whole.groupby("cohort"):
        for d, weights in enumerate(WEIGHTS, -1):
            w = weights[[STATES.index(s) for s in part.state]]
            a, b = (brute(part[s].to_numpy(), part.Y.to_numpy(), w) for s in ("first", "second"))
            for metric in bootstrap.METRICS:
                assert got[cohort, metric, d] == pytest.approx(a[metric] - b[metric], abs=1e-6), (cohort, metric, d)
                seen += 1
    assert seen == len(got) == 2 * 4 * 5


def test_undefined_draws_and_pairs(spark, sample):
    rows = spark.createDataFrame(sample.dropna())
    none = np.array([[1.0, 1, 1, 1], [0, 0, 0, 0]])
    drawn = paired.model_draws(rows, ["first", "second", "third"], "cohort", "state", none, metrics=("auc", "brier"))
    gaps = paired.metric_differences(drawn, [("first", "third"), ("second", "third"), ("third", "third")])
    out = {(r.cohort, r.metric, r.left): r for r in paired.difference_intervals(gaps).collect()}
    assert len(out) == 2 * 2 * 3 and all((r.effective_draws, r.undefined_draws, r.lower) == (1, 1, None) for r in out.values())
    assert all(r.value == 0 for k, r in out.items() if k[2] == "third")
    with pytest.raises(ValueError, match="different names"):
        paired.model_draws(rows, ["first", "first"], "cohort", "state", none)


def test_supplied_draw_tables(spark):
    long = [(d, s, float(WEIGHTS[d, k])) for d in range(4) for k, s in enumerate(STATES)]
    frame = spark.createDataFrame(long + [(d, "unused", 1.0) for d in range(4)], "draw int, state string, weight double")
    assert np.array_equal(bootstrap.supplied_weights(STATES, frame), WEIGHTS)
    for broken in (frame.where("draw <> 2"), frame.where("not (draw = 1 and state = 'b')")):
        with pytest.raises(ValueError, match="draw table"):
            bootstrap.supplied_weights(STATES, broken)


def test_counter_multipliers_depend_on_seed_draw_and_state_only(spark):
    states = spark.createDataFrame([(f"s{k}",) for k in range(40)] * 2, "state string")
    whole = {(r.draw, r.state): r.weight for r in bootstrap.counter_multipliers(states, 60, 7).collect()}
    part = bootstrap.counter_multipliers(states.where("state = 's3'").repartition(5), 9, 7).collect()
    assert len(whole) == 2400 and all(whole[r.draw, r.state] == r.weight for r in part) and len(part) == 9
    values = np.array(list(whole.values()))
    assert (values > 0).all() and abs(values.mean() - 1) < 0.08 and abs(np.exp(-values).mean() - 0.5) < 0.02
    assert {r.weight for r in bootstrap.counter_multipliers(states, 2, 8).collect()}.isdisjoint(values)
