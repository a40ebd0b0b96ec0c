import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lossweave.operators import loss, models
from lossweave.plans import inputs, registered
from lossweave.plans.bindings import TEST
from lossweave.plans.queries_models import BETA, CARD
from lossweave.operators.linking import apply_scenarios

SF_DIR, WHOLE_DIR = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_drawwise_projection_equals_one_projection_per_draw(spark):
    rows = inputs.loans(spark, SF_DIR)
    portfolio, scenarios = rows.where("role = 'reference'"), inputs.scenarios(spark, SF_DIR)
    severity = loss.severity_table(rows.where("role = 'train'"), TEST)
    betas = np.vstack([BETA, np.array(BETA) * 0.5])
    keys = ["scenario", "lgd_variant", "group_name", "group_value", "metric"]
    got = {tuple(r[k] for k in ["draw", *keys]): r for r in models.drawwise_projection(portfolio, scenarios, CARD, betas, severity).collect()}
    seen = 0
    for draw, beta in enumerate(betas):
        scored = CARD.linear(apply_scenarios(portfolio, scenarios), list(beta)).withColumn("p", F.expr("1 / (1 + exp(-eta))"))
        for r in loss.projection_metrics(loss.projection_totals(scored, severity)).collect():
            other = got[(draw, *[r[k] for k in keys])]
            assert other.value == pytest.approx(r.value, rel=1e-9) and (other.pd_n, other.loss_n) == (r.pd_n, r.loss_n)
            seen += 1
    assert seen == len(got)


def test_grid_selects_the_lowest_loss_among_converged_fits(spark):
    rows = inputs.loans(spark, SF_DIR)
    train, tune = (models.labelled(CARD, rows.where(f"role = '{r}'")) for r in ("train", "tune"))
    table, model = models.elastic_net_grid(train, tune, [0.01, 1.0], [0.0, 1.0])
    fits = table.collect()
    best = min((f for f in fits if f.converged), key=lambda f: f.validation_log_loss)
    assert [f for f in fits if f.selected] == [best] and model is not None


@pytest.mark.parametrize("name", ["h15_drawwise_projection", "h16_tree_projection"])
def test_fitted_projections_react_to_the_scenario(spark, name):
    rows = registered.QUERIES[name](spark, WHOLE_DIR).where("group_name = 'overall' and metric = 'pd' and lgd_variant = 'primary'").collect()
    pd = {r.scenario: r.value for r in rows}
    assert set(pd) == {"baseline", "adverse"} and abs(pd["adverse"] - pd["baseline"]) > 1e-4
    assert all(r.asDict().get("status", "ok") == "ok" for r in rows)


def test_incomplete_scenarios_are_refused(spark):
    portfolio, scenarios = inputs.loans(spark, SF_DIR).where("role = 'reference'"), inputs.scenarios(spark, SF_DIR)
    state = portfolio.first().ProjectState
    for lacking in (F.col("ProjectState") != state, (F.col("ProjectState") != state) | (F.col("scenario") != "adverse")):
        with pytest.raises(PySparkException, match="not every scenario covers"):
            apply_scenarios(portfolio, scenarios.where(lacking)).write.format("noop").mode("overwrite").save()
    with pytest.raises(PySparkException, match="incomplete scenario"):
        registered.QUERIES["h13_scenario_projection"](spark, SF_DIR).collect()
    out = registered.QUERIES["h15_drawwise_projection"](spark, SF_DIR)
    assert "status" in out.columns


def test_trees_refuse_a_table_without_an_input(spark):
    with pytest.raises(ValueError, match="lack u0"):
        models.boosted_trees(inputs.loans(spark, SF_DIR), ["log_approval", "u0"], 1)


def test_trees_stop_on_later_rows(spark):
    rng = np.random.default_rng(4)
    x, z = rng.normal(size=2400), rng.normal(size=2400)
    y = (rng.random(2400) < np.where(x > 0, 0.8, 0.2)).astype(int)
    rows = spark.createDataFrame(pd.DataFrame({"x": x, "z": np.where(z > 1.5, np.nan, z), "Y": y, "kind": rng.choice(["a", "b"], 2400), "later": np.arange(2400) >= 1600}))
    train, later = rows.where("not later"), rows.where("later").withColumn("kind", F.lit("unseen"))
    model, rounds = models.stopped_trees(train, later, ["x", "z"], 1, ["kind"], limit=80, depth=2)
    assert 1 <= rounds < 80 and len(model.stages[-1].trees) == rounds
    fixed = models.boosted_trees(train, ["x", "z"], 1, ["kind"], rounds=rounds, depth=2)
    a, b = (models.tree_scores(m, later).agg(F.avg("p")).first()[0] for m in (model, fixed))
    assert abs(a - b) < 0.02
    with pytest.raises(ValueError, match="lack"):
        models.stopped_trees(train, later.drop("z"), ["x", "z"], 1, ["kind"])
