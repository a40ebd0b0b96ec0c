import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lossweave.operators import design, drift, metrics, ordered
from lossweave.session import staged


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one score; ids order as text."""
    rng = np.random.default_rng(3)
    p = np.where(rng.random(4000) < 0.34, 0.5, rng.random(4000).round(3))
    pdf = pd.DataFrame({"row_id": [f"f:{i}" for i in range(4000)], "p": p, "Y": rng.integers(0, 2, 4000), "g": rng.choice(["a", "b"], 4000, p=[0.9, 0.1])})
    return pdf, spark.createDataFrame(pdf)


def test_lowest_fraction_breaks_ties_by_id(skewed):
    pdf, df = skewed
    for fraction in (0.7, 0.3, 0.5001, 1.0, 0.0):
        want = pdf.sort_values(["p", "row_id"]).row_id[: int(np.floor(fraction * len(pdf)))]
        got = [r.row_id for r in ordered.lowest_fraction(df, ["p", "row_id"], fraction).collect()]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("small", [5, 300, 10_000])
def test_lowest_fraction_of_all_groups_at_once(spark, skewed, small):
    pdf, df = skewed
    rare = spark.createDataFrame([("r:1", 0.9, 1, None), ("r:2", 0.1, 0, None), ("r:3", 0.1, 0, None), ("q:1", 0.3, 0, "one")], "row_id string, p double, Y long, g string")
    rows = df.select("row_id", "p", "Y", "g").unionByName(rare)
    got = ordered.lowest_fraction(rows, ["p", "row_id"], 0.7, by=["g"], small=small).toPandas()
    for g, part in rows.toPandas().groupby("g", dropna=False):
        want = part.sort_values(["p", "row_id"]).row_id[: int(np.floor(0.7 * len(part)))]
        mine = got[got.g.isna()] if pd.isna(g) else got[got.g == g]
        assert sorted(mine.row_id) == sorted(want)
    assert ordered.lowest_fraction(rows.where("false"), ["p", "row_id"], 0.7, by=["g"]).count() == 0


def test_passes_do_not_depend_on_the_number_of_groups(spark, monkeypatch):
    def writes(groups):
        rows = spark.range(24_000).select(F.concat(F.lit("i"), F.col("id")).alias("row_id"), (F.col("id") * 7919 % 9973).cast("double").alias("p"), (F.col("id") % groups).alias("g"))
        seen = []
        monkeypatch.setattr(ordered, "staged", lambda d: seen.append(1) or staged(d))
        assert ordered.lowest_fraction(rows, ["p", "row_id"], 0.5, by=["g"], small=200).count() == 12_000
        return len(seen)

    assert writes(40) <= writes(2)


def test_kth_key_refines_below_its_threshold(skewed):
    pdf, df = skewed
    keys = list(pdf.sort_values(["p", "row_id"])[["p", "row_id"]].itertuples(index=False, name=None))
    assert ordered.kth_key(df, ["p", "row_id"], 2345, small=5) == keys[2344]


def test_ranks_and_running_totals(skewed):
    pdf, df = skewed
    got = ordered.ranked(df.select("p", "row_id"), ["p", "row_id"]).toPandas().sort_values("rank")
    want = pdf.sort_values(["p", "row_id"])
    assert got.row_id.tolist() == want.row_id.tolist() and got["rank"].tolist() == list(range(1, 4001))


def test_buckets_split_a_hot_value(skewed):
    _, df = skewed
    sizes = [r["count"] for r in ordered.with_bucket(df, ["p", "row_id"], 32).groupBy("_bucket").count().collect()]
    assert max(sizes) < 4000 / 6


def test_exact_quantiles(skewed):
    pdf, df = skewed
    probs = [0, 0.01, 0.25, 0.5, 0.9, 1]
    rows = {r.g: r.quantiles for r in ordered.exact_quantiles(df, "p", probs, by=["g"]).collect()}
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(rows[g], np.quantile(part.p, probs), rtol=1e-12)
    whole = ordered.exact_quantiles(df, "p", probs).first().quantiles
    np.testing.assert_allclose(whole, np.quantile(pdf.p, probs), rtol=1e-12)


def pair_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def step_precision(y, p):
    return sum(((p == s) & (y == 1)).sum() / y.sum() * y[p >= s].mean() for s in np.unique(p))


def test_tie_exact_metrics(skewed):
    pdf, df = skewed
    rows = {r.g: r for r in metrics.ranking_metrics(df, ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        y, p = part.Y.to_numpy(), part.p.to_numpy()
        assert rows[g].auc == pytest.approx(pair_auc(y, p), abs=1e-12)
        assert rows[g].average_precision == pytest.approx(step_precision(y, p), abs=1e-12)


def test_one_class_cohorts_are_undefined(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.4)], "Y int, p double").withColumn("g", F.lit("x"))
    row = metrics.ranking_metrics(df, ["g"]).first()
    assert row.auc is None and row.average_precision is None
    assert metrics.score_validity(df, ["g"]).first().one_class
    with pytest.raises(ValueError):
        metrics.require_valid(metrics.score_validity(df.withColumn("p", F.lit(1.2)), ["g"]))


def brute_psi(a, b):
    cuts = np.unique(np.quantile(a[~np.isnan(a)], np.linspace(0, 1, 11)))[1:-1]

    def shares(x):
        n = np.append(np.bincount(np.searchsorted(cuts, x[~np.isnan(x)], side="right"), minlength=len(cuts) + 1), np.isnan(x).sum())
        s = np.maximum(n / n.sum(), 1e-6)
        return s / s.sum()

    s, t = shares(a), shares(b)
    return ((t - s) * np.log(t / s)).sum()


def test_numeric_stability_index(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=900).round(1), rng.normal(0.4, 1.2, 700).round(1)
    a[:30], b[:90] = np.nan, np.nan
    train, test = (spark.createDataFrame(pd.DataFrame({"x": v})).withColumn("c", F.lit("later")) for v in (a, b))
    row = drift.numeric_psi(train, test, ["x"], "c").first()
    assert row.psi == pytest.approx(brute_psi(a, b), abs=1e-9) and (row.train_n, row.n) == (900, 700)
    assert drift.numeric_psi(train, train, ["x"], "c").first().psi == pytest.approx(0, abs=1e-12)


def test_categorical_stability_sends_unseen_levels_to_one_bin(spark):
    train = spark.createDataFrame([("a",)] * 60 + [("b",)] * 40, "k string").withColumn("c", F.lit("x"))
    test = spark.createDataFrame([("a",)] * 50 + [("z",)] * 30 + [(None,)] * 20, "k string").withColumn("c", F.lit("x"))
    s, t = np.array([0.6, 0.4, 1e-6]), np.array([0.5, 1e-6, 0.5])
    s, t = s / s.sum(), t / t.sum()
    assert drift.categorical_psi(train, test, ["k"], "c").first().psi == pytest.approx(((t - s) * np.log(t / s)).sum(), abs=1e-9)


def pooling_frame(spark, flip=False):
    levels = ["rare"] * 2 + ["boundary"] * 3 + ["ordinary"] * 2995
    rows = [(lv, "CA NY TX".split()[i % 3], -1 + 2 * i / 2999, 2.0, (i + flip) % 2, "train", f"f:{i}") for i, lv in enumerate(levels)]
    return spark.createDataFrame(rows, "kind string, ProjectState string, x double, constant double, Y int, role string, row_id string")


def test_pooling_is_strict_exempts_states_and_ignores_the_outcome(spark):
    maps = []
    for flip in (False, True):
        rows = design.pooling_map(pooling_frame(spark, flip), ["kind", "ProjectState"], 0.001, ["ProjectState"]).collect()
        maps.append({(r.feature, r.level): r.pooled_level for r in rows})
    assert maps[0] == maps[1]
    assert maps[0][("kind", "rare")] == "Other" and maps[0][("kind", "boundary")] == "boundary"


def test_design_drops_constants_keeps_states_and_zeroes_unseen_levels(spark):
    train = pooling_frame(spark).withColumn("copy", F.col("x") * 3)
    fitted = design.fit_design(train, ["x", "copy", "constant"], ["kind", "ProjectState"])
    assert {"ProjectState_NY", "ProjectState_TX", "intercept", "x"} <= set(fitted.columns)
    assert not {"constant", "copy", "x__missing"} & set(fitted.columns)
    later = spark.createDataFrame([(None, "ZZ", None, 2.0, None)], "kind string, ProjectState string, x double, constant double, copy double")
    row = dict(zip(fitted.columns, fitted.rows(later, []).first().x))
    assert row["ProjectState_NY"] == row["ProjectState_TX"] == 0.0 and row["intercept"] == 1.0
    with pytest.raises(ValueError, match="role train"):
        design.fit_design(train.withColumn("role", F.lit("oot")), ["x"], [])


def test_contract_matches_numpy_and_later_rows_do_not_move_it(spark):
    rng = np.random.default_rng(2)
    x = rng.exponential(size=501)
    x[:50] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"x": x})).withColumn("empty", F.lit(None).cast("double"))
    rows = {r.feature: r for r in design.numeric_contract(df, ["x", "empty"]).collect()}
    med = np.nanmedian(x)
    filled = np.where(np.isnan(x), med, x)
    assert rows["x"].median == pytest.approx(med) and rows["x"].mean == pytest.approx(filled.mean()) and rows["x"].scale == pytest.approx(filled.std())
    assert (rows["empty"].median, rows["empty"].mean, rows["empty"].scale) == (0.0, 0.0, 1.0)
