import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lossweave.config import Protocol
from lossweave.operators import comparison, linking, loss, registry, textscan, timing

PROTOCOL = Protocol()
EVENTS = "role string, Y int, year int, loan_type string, size_band string, GrossApproval double, GrossChargeOffAmount double"


def severity_rows(spark, extra=()):
    years = [1990] * 10 + [1991] * 30 + [2000] * 30 + [2002] * 30
    rows = [("train", 1, years[i], "term", "<=150k" if i < 60 else ">1m", 100.0, 120.0 if i < 60 else 40.0) for i in range(100)]
    return spark.createDataFrame(rows + list(extra), EVENTS)


def cells(spark, **kw):
    return {(r.variant, r.loan_type, r.size_band): r for r in loss.severity_table(severity_rows(spark, **kw), PROTOCOL).collect()}


def test_severity_pools_small_cells(spark):
    t = cells(spark)
    assert len(t) == 36
    assert t["primary", "term", "<=150k"].lgd == pytest.approx(1.2) and t["primary", "term", "<=150k"].pool == "cell"
    assert t["primary", "term", ">1m"].lgd == pytest.approx(0.88) and t["primary", "term", ">1m"].pool == "loan_type"
    assert t["primary", "unknown", ">1m"].pool == "overall" and t["primary", "unknown", ">1m"].cell_events == 0
    assert t["capped", "term", "<=150k"].lgd == pytest.approx(1.0)
    assert t["primary", "term", "<=150k"].ratios_above_one == 60
    down = t["downturn", "term", "<=150k"]
    assert (down.valid_cell_n, down.pool) == (50, "cell") and down.lgd == pytest.approx(1.2)
    assert t["downturn", "term", ">1m"].lgd == pytest.approx((50 * 120 + 10 * 40) / 6000)


def test_severity_excludes_invalid_losses_and_other_roles(spark):
    bad = [("train", 1, 1990, "term", ">1m", 100.0, -1.0), ("train", 1, 1990, "term", ">1m", 100.0, None)]
    assert cells(spark, extra=bad)["primary", "term", ">1m"].excluded_n == 2
    with pytest.raises(PySparkException, match="training rows only"):
        cells(spark, extra=[("oot", 1, 1990, "term", ">1m", 100.0, 1.0)])


def test_allocation_is_exact_and_guards_its_inputs(spark):
    df = spark.createDataFrame([(0.1, 0.5, 200.0, 0.75)], "p double, l double, e double, g double")
    total, sponsor, lender = loss.allocate(F.col("p"), F.col("l"), F.col("e"), F.col("g"))
    r = df.select(total.alias("t"), sponsor.alias("s"), lender.alias("b")).first()
    assert (r.t, r.s, r.b) == (10.0, 7.5, 2.5)
    for bad in ((1.1, 0.5, 200.0, 0.7), (0.1, -0.5, 200.0, 0.7), (0.1, 0.5, 0.0, 0.7), (0.1, 0.5, 200.0, 1.2), (float("nan"), 0.5, 200.0, 0.7)):
        with pytest.raises(PySparkException, match="invalid score"):
            spark.createDataFrame([bad], df.schema).select(total).collect()


def test_timing_audit(spark):
    origin, event = dt.date(2000, 1, 1), dt.date(2005, 1, 1)
    terms = ["60"] * 101 + ["", "garbage", "0", "-1"]
    loans = spark.createDataFrame([
        (f"f:{i}", "CHGOFF" if i < 100 else "PIF", "term", origin, dt.date(2003, 1, 1), dt.date(1999, 12, 1), event, event) for i in range(105)
    ], "row_id string, LoanStatus string, loan_type string, d date, w date, ApprovalDate date, ChargeOffDate date, PaidInFullDate date")
    raw = spark.createDataFrame([(f"f:{i}", t) for i, t in enumerate(terms)], "row_id string, TermInMonths string")
    out = {(r.scope, r.group_key): r for r in timing.timing_summary(timing.timing_rows(loans, raw)).collect()}
    overall = out["overall", "all"]
    assert (overall.valid_n, overall.term_invalid_n, overall.term_missing_n, overall.match_n) == (101, 3, 1, 101)
    assert overall.verdict == timing.UPDATED and overall.after_window_n == 100
    assert out["status", "PIF"].verdict == timing.UNVERIFIABLE
    elapsed = (event - origin).days / (365.25 / 12)
    assert overall.difference_median == pytest.approx(60 - elapsed) and overall.difference_sd == pytest.approx(0, abs=1e-9)


def test_interval_needs_two_finite_draws(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", float("nan")), ("b", 1.0)], "k string, value double")
    r = {x.k: x for x in comparison.percentile_interval(df, ["k"]).collect()}
    assert (r["a"].lower, r["a"].upper, r["a"].effective_draws, r["a"].undefined_draws) == (pytest.approx(1.025), pytest.approx(1.975), 2, 1)
    assert r["b"].lower is None and r["b"].effective_draws == 1


def test_combine_refuses_unequal_identities(spark):
    point = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, value double")
    draws = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 2.0), ("b", 1, 2.0)], "k string, draw int, value double")
    out = {r.k: r for r in comparison.combine(point, draws, ["k"], attempted=3).collect()}
    assert (out["a"].successful_draws, out["a"].attempted_draws) == (2, 3)
    with pytest.raises(ValueError, match="only a point value"):
        comparison.combine(point, draws.where("k = 'a'"), ["k"], 3)
    with pytest.raises(ValueError, match="missing from some draws"):
        comparison.combine(point, draws.where("not (k = 'b' and draw = 1)"), ["k"], 3)
    with pytest.raises(ValueError, match="apart"):
        comparison.combine(point.union(point), draws, ["k"], 3)


def test_difference_is_adverse_minus_baseline_and_parts_add_up(spark):
    rows = [(s, f"f:{i}", 0.1 * (1 + i % 3) * (2 if s == "adverse" else 1), "term", "<=150k" if i % 2 else ">1m", "72", "new", "missing", None if i == 0 else 0.5, 100.0)
            for s in ("baseline", "adverse") for i in range(20)]
    df = spark.createDataFrame(rows, "scenario string, row_id string, p double, loan_type string, size_band string, naics2 string, age_group string, maturity_group string, guarantee_share double, GrossApproval double")
    long = loss.projection_metrics(loss.projection_totals(df, loss.severity_table(severity_rows(spark), PROTOCOL)))
    assert registry.allocation_identities(long, ["scenario", "lgd_variant", "group_name", "group_value"]).count() == 0
    assert {(r.scenario, r.lgd_variant) for r in long.select("scenario", "lgd_variant").distinct().collect()} == {
        ("baseline", "primary"), ("adverse", "primary"), ("adverse", "capped"), ("adverse", "downturn")}
    overall = {(r.scenario, r.metric): r for r in long.where("group_name = 'overall' and lgd_variant = 'primary'").collect()}
    assert (overall["baseline", "pd"].pd_n, overall["baseline", "pd"].loss_n) == (20, 19)
    gap = {r.metric: r.value for r in loss.scenario_difference(long).where("group_name = 'overall'").collect()}
    assert gap["pd_change_pp"] == pytest.approx(100 * (overall["adverse", "pd"].value - overall["baseline", "pd"].value))
    assert gap["expected_loss_change"] == pytest.approx(overall["adverse", "expected_loss"].value - overall["baseline", "expected_loss"].value)


CELLS = registry.Cells("stress", ("scenario", "metric"), ("value", "pd_n"), "lower", "upper")
STRESS = "scenario string, metric string, value double, pd_n long, lower double, upper double"


def stress(spark):
    return spark.createDataFrame([("adverse", "pd", 0.1, 5, 0.05, 0.2), ("adverse", "expected_loss", 10.0, 5, None, None), ("adverse", "sponsor_loss", 4.0, 5, None, None)], STRESS)


def test_claims_verify_and_tampering_fails(spark):
    claims = registry.claims(stress(spark), CELLS)
    registry.require_verified(registry.verification(claims, registry.claims(stress(spark), CELLS)))
    units = {(r.selector["metric"], r.column): r.unit for r in claims.collect()}
    assert units["pd", "value"] == "fraction" and units["expected_loss", "value"] == "USD" and units["pd", "pd_n"] == "count"
    for broken in (claims.withColumn("value", F.col("value") + 1), claims.withColumn("unit", F.lit("x")), claims.withColumn("upper", F.lit(9.0)),
                   claims.withColumn("id", F.lit("N0")), claims.union(claims)):
        with pytest.raises(ValueError, match="do not verify"):
            registry.require_verified(registry.verification(broken, claims))
    with pytest.raises(PySparkException, match="duplicate selector"):
        registry.claims(stress(spark).union(stress(spark)), CELLS).collect()


def test_source_digest_sees_content_and_not_order(spark):
    def digest(df):
        return registry.source_digest(df).first().digest

    whole = digest(stress(spark))
    assert whole == digest(stress(spark).orderBy(F.desc("metric")).repartition(3)) == digest(stress(spark).select(*reversed(stress(spark).columns)))
    others = [stress(spark).withColumn("value", F.col("value") + 1), stress(spark).where("metric <> 'pd'"), stress(spark).union(stress(spark)), stress(spark).limit(0),
              stress(spark).withColumn("lower", F.coalesce("lower", F.lit(0.0))), stress(spark).withColumnRenamed("lower", "low")]
    assert len({whole, *map(digest, others)}) == 1 + len(others)
    pairs = [("a", "b,1:c"), ("a,1:b", "c"), (None, "-"), ("-", None), ("", None), (None, "")]
    assert len({digest(spark.createDataFrame([p], "x string, y string")) for p in pairs}) == len(pairs)


def test_a_changed_table_unseals_its_claims(spark):
    published = registry.sealed_claims(stress(spark), CELLS)
    registry.require_verified(registry.verification(published, registry.sealed_claims(stress(spark), CELLS)))
    longer = stress(spark).union(spark.createDataFrame([("adverse", "lgd", 0.3, 5, None, None)], STRESS))
    report = {r["check"]: r["n"] for r in registry.verification(published, registry.sealed_claims(longer, CELLS)).collect()}
    assert (report["claims"], report["digest_mismatch"], report["verified"], report["value_mismatch"]) == (6, 6, 0, 0)
    twice = {r["check"]: r["n"] for r in registry.verification(published.union(published.withColumn("value", F.col("value") + 1)), published).collect()}
    assert (twice["repeated_id"], twice["value_mismatch"], twice["verified"]) == (6, 6, 0)


def test_closures_count_open_groups_and_unequal_changes(spark):
    keys = ("scenario", "lgd_variant", "group_name", "group_value", "metric")
    schema = ", ".join(f"{k} string" for k in keys) + ", value double"
    metrics_ = {"expected_loss": 10.0, "sponsor_loss": 6.0, "lender_loss": 4.0}
    levels = [(s, "primary", "overall", g, m, v * k) for s, k in (("baseline", 1), ("adverse", 2)) for g in "ab" for m, v in metrics_.items()]
    changes = [("d", "primary", "overall", g, f"{m}_change", v) for g in "ab" for m, v in metrics_.items()]

    def report(lv, ch):
        both = [registry.claims(spark.createDataFrame(rows, schema), registry.Cells(name, keys, ("value",))) for name, rows in (("x", lv), ("y", ch))]
        return {r["check"]: r["n"] for r in registry.closures(both[0].unionByName(both[1]), "x", "y").collect()}

    assert report(levels, changes) == {"open_allocations": 0, "unequal_changes": 0}
    assert report([(*levels[0][:5], 11.0), *levels[1:]], changes) == {"open_allocations": 1, "unequal_changes": 1}
    assert report(levels, changes[1:]) == {"open_allocations": 0, "unequal_changes": 1}
    assert report(levels[1:], changes) == {"open_allocations": 1, "unequal_changes": 1}


def test_derived_claims_and_single_selection(spark):
    claims = registry.claims(stress(spark), CELLS).where(F.col("column") == "value")
    ids = {r.selector["metric"]: r.id for r in claims.collect()}
    specs = spark.createDataFrame([("share", "divide", ids["sponsor_loss"], ids["expected_loss"], 100.0), ("rest", "complement", ids["pd"], None, 1.0)],
                                  "alias string, operation string, left_id string, right_id string, scale double")
    assert {r.alias: r.value for r in registry.derived(claims, specs).collect()} == {"share": pytest.approx(40.0), "rest": pytest.approx(0.9)}
    assert linking.select_one(stress(spark), metric="pd").value == 0.1
    for bad in ({"scenario": "adverse"}, {"scenario": "none"}):
        with pytest.raises(ValueError, match="expected one row"):
            linking.select_one(stress(spark), **bad)


@pytest.mark.parametrize("raw, kind, number", [("", "null", None), ("3.0", "int", 3.0), ("2.5", "float", 2.5), ("NaN", "text", None), ("inf", "text", None), ("abc", "text", None)])
def test_scalar_typing(spark, raw, kind, number):
    s = spark.createDataFrame([(raw,)], "r string").select(registry.typed_scalar(F.col("r")).alias("s")).first().s
    assert (s.kind, s.number) == (kind, number)


def test_formatting(spark):
    df = spark.createDataFrame([(0.12345, 0.1, 0.2), (None, None, None)], "v double, lo double, hi double")
    out = [r.t for r in df.select(registry.formatted(F.col("v"), F.col("lo"), F.col("hi"), scale=100, digits=2).alias("t")).collect()]
    assert out == [f"{12.345:.2f} [10.00, 20.00]", "unavailable"]
    assert df.select(registry.formatted(F.lit(1234567), integer=True)).first()[0] == "1,234,567"


@pytest.mark.parametrize("text, flagged", [
    ("Calibration is solved.", 1), ("Calibration is not solved.", 0), ("We do not claim it; but calibration has been solved", 1),
    ("This establishes a causal effect\nand more", 1), ("Future work would require strong transportability.", 0), ("Nothing here.", 0),
    ("No proof, however strong transportability holds", 1),
])
def test_assertion_scan_reads_clause_by_clause(spark, text, flagged):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert textscan.assertion_scan(df, "id", "text").count() == flagged


def test_credential_scan_counts_texts_and_hits(spark):
    token = "ghp_" + "a" * 36
    df = spark.createDataFrame([(f"x {token} y {token}",), ("clean",)], "text string")
    rows = {r.pattern: (r.texts, r.hits) for r in textscan.credential_scan(df, "text").collect()}
    assert rows["code_host_token"] == (1, 2) and rows["private_key"] == (0, 0)


def test_purity_report_names_leaks(spark):
    rows = spark.createDataFrame([("train",), ("tune",)], "role string")
    report = linking.fit_purity({"m": rows}, {"m": ["log_jobs", "ChargeOffDate"]}, ["log_jobs"])
    assert {(r.role, r.outside_train, r.not_allowed) for r in report.collect()} == {("train", 0, "ChargeOffDate"), ("tune", 1, "ChargeOffDate")}
    with pytest.raises(ValueError, match="not pure"):
        linking.require_pure(report)


def test_failed_attempt_without_a_message_is_counted(spark):
    attempts = spark.createDataFrame([("a", True, None), ("a", False, None), ("a", False, "limit")], "variant string, successful boolean, message string")
    got = comparison.attempt_summary(attempts, ["variant"]).first()
    assert (got.attempted, got.successful, got.failed, got.failures) == (3, 1, 2, {"": 1, "limit": 1})
