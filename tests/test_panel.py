import json
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lossweave.config import Protocol
from lossweave.operators import linking, panel
from lossweave.session import lookup_join, scratch_path
from lossweave.sources import files

PROTOCOL = Protocol()


def series(spark, skip=(), spike=(2008, 1)):
    months = [y * 12 + m for y in range(2003, 2012) for m in range(12)]
    top = spike[0] * 12 + spike[1] - 1
    u = [("CA", m, 10.0 if m == top else 5.0) for m in months if m not in skip]
    hpi = [("CA", q, 100.0 * math.exp(0.01 * (q - 8012))) for q in range(2003 * 4, 2012 * 4)]
    return spark.createDataFrame(u, "state string, month int, u double"), spark.createDataFrame(hpi, "state string, quarter int, hpi double")


def test_peak_differs_from_endpoint_and_needs_the_whole_path(spark):
    start = 2007 * 12
    row = panel.macro_panel(*series(spark), PROTOCOL).where(F.col("month") == start).first()
    assert (row.du, row.peak_du) == (0.0, 5.0)
    assert row.h0 == pytest.approx(4.0) and row.dh == pytest.approx(12.0) and row.macro_complete
    gap = panel.macro_panel(*series(spark, skip={start + 12}), PROTOCOL).where(F.col("month") == start).first()
    assert gap.du == 0.0 and gap.peak_du is None


def test_gap_months_become_null_rows(spark):
    u, _ = series(spark, skip={2005 * 12})
    filled = panel.gap_filled(u)
    assert filled.count() == 9 * 12 and filled.where("u is null").count() == 1


def test_scenarios_use_dated_inputs_and_refuse_gaps(spark):
    rows = {r.scenario: r for r in panel.complete_scenarios(panel.scenario_paths(*series(spark), PROTOCOL)).collect()}
    assert (rows["baseline"].u0, rows["baseline"].du, rows["adverse"].peak_du) == (5.0, 0.0, 5.0)
    assert rows["baseline"].dh == pytest.approx(3 * rows["baseline"].h0)
    broken = panel.scenario_paths(*series(spark, skip={2008 * 12 + 5}), PROTOCOL)
    with pytest.raises(PySparkException, match="incomplete scenario"):
        panel.complete_scenarios(broken).collect()


def test_scenario_application_keeps_identity_and_drops_observed_values(spark):
    loans = spark.createDataFrame([("a", "CA", 1.0), ("b", "CA", 2.0)], "row_id string, ProjectState string, u0 double")
    out = linking.apply_scenarios(loans, panel.scenario_paths(*series(spark), PROTOCOL))
    assert sorted((r.row_id, r.scenario) for r in out.collect()) == [(i, s) for i in "ab" for s in ("adverse", "baseline")]


def test_lookup_join_refuses_repeated_keys_and_falls_back_beyond_its_bound(spark):
    facts = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    with pytest.raises(ValueError, match="not unique"):
        lookup_join(facts, spark.createDataFrame([("a", 1), ("a", 2)], "k string, w int"), ["k"])
    wide = spark.createDataFrame([(str(i), i) for i in range(50)] + [("a", 7)], "k string, w int")
    out = lookup_join(facts, wide, ["k"], max_rows=10)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.k, r.w) for r in out.collect()} == {("a", 7), ("b", None)}


def document(points, series_id="LAUST06"):
    return json.dumps({"status": "OK", "Results": {"series": [{"seriesID": series_id, "data": [
        {"year": str(y), "period": p, "value": str(v)} for y, p, v in points]}]}})


def flat(spark, points):
    path = scratch_path(spark, "doc")
    spark.createDataFrame([(document(points),)], "value string").write.text(path)
    cross = spark.createDataFrame([("LAUST06", "CA")], "series_id string, state string")
    return files.flatten_series(files.read_series_documents(spark, path), cross, (2000, 2010))


def test_series_documents_drop_annual_means_and_reject_foreign_years(spark):
    rows = flat(spark, [(2005, "M01", 5.5), (2005, "M13", 9.9), (2005, "M12", 4.0)]).collect()
    assert sorted((r.state, r.month, r.u) for r in rows) == [("CA", 2005 * 12, 5.5), ("CA", 2005 * 12 + 11, 4.0)]
    with pytest.raises(PySparkException, match="unauthorised year"):
        flat(spark, [(2011, "M01", 5.5)]).collect()


def test_coverage_counts_duplicates_and_gaps(spark):
    rows = spark.createDataFrame([("CA", 1), ("CA", 1), ("CA", 4)], "state string, month int")
    r = panel.series_coverage(rows, "state", "month", 2).first()
    assert (r.cells, r.periods, r.duplicates, r.gaps, r.all_states_present) == (3, 2, 1, 2, False)


def test_append_never_overwrites(spark):
    old = spark.createDataFrame([("CA", 1, 5.0)], "state string, month int, u double")
    new = spark.createDataFrame([("CA", 1, 9.0), ("CA", 2, 6.0)], "state string, month int, u double")
    out = linking.append_missing(old, new, ["state", "month"])
    assert sorted(map(tuple, out.collect())) == [("CA", 1, 5.0), ("CA", 2, 6.0)]
    assert linking.unchanged_rows(old, out).count() == 0 and linking.duplicate_keys(out, ["state", "month"]).count() == 0
    assert linking.unchanged_rows(old, new).count() == 1


def test_source_text_join_fails_on_orphans(spark):
    loans = spark.createDataFrame([("a",), ("z",)], "row_id string")
    raw = spark.createDataFrame([("a", "60")], "row_id string, TermInMonths string")
    with pytest.raises(PySparkException, match="no source row"):
        linking.attach_source_text(loans, raw, "TermInMonths", "t").collect()


def test_file_checks_catch_altered_missing_and_extra_files(spark, tmp_path):
    for name, text in (("a.txt", "alpha"), ("b.txt", "beta")):
        (tmp_path / name).write_text(text)
    frozen = spark.createDataFrame(files.file_inventory(spark, str(tmp_path)).collect())
    files.require_passed(files.verify_files(files.file_inventory(spark, str(tmp_path)), frozen))
    (tmp_path / "a.txt").write_text("alphA")
    (tmp_path / "b.txt").unlink()
    (tmp_path / "c.txt").write_text("new")
    checks = files.verify_files(files.file_inventory(spark, str(tmp_path)), frozen)
    assert {r.file: r.passed for r in checks.collect()} == {"a.txt": False, "b.txt": False, "c.txt": False}
    with pytest.raises(ValueError):
        files.require_passed(checks)
    log = tmp_path / "log.txt"
    log.write_text("one\n")
    kept = [r for r in files.file_inventory(spark, str(tmp_path), "log.txt").collect()]
    log.write_text("one\ntwo\n")
    manifest = spark.createDataFrame([(f"file://{log}", kept[0].bytes, kept[0].sha256)], "path string, bytes long, sha256 string")
    assert files.verify_prefixes(manifest).first().passed
    log.write_text("0ne\ntwo\n")
    assert not files.verify_prefixes(manifest).first().passed


def test_csv_scan_keeps_blanks_and_named_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text('A,B,C\n 7A,"",1\nq,,2\n')
    rows = files.read_snapshot(spark, str(tmp_path / "x.csv"), ["A", "B"]).collect()
    assert [(r.A, r.B, r.source_file) for r in rows] == [(" 7A", "", "x.csv"), ("q", "", "x.csv")]
    with pytest.raises(ValueError, match="expected 51"):
        (tmp_path / "c.txt").write_text("| LAUST01 | AL |\nnoise\n")
        files.read_crosswalk(spark, str(tmp_path / "c.txt"), expected=51)


def test_files_of_equal_name_in_different_folders(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "f.bin").write_bytes(folder.encode())
    found = files.file_inventory(spark, str(tmp_path))
    frozen = spark.createDataFrame(found.collect())
    assert {r.file for r in frozen.collect()} == {"a/f.bin", "b/f.bin"}
    checks = files.verify_files(found, frozen)
    assert checks.count() == 2 and checks.where("passed").count() == 2
