"""Registered queries: scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SOURCE_COLUMNS
from ..functions import cleaning
from ..operators import linking
from ..sources import files
from ..session import scratch_path
from .bindings import TEST, monthly_series, quarterly_series, snapshot, table
from .catalog import query
from .inputs import loans, typed_loans
from .oracle_base import with_tables

_COLS = ", ".join(SOURCE_COLUMNS)


@query(
    "a01_snapshot_scan",
    with_tables("snap") + f"""
    select LoanStatus, Program, count(*) as n, cast(sum(length(concat_ws('|', {_COLS}))) as bigint) as text_length,
      count(*) filter (TermInMonths = '') as blank_terms, min(GrossApproval) as lowest_text
    from snap group by LoanStatus, Program""",
)
def snapshot_scan(spark, sf):
    path = scratch_path(spark, "snapshot")
    wide = snapshot(spark, sf).withColumn("Unused", F.lit("not read"))
    files.write_text_table(wide.drop("source_file"), path)
    rows = files.read_snapshot(spark, path)
    return rows.groupBy("LoanStatus", "Program").agg(
        F.count("*").alias("n"), F.sum(F.length(F.concat_ws("|", *SOURCE_COLUMNS))).alias("text_length"),
        F.count_if(F.col("TermInMonths") == "").alias("blank_terms"), F.min("GrossApproval").alias("lowest_text"),
    )


@query(
    "a02_panel_parquet",
    with_tables("elig") + """
    select cast(year as int) as year, count(*) as n, cast(sum(Y) as bigint) as events, min(d) as first_d, max(w) as last_w
    from elig where year between 1996 and 1999 group by 1""",
)
def panel_parquet(spark, sf):
    path = scratch_path(spark, "panel")
    files.write_panel(cleaning.eligible(typed_loans(spark, sf), TEST), path)
    kept = files.read_panel(spark, path).where(F.col("year").between(1996, 1999))
    return kept.groupBy("year").agg(
        F.count("*").alias("n"), F.sum("Y").alias("events"), F.min("d").alias("first_d"), F.max("w").alias("last_w")
    )


@query("a03_quarterly_csv", with_tables("series") + "select state, year, q, hpi, quarter from hseries")
def quarterly_csv(spark, sf):
    path = scratch_path(spark, "quarterly")
    files.write_text_table(quarterly_series(spark, sf), path, header=False)
    return files.read_quarterly(spark, path)


def _series_id():
    return F.concat(F.lit("LAUST"), F.lpad("state", 2, "0"), F.lit("0000000003"))


def _write_documents(spark, sf, path):
    """Nested monthly documents, one per state, with an annual mean as period M13."""
    months = monthly_series(spark, sf).select(
        "state", F.expr("month div 12").alias("year"), (F.col("month") % 12 + 1).alias("m"), "u"
    )
    means = months.groupBy("state", "year").agg(F.avg("u").alias("u")).withColumn("m", F.lit(13).cast("long"))
    point = F.struct(
        F.col("year").cast("string").alias("year"), F.concat(F.lit("M"), F.lpad(F.col("m").cast("string"), 2, "0")).alias("period"),
        F.col("u").cast("string").alias("value"),
    )
    # a series is bounded by the calendar: thirteen points a year
    series = months.unionByName(means.select(*months.columns)).groupBy("state").agg(F.sort_array(F.collect_list(point)).alias("data"))
    document = series.select(
        F.lit("REQUEST_SUCCEEDED").alias("status"),
        F.struct(F.array(F.struct(_series_id().alias("seriesID"), "data")).alias("series")).alias("Results"),
    )
    document.write.json(path)


def _write_crosswalk(spark, sf, path):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("state"))
    nation.select(F.concat(F.lit("| "), _series_id(), F.lit(" | "), F.col("state"), F.lit(" |")).alias("value")).write.text(path)


@query(
    "a04_flatten_series",
    with_tables("series") + """
    select state, month, u, 'LAUST' || lpad(state, 2, '0') || '0000000003' as series from useries""",
)
def flatten_series(spark, sf):
    docs, cross = scratch_path(spark, "documents"), scratch_path(spark, "crosswalk")
    _write_documents(spark, sf, docs)
    _write_crosswalk(spark, sf, cross)
    pairs = files.read_crosswalk(spark, cross, expected=25)
    return files.flatten_series(files.read_series_documents(spark, docs), pairs, (1995, 2001))


@query(
    "a05_row_identity",
    with_tables("snap") + """
    select 'file_row' as id_kind, count(*) as n_rows, count(*) as n_ids, 0::bigint as repeated_ids from snap
    union all select 'natural_key', cast(sum(n) as bigint), count(*), count(*) filter (n > 1)
    from (select row_id, count(*) as n from snap group by 1)""",
)
def row_identity(spark, sf):
    path = scratch_path(spark, "landed")
    snapshot(spark, sf).select("row_id", "LoanStatus").write.parquet(path)
    landed = files.with_row_id(spark.read.parquet(path))
    out = [files.identity_report(landed, c).select(F.lit(k).alias("id_kind"), "*") for k, c in
           (("file_row", "file_row_id"), ("natural_key", "row_id"))]
    return out[0].unionByName(out[1])


@query(
    "a06_lookup_dimension",
    """select 'LAUST' || lpad(cast(n_nationkey as varchar), 2, '0') || '0000000003' as series_id,
    cast(n_nationkey as varchar) as state from nation""",
)
def lookup_dimension(spark, sf):
    path = scratch_path(spark, "crosswalk")
    _write_crosswalk(spark, sf, path)
    return files.read_crosswalk(spark, path, expected=25)


@query(
    "a07_result_sink",
    with_tables("elig") + "select role, count(*) as n, cast(sum(Y) as bigint) as events from elig group by role",
)
def result_sink(spark, sf):
    path = scratch_path(spark, "result")
    result = loans(spark, sf).groupBy("role").agg(F.count("*").alias("n"), F.sum("Y").alias("events"))
    files.save_result(result, path)
    return files.load_result(spark, path, result.schema)


@query("a08_verify_files")
def verify_files(spark, sf):
    path = scratch_path(spark, "manifest")
    inventory = files.file_inventory(spark, sf, "*.parquet")
    files.save_result(inventory, path)
    return files.verify_files(inventory, files.load_result(spark, path, inventory.schema))


@query(
    "a09_append_missing",
    with_tables("series") + f"""
    , old as (select state, month, u, 'old' as origin from useries where month < {1999 * 12}),
    new as (select state, month, u + 1 as u, 'new' as origin from useries where month >= {1998 * 12})
    select * from old union all select * from new where not exists
    (select 1 from old where old.state = new.state and old.month = new.month)""",
)
def append_missing(spark, sf):
    series = monthly_series(spark, sf)
    old = series.where(F.col("month") < 1999 * 12).withColumn("origin", F.lit("old"))
    new = series.where(F.col("month") >= 1998 * 12).select("state", "month", (F.col("u") + 1).alias("u"), F.lit("new").alias("origin"))
    return linking.append_missing(old, new, ["state", "month"])


@query(
    "a10_finite_json",
    """select event_type, count(*) as n, count(*) filter (event_id % 11 in (0, 1, 2)) as nulls,
    round(sum(case when event_id % 11 not in (0, 1, 2) then value end), 2) as total from events group by 1""",
)
def finite_json(spark, sf):
    path = scratch_path(spark, "json")
    wild = F.expr(
        "case event_id % 11 when 0 then double('NaN') when 1 then double('Infinity') when 2 then double('-Infinity') else value end"
    )
    events = table(spark, sf, "events").select("event_type", files.finite_or_null(wild).alias("value"))
    events.write.option("ignoreNullFields", False).json(path)
    back = spark.read.schema("event_type string, value double").json(path)
    return back.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.round(F.sum("value"), 2).alias("total")
    )
