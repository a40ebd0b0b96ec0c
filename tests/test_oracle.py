"""Registered queries against DuckDB at the smallest scale; ``ALL_QUERIES=1`` runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from lossweave.plans import registered
from tests.compare import compare, connect

SF_DIR, WHOLE_DIR = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
STRESSED = ("h13", "h14", "h15b", "i01", "i02", "i04", "i05", "i06")  # the smallest scale lacks months of the stress path, which these refuse
CORE = ("a09", "b05", "b08", "c02", "d03", "d08", "d09", "e10", "e13", "e15", "f08", "f10", "g09", "h01", "h07", "h06b", "h08b", "h13", "h15b", "i05", "i09")
QUERIES, ORACLE = registered.QUERIES, registered.ORACLE
CHOSEN = sorted(n for n in ORACLE if os.environ.get("ALL_QUERIES") or n.startswith(CORE))


@pytest.fixture(scope="module")
def cons():
    return {d: connect(d) for d in (SF_DIR, WHOLE_DIR)}


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_oracle(spark, cons, name):
    sf = WHOLE_DIR if name.startswith(STRESSED) else SF_DIR
    status, _, _ = compare(spark, cons[sf], QUERIES[name], ORACLE[name], sf)
    assert status.startswith("ok") or status == "EMPTY", status


def test_registry_is_consistent():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) == 123
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
