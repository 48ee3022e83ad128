"""Every query with a SQL twin gives the same rows as DuckDB; the others give rows."""

import os

import pytest
from check_oracles import compare, connect

import __spark_entry__ as entry

FOLDER = os.environ.get("PALAVER_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    message = compare(QUERIES[name](spark, FOLDER), duck, ORACLES[name])
    assert message is None, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "join1_enrich_with_submission", "join2_flow_parent_value", "join5_bundle_threads", "join5_co_group",
    "join7_children", "srch3_thread_documents", "tpc5_ppmi"])
def test_same_rows_with_salted_joins(spark, duck, monkeypatch, name):
    from palaver.operators import sizing

    monkeypatch.setattr(sizing, "SALT_ABOVE_BYTES", 0)
    monkeypatch.setattr(sizing, "MIN_PART_ROWS", 3)
    message = compare(QUERIES[name](spark, FOLDER), duck, ORACLES[name])
    assert message is None, message
