"""Every registered query runs; those with oracle SQL must agree with it."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = os.environ.get("STAYLINE_TEST_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_modelling_queries_do_the_whole_job(spark):
    assert {r["penalty"] for r in QUERIES["penalty_summary"](spark, SF).collect()} == {"l1", "l2", "elasticnet"}
    widths = {r["dataset"]: r["width"] for r in QUERIES["fuse_datasets_whole"](spark, SF).select("dataset", "width").distinct().collect()}
    assert widths == {"tfidf": 2002, "embedding": 66, "both": 2066}
