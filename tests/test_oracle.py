"""Every registered query against its SQL in DuckDB, over the whole tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracle

import __spark_entry__ as entry

ROOT = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
# queries without SQL, tested elsewhere: the fit against a brute-force search, the events against a plain walk, the ranks by their parts
WITHOUT_SQL = {"it12_noise_fit", "it19_event_categories", "it28_record_ranks"}


@pytest.fixture(scope="module")
def duck():
    return check_oracle.connect(ROOT)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    state, note = check_oracle.compare(spark, duck, name, ROOT)
    assert state in ("OK", "ROWS", "EMPTY"), note


def test_only_listed_queries_lack_sql():
    assert set(entry.QUERIES) - set(entry.ORACLES) == WITHOUT_SQL


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
