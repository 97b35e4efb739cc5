"""Every registered query against its SQL twin on the smallest data."""

import os

import pytest

import __spark_entry__ as entry_module
import check
from lodestrata.plans import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_twin(spark, con, name):
    verdict = check.compare(spark, con, SF, name)
    assert verdict.startswith(("ok", "rows only")), verdict


def test_every_twin_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
