"""Registered queries of the llm folder next to their SQL twins, and their registration."""

import os

import pytest

import __spark_entry__ as entry_module
import check
from lodestrata.llm.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_twin(spark, name):
    verdict = check.compare(spark, check.connect(SF), SF, name)
    assert verdict.startswith("ok"), verdict


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_module.queries())
