"""Every registered query runs at the smallest scale and equals its SQL twin."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(name, spark, con):
    verdict, _, _ = compare(name, spark, con, SF)
    assert verdict.startswith(("ok", "rows-only", "EMPTY")), verdict


def test_entry_has_a_stable_schema(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema and first.count() >= 0
