"""Every registered query with SQL agrees with DuckDB."""

import pytest

from landgrid.plans.registry import ORACLE, QUERIES, load
from tests.compare import connect, differences

load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_has_rows(spark, name):
    assert not QUERIES[name](spark, SF).isEmpty()
