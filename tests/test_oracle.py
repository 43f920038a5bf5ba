import pytest

import __spark_entry__ as entry_module
from tests.compare import compare, connect

QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result_as_sql(name, spark, sf_dir, con):
    difference = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert difference is None, difference


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1
