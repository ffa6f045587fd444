import os

import pytest

from lociflow.llm import queries
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def connection():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, connection, name):
    own, other = oracle.both(spark, connection, queries.QUERIES[name], queries.SQL[name])
    assert own == other


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    df = queries.QUERIES[name](spark, oracle.DATA)
    assert df.columns and df.count() > 0
