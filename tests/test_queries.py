import importlib
import os

import pytest

import __spark_entry__ as entry
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="needs the test tables")
MODULES = [importlib.import_module(m) for m in entry.CORE]
SQL = {n: (m.QUERIES[n], s) for m in MODULES for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def connection():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, connection, name):
    own, other = oracle.both(spark, connection, *SQL[name])
    assert own == other


@pytest.mark.parametrize("name", sorted(n for m in MODULES for n in m.QUERIES if n not in m.SQL))
def test_query_without_sql_runs(spark, name):
    df = next(m.QUERIES[name] for m in MODULES if name in m.QUERIES)(spark, oracle.DATA)
    assert df.columns and df.count() >= 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
