import pytest

import oracle
from tracelake import queries

queries.load()


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, data, con, name):
    oracle.same(spark, con, queries.QUERIES[name], queries.SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0
