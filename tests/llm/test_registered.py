import pytest

import oracle
from tracelake import llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    oracle.same(spark, oracle.connect(data), llm.queries()[name], llm.oracle_sql()[name], data)


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_query_runs(spark, data, name):
    llm.queries()[name](spark, data).collect()
