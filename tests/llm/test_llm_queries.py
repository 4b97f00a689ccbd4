import os

import pytest
from oracle import DATA, connect, expected, result

from larkspan.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert result(queries.queries()[name](spark, DATA)) == expected(connect(), SQL[name])
