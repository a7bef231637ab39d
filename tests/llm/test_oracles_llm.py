import pytest
from oracles import DATA, rows_of_both

from millrace.llm.queries import QUERIES
from millrace.llm.sql import SQL


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    got, want = rows_of_both(spark, QUERIES[name], SQL[name])
    assert got == want
