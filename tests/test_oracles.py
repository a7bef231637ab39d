import pytest
from oracles import DATA, rows_of_both

from millrace.plans import corpus


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(corpus.SQL))
def test_query_equals_its_sql(spark, name):
    got, want = rows_of_both(spark, corpus.QUERIES[name], corpus.SQL[name])
    assert got == want and len(got) > 0
