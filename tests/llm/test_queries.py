import pytest

from fjordlens.llm import queries
from tests.oracle import compare

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.SQL:
        compare(spark, D, queries.QUERIES[name], queries.SQL[name])
    else:
        queries.QUERIES[name](spark, D).collect()
