import pytest

from tests.oracle import compare

D = "/root/testdata/sf0.001"


def _core():
    import __spark_entry__ as e

    return sorted((k, m) for m in e.MODULES if ".llm" not in m.__name__ for k in m.QUERIES)


@pytest.mark.parametrize("name,module", _core(), ids=lambda x: x if isinstance(x, str) else "")
def test_query(spark, name, module):
    if name in module.SQL:
        compare(spark, D, module.QUERIES[name], module.SQL[name])
    else:
        module.QUERIES[name](spark, D).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
