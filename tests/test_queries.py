import pytest

import __spark_entry__
from attestor.queries import core
from compare import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_equals_sql(spark, data, con, name):
    same(spark, con, data, core.QUERIES[name], core.SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs_alike_twice(spark, data, name):
    rows = [sorted(map(str, core.QUERIES[name](spark, data).collect())) for _ in range(2)]
    assert rows[0] == rows[1]
    assert rows[0] or name == "near_copies"  # the smallest data has none


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[:2] == ["kind", "id"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
