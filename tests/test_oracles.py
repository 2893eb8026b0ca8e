import pytest

from presencia.plans.queries import ORACLES, QUERIES
from tests.duck import SF, assert_same, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], con)


def test_entry_is_ranked(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert sorted(r.presence_rank for r in rows) == list(range(1, len(rows) + 1))
