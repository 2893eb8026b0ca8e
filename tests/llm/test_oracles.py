import pytest

from presencia.llm import queries as M
from tests.duck import SF, assert_same, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(M.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert_same(M.queries()[name](spark, SF), M.oracle_sql()[name], con)
