import pytest

from fiberloom.llm import queries
from tests.oracle import DATA, connect, same

FOLDER = DATA / "sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, oracle, name):
    assert same(queries.QUERIES[name](spark, str(FOLDER)), oracle, queries.SQL[name]) == ""


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
