import pytest

import __spark_entry__
from fiberloom.plans import registry
from tests.oracle import DATA, connect, same

FOLDER = DATA / "sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, oracle, name):
    assert same(registry.QUERIES[name](spark, str(FOLDER)), oracle, registry.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_others_run(spark, name):
    assert registry.QUERIES[name](spark, str(FOLDER)).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
