"""Named queries against their SQL on the smallest tables."""

import os

import pytest
from check_queries import difference, duck

from faultline.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, connection, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert difference(got, connection.execute(ORACLE[name]).df()) is None


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    from __spark_entry__ import entry

    assert entry(spark).limit(1).count() == 1
