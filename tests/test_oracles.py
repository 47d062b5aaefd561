import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    got = queries()[name](spark, SF_DIR).toPandas()
    assert len(got)
    if name in oracle_sql():
        assert compare(got, duck.sql(oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(oracle_sql()) <= set(queries())
