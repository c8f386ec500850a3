"""Every named query at the smallest scale against its SQL; queries without SQL must run."""

import pytest

import check_queries
from __spark_entry__ import entry, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    result = check_queries.compare(spark, con, FOLDER, name)
    assert result.startswith(("ok", "rows-only")), result


def test_entry(spark):
    assert entry(spark).count() > 0
