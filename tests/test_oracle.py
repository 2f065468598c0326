"""Every query with SQL gives the same rows in another engine; the others run."""

import oracle
import pytest

import __spark_entry__
from skeinflow import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    assert oracle.difference(catalog.queries()[name](spark, SMALL), db, catalog.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
