"""Every catalogue query at the smallest scale, against SQL where there is any."""

import pytest

from passagelake.plans import catalogue

from .oracle import agree

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_agrees_with_sql(spark, name):
    agree(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.ORACLES) <= set(__spark_entry__.oracle_sql())
