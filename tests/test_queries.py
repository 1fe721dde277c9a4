"""Every query of the index library against its SQL."""

import pytest
from sqlcheck import compare

from tallymark.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
