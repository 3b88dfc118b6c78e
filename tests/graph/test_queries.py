"""Every registered graph query against its SQL, on the smallest tables."""

import pytest

from tests.compare import assert_equal
from vertexloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_equal(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], FOLDER)


def test_every_query_has_its_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    scores = __spark_entry__.entry(spark).collect()
    assert abs(sum(r.score for r in scores) - 1) < 1e-6
