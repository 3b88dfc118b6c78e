"""The text queries that SQL can express against it."""

import pytest

from tests.compare import assert_equal
from vertexloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_equal(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], "/root/testdata/sf0.001")


def test_each_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES) == list(range(1, len(registry.QUERIES) + 1))
