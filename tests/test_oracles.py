"""Every registered query against its SQL text; queries without one must return rows."""

import os

import pytest

from logmill import registry

from .compare import differences, duck, duck_table, spark_table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, connection, name):
    result = spark_table(registry.queries()[name](spark, SF_DIR))
    sql = registry.oracles().get(name)
    if sql is None:
        assert result[1]
    else:
        assert differences(result, duck_table(connection, sql)) == []
