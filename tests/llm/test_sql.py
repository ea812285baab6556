"""The queries that SQL can express, against DuckDB on the same tables."""

import pytest
from compare import assert_same

from hopweave.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    assert_same(registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
