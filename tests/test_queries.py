"""Every registered engine query against its SQL in DuckDB, on the same tables."""

import pytest
from compare import assert_same, rows

from hopweave.plans import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert_same(got, duck.execute(queries.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_repeats_itself(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert len(got) and rows(got) == rows(queries.QUERIES[name](spark, sf).toPandas())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
