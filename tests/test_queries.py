import pytest
from conftest import rows_of

from riskloom.plans import dependency_queries, history_queries, report_queries, source_queries, state_queries  # noqa: F401
from riskloom.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    made, expected = rows_of(QUERIES[name](spark, sf_dir).toPandas()), rows_of(duck.execute(SQL[name]).df())
    assert made[0] == expected[0]
    assert made[1] == expected[1]


def test_flagship_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_order_dependent_query_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
