import pytest
from oracle import same

from lemmata.plans import more, queries as plans

SF = "/root/testdata/sf0.001"


QUERIES, SQL = plans.QUERIES | more.QUERIES, plans.SQL | more.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, name):
    same(spark, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
