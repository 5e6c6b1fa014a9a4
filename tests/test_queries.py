import pytest

from loreweave.plans.queries import ORACLE_SQL, QUERIES
from parity import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query", "id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
