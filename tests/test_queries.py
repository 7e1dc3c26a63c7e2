import pytest
from check_queries import compare

import __spark_entry__ as entry
from tagloom.plans import oracle, registry

QUERIES = registry.QUERIES
SQL = oracle.oracle_sql()


def test_sql_names_exist():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 4 and "f1" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert compare(df, duck, SQL[name]) == ""
    else:
        assert df.count() > 0
