"""Every query against its SQL on the smallest tables."""

import pytest

from twinframe.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, sf_dir, duck, same):
    same(QUERIES[name](spark, sf_dir), duck.sql(ORACLE_SQL[name]))


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
