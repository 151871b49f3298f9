"""Every query beside its SQL, and every other query for its rows."""

import pytest

from quillspark.plans import registry

SQL = registry.oracle_sql()
ALL = registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(same, name):
    assert same(ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_rows(spark, sf_dir, name):
    assert ALL[name](spark, sf_dir).count() > 0


def test_sql_has_queries():
    assert set(SQL) <= set(ALL)
