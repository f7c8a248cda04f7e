"""Every query with SQL gives the rows of that SQL; the others give rows."""

import pytest

from reviewloom.plans import registry

from conftest import DATA


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(name, spark):
    assert registry.QUERIES[name](spark, DATA).count() > 0
