"""Every catalog query against its SQL, over whole tables."""

import pytest

from conftest import SF
from pathlens import queries as catalog

SQL = catalog.oracle_sql()


def rows(columns, found):
    return sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in found), key=repr)


def test_every_query_has_sql():
    assert set(SQL) == set(catalog.queries())


@pytest.mark.parametrize("key", sorted(SQL))
def test_same_rows(spark, duck, key):
    df = catalog.queries()[key](spark, SF)
    wanted = duck.sql(SQL[key])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(wanted.columns, wanted.fetchall())
