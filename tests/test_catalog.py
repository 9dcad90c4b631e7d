import pytest

from fieldglass.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_duckdb(name, same_as_duckdb):
    same_as_duckdb(catalog.queries()[name], catalog.oracle_sql()[name])


#: Its pairs have SQL of their own; its merging is tested against brute force in test_scored.py.
WITHOUT_SQL = {"clusters_of_near_names"}


def test_every_query_has_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == WITHOUT_SQL
