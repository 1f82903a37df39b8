"""Every query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from cadastra import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    try:
        return round(float(value), 6)
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    got, want = catalog.queries()[name](spark, SF), con.sql(catalog.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda it: sorted((tuple(map(plain, r)) for r in it), key=str)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows(got.select(*columns).collect()) == rows(want.select(quoted).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
