"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from eventmesa.plans import registry

SF = "/root/testdata/sf0.001"
#: Queries that find nothing on the smallest tables, though they do on larger ones.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    def one(v):
        if v is None or v != v:
            return "null"
        return f"{v + 0.0:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10] if hasattr(v, "year") else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, con, name):
    ours = registry.QUERIES[name](spark, SF)
    theirs = con.sql(registry.ORACLE_SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    expected = plain(theirs.select(*(f'"{c}"' for c in columns)).fetchall())
    assert expected or name in EMPTY, "the query is checked against no row"
    assert plain(tuple(r) for r in ours.select(*columns).collect()) == expected
