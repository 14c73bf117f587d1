"""Queries of the subpackage against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from eventmesa.llm import queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    theirs = con.sql(queries.ORACLE_SQL[name])
    ours = queries.QUERIES[name](spark, SF)
    columns = sorted(theirs.columns)
    assert columns == sorted(ours.columns)
    assert sorted(map(str, (tuple(r) for r in ours.select(*columns).collect()))) == sorted(map(str, theirs.select(*columns).fetchall()))
