"""Queries that SQL can answer on small tables give what DuckDB gives."""

import os

import pytest

from quaystone.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    found = con.execute(sql.SQL[name])
    names = [c[0] for c in found.description]
    want = sorted(map(repr, found.fetchall()))
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == want
