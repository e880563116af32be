"""Every core query runs on the smallest tables, and those with SQL give what DuckDB gives."""

import os

import pytest

from quaystone.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


def _plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if type(v).__name__ == "Decimal":
        return repr(float(v))
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    return repr(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(_plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert sorted(tuple(_plain(r[c]) for c in sorted(names)) for r in rows) == want
