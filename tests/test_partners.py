"""Partners that differ in every column: a row goes without only where no other row will do."""

import itertools

import pytest

from quaystone.operators import lexical
from quaystone.plans import registry

COLUMNS = ["file", "org", "theme"]


def agree(rows: dict, got) -> None:
    """Partners differ in all columns, and exactly the rows with any possible partner have one."""
    differs = lambda a, b: all(x is not None and y is not None and x != y for x, y in zip(a, b))
    kinds = set(rows.values())
    able = {i for i, a in rows.items() if any(differs(a, b) for b in kinds)}
    assert len(got) == len({r["id"] for r in got})
    assert {r["id"] for r in got} == able
    assert all(differs(rows[r["id"]], rows[r["partner"]]) for r in got)


CASES = {
    "few": [(f"f{i}", f"o{i}", f"t{i}") for i in range(5)],
    "one org holds nearly all": [(f"f{i}", "big", f"t{i % 3}") for i in range(300)] + [("g", "small", "t0"), ("h", "small", "t1")],
    "some have none": [("f", "o", f"t{i % 2}") for i in range(40)] + [("g", "o", "t0"), ("f", "p", "t1"), ("g", "q", "t1")],
    "each column shared by a different row": [("a", "b", "c")] * 100 + [("a", "x", "y"), ("u", "b", "y"), ("u", "x", "c"), ("u", "x", "y")],
    "nulls": [("a", None, "c"), ("b", "x", "d"), ("c", "y", "e")],
    "all small": [c for c in itertools.product("ab", "cd", "ef")],
    "alone": [("a", "b", "c")],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_every_row_with_a_possible_partner_has_one(spark, name):
    rows = dict(enumerate(CASES[name]))
    df = spark.createDataFrame([(i, *x) for i, x in rows.items()], "id int, file string, org string, theme string")
    agree(rows, lexical.ring_partners(df, "id", COLUMNS).collect())


def test_rows_that_need_a_partner_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(lexical, "POOL_ROWS", 0)
    rows = dict(enumerate([("a", "b", "c")] * 500 + [("a", "x", "y"), ("u", "x", "y"), ("u", "b", "z")]))
    df = spark.createDataFrame([(i, *x) for i, x in rows.items()], "id int, file string, org string, theme string")
    agree(rows, lexical.ring_partners(df, "id", COLUMNS, buckets=2).collect())


def test_query_on_the_table(spark):
    d = "/root/testdata/sf0.001"
    lists = spark.read.parquet(f"{d}/detector_eval_finreg_v1.parquet").selectExpr("id", "metadata.source_file f", "metadata.source_org o", "metadata.theme t")
    rows = {r[0]: tuple(r[1:]) for r in lists.groupBy("id").agg({"f": "min", "o": "min", "t": "min"}).select("id", "min(f)", "min(o)", "min(t)").collect()}
    agree(rows, registry.queries()["unrelated_partners"](spark, d).collect())
