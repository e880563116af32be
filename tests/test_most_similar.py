"""The most similar old text: equal to brute force, and no pair of a common word leaves its task."""

import random
import re

import pytest

from quaystone.operators import lexical


def brute(rows, old):
    words = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
    out = {}
    for i, t in rows:
        for j, u in old:
            if t is not None and u is not None and (s := len(words(t) & words(u))):
                out[i] = min(out.get(i, (0, "")), (-s / len(words(t) | words(u)), j))
    return {i: (j, -s) for i, (s, j) in out.items()}


@pytest.mark.parametrize("block_words", [1_000_000, 50])
def test_equals_brute_force(spark, block_words):
    draw = random.Random(3)
    text = lambda: " ".join(["the"] * draw.randint(0, 2) + [f"w{int(draw.paretovariate(0.6)) % 200}" for _ in range(draw.randint(0, 9))])
    rows = [(f"q{i}", text()) for i in range(80)] + [("null", None), ("empty", ""), ("marks", "?!"), ("twin", "The w1"), ("alone", "nowhere")]
    old = [(f"o{i}", text()) for i in range(120)] + [("a-null", None), ("a-empty", ""), ("é", "the w1"), ("z", "the w1")]
    ask = lambda r, o: lexical.most_similar(spark.createDataFrame(r, "id string, t string"), spark.createDataFrame(o, "old string, t string"), "id", "t", "old", "t", **({"block_words": block_words}))
    got = ask(rows, old).collect()
    assert {r["id"]: (r["old_id"], r["similarity"]) for r in got} == brute(rows, old)
    assert len(got) == len({r["id"] for r in got})
    assert ask([], old).count() == 0 and ask(rows, []).count() == 0


def test_rows_of_one_id_are_scored_alone(spark):
    rows = spark.createDataFrame([("q", "a b"), ("q", "c d")], "id string, t string")
    old = spark.createDataFrame([("o", "a b c d"), ("p", "x a")], "old string, t string")
    assert [tuple(r) for r in lexical.most_similar(rows, old, "id", "t", "old", "t").collect()] == [("q", "o", 0.5)]


def test_a_common_word_makes_no_joined_pairs(spark):
    rows = spark.range(50).selectExpr("concat('q', id) id", "concat('the w', id) t")
    plan = lexical.most_similar(rows, rows, "id", "t", "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
