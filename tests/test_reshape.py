import pytest
from pyspark.sql import functions as F

from quaystone.operators import reshape


def test_labels_and_scores(spark):
    df = spark.createDataFrame([(" Entailment ",), ("NOT ENOUGH INFO",), ("2",), ("odd",), (None,)], "l string")
    assert [r[0] for r in df.select(reshape.canonical_label(F.col("l"))).collect()] == ["entailment", "neutral", "contradiction", None, None]
    m = spark.createDataFrame([("E=0.25 | N=0.5",)], "t string").select(reshape.scores(F.col("t")).alias("m")).first()["m"]
    assert m == {"E": 0.25, "N": 0.5}


def test_packed_contexts_stay_in_budget(spark):
    df = spark.createDataFrame([(1, k, c * 10) for k, c in enumerate("abcd", 1)], "q int, rank int, text string")
    row = reshape.packed_contexts(df, "q", "rank", "text", each=8, total=20).first()
    assert row["packed"] == "[1] aaaaaaaa\n[2] bbbbbbbb\n[3] cccc" and row["n"] == 3


def test_positions_and_zip(spark):
    a = spark.createDataFrame([(x,) for x in (5, 3, 9, 1)], "k int").repartition(3)
    assert {(r["k"], r["ordinal"]) for r in reshape.numbered(a, "k").collect()} == {(1, 0), (3, 1), (5, 2), (9, 3)}
    b = spark.createDataFrame([(x, str(x)) for x in (50, 30, 90, 10)], "k int, v string")
    assert {(r["k"], r["v_b"]) for r in reshape.zipped(a, b, "k").collect()} == {(1, "10"), (3, "30"), (5, "50"), (9, "90")}
    with pytest.raises(ValueError):
        reshape.zipped(a, b.limit(2), "k")


def test_report_and_sample(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, None, 0.0), (2, "", 5.0)], "id int, t string, w double")
    r = reshape.report(df, "id", {"t": F.length("t") > 0}).first()
    assert (r["n"], r["repeated_ids"], r["failed_t"], r["valid"]) == (3, 1, 2, False)
    many = spark.range(2000).select(F.col("id"), F.when(F.col("id") < 200, 10.0).otherwise(1.0).alias("w"))
    got = reshape.weighted_sample(many, "w", 200, "id").collect()
    heavy = sum(r["id"] < 200 for r in got)
    assert len(got) == 200 and 70 < heavy < 130
    assert reshape.weighted_sample(df, "w", 5, "t").count() == 2


def test_file_names(spark, tmp_path):
    spark.range(3).coalesce(1).write.json(str(tmp_path / "a"))
    (next((tmp_path / "a").glob("*.json"))).rename(tmp_path / "base_seed7.json")
    (tmp_path / "other.json").write_text('{"id": 9}')
    rows = reshape.by_file_name(spark.read.json([str(tmp_path / "base_seed7.json"), str(tmp_path / "other.json")]), r"^([a-z]+)_seed([0-9]+)\.json$", ["variant", "seed"]).collect()
    assert len(rows) == 3 and {(r["variant"], r["seed"]) for r in rows} == {("base", "7")}
