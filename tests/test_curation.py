import pytest
from pyspark.sql import functions as F

from quaystone.operators import chunking, curation
from quaystone.sources import files as sources


def test_family_takes_the_first_field_that_any_rule_matches(spark):
    df = spark.createDataFrame([(None, "A web page"), ("x", "A guideline"), ("Guide", None), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(curation.family([F.col("a"), F.col("b")], [("guide", "g"), ("web", "w")])).collect()]
    assert got == ["w", "g", "g", "other"]


def test_claims_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "abc"), (2, "", None), (3, "One limit; two risks and more. ", "limit one")], "id int, t string, e string")
    got = {r["id"]: (r["claims"], r["mean_support"], r["unsupported"]) for r in curation.claim_support(df, "id", "t", "e").collect()}
    assert got == {1: (0, None, 0), 2: (0, None, 0), 3: (2, 0.5, 1)}


def test_one_bad_path_stops_no_other(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    docs, failed = curation.load_each(spark, [str(tmp_path / "a.txt"), str(tmp_path / "none.txt")], lambda s, p: sources.text(s, p, "line"))
    assert docs.count() == 2 and list(failed) == [str(tmp_path / "none.txt")]
    assert curation.load_each(spark, [], sources.text) == (None, {})


def test_whole_words_headers_and_strategies(spark):
    df = spark.createDataFrame([("The Second Line. x",), ("seconds line",), (None,)], "t string")
    assert [r[0] for r in df.select(curation.holds_phrase(F.col("t"), "second line")).collect()] == [True, False, False]
    assert [r[0] for r in df.limit(1).select(curation.header(a=F.lit("x"), b=F.lit(None).cast("string"), c=F.lit(3))).collect()] == ["a: x; c: 3"]
    docs = spark.createDataFrame([(1, "y" * 900)], "doc_id bigint, text string")
    assert [len(r["chunk"]) for r in chunking.by_strategy(docs, "fixed_small", 1000, 400).orderBy("chunk_index").collect()] == [500, 500, 400 - 250]
    with pytest.raises(ValueError):
        chunking.by_strategy(docs, "other")


def test_page_lines_close_blocks(spark):
    docs = spark.createDataFrame([(1, "[Page 1]\nfirst line\nsecond\n[Page 2]\nthird\n\nfourth")], "doc_id bigint, text string")
    rows = chunking.sections(docs, page=r"^\[Page [0-9]+\]$").orderBy("block_no").collect()
    assert [(r["page"], r["block"]) for r in rows] == [(1, "first line second"), (2, "third"), (2, "fourth")]
