from quaystone.plans import registry


def test_documents_that_hold_the_marker_of_the_sql_are_kept(spark, tmp_path):
    long = " ".join(f"Sentence {k} tells of \x01 liquidity and of the limits that hold for every bank in the market." for k in range(5))
    spark.createDataFrame([(1, "One\x01 here. Two there."), (2, "Three. Four."), (3, None), (4, long)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = registry.queries()
    assert sorted((r["doc_id"], r["sent_no"]) for r in q["sentence_scan"](spark, str(tmp_path)).collect() if r["doc_id"] < 4) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert sorted((r["doc_id"], r["sent_no"]) for r in q["sliding_passages"](spark, str(tmp_path)).collect()) == [(4, 1), (4, 2), (4, 3)]
