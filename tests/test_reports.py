from pyspark.sql import functions as F

from quaystone import session
from quaystone.operators import reports, retrieval, verify


def test_interval_lookup(spark):
    points = spark.createDataFrame([("a", 0, "x"), ("a", 10, "y"), ("a", 25, "z"), ("b", 5, "q"), ("c", 1, None)], "doc string, pos int, tag string")
    marks = spark.createDataFrame([("a", 10, 2), ("a", 20, 3), ("b", 6, 9)], "doc string, pos int, page int")
    got = {(r["doc"], r["pos"]): (r["tag"], r["page"]) for r in reports.interval_lookup(points, marks, "doc", "pos", "page").collect()}
    assert got == {("a", 0): ("x", None), ("a", 10): ("y", 2), ("a", 25): ("z", 3), ("b", 5): ("q", None), ("c", 1): (None, None)}
    assert reports.interval_lookup(points.limit(0), marks, "doc", "pos", "page").count() == 0


def test_shares_of_nothing_are_null(spark):
    rows = spark.createDataFrame([("no", "no"), (None, "yes"), ("no", None)], "e string, p string")
    r = reports.inclusion_summary(rows, "e", "p", "yes").first()
    assert r["n"] == 1 and r["accuracy"] == 1.0 and r["false_exclude_rate"] is None and r["false_include_rate"] == 0.0
    empty = reports.inclusion_summary(rows.limit(0), "e", "p", "yes").first()
    assert empty["n"] == 0 and empty["accuracy"] is None


def test_expanded_queries_have_no_variant_twice(spark):
    df = spark.createDataFrame([("1", "How must it be"), ("2", "x"), ("3", None)], "id string, q string")
    rows = reports.expanded(df, "q", [("must", "duty"), ("how", "Duty"), ("how", "steps")], ["scope"], 3).collect()
    assert [(r["id"], r["variant_no"], r["variant"]) for r in sorted(rows, key=lambda r: (r["id"], r["variant_no"]))] == [
        ("1", 1, "How must it be"), ("1", 2, "How must it be duty"), ("1", 3, "How must it be steps"), ("2", 1, "x"), ("2", 2, "x scope"),
    ]


def test_text_matches_and_code_points(spark):
    df = spark.createDataFrame([("A  b", "x a B y"), ("", "a"), (None, "a"), ("a", "b")], "x string, y string")
    assert [r[0] for r in df.select(reports.text_matches(df, "x", "y")).collect()] == [True, False, False, False]
    assert spark.createDataFrame([("ab",), ("",)], "s string").select(reports.code_point_sum("s", 1000).alias("n")).collect() == [(195,), (0,)]


def test_predictions_are_kept_or_explained(spark):
    df = spark.createDataFrame([("Yes ", 0.5), ("no", 2.0), (None, 0.1), ("maybe", 0.1), ("no", None)], "l string, s double")
    good, bad = reports.normalised_predictions(df, "l", "s", {"yes": "in", "no": "out"})
    assert [r["canonical"] for r in good.collect()] == ["in"]
    assert sorted(r["reason"] for r in bad.collect()) == ["no label", "no score", "score out of range", "unknown label"]


def test_vector_top_k_either_way(spark, monkeypatch):
    import random

    rng = random.Random(4)
    rows = [(i, None if i == 7 else [rng.random() for _ in range(8)]) for i in range(90)] + [(90, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    asked = df.where("vec_id % 5 = 0")
    sent = sorted(map(tuple, retrieval.vector_top_k(asked, df, 4).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, retrieval.vector_top_k(asked, df, 4, per_block=16).collect())) == sent and len(sent) == 19 * 4
    assert retrieval.vector_top_k(asked.limit(0), df, 4).count() == 0


def test_larger_half_of_the_contexts(spark):
    df = spark.createDataFrame([("q", 0.1, 0.2, c) for c in (0.9, 0.5, 0.5, 0.1, 0.3)] + [("r", 0.0, 0.0, 0.4), (None, 0.0, 0.0, 0.2)], "id string, e double, n double, c double")
    got = {r["id"]: round(r["contradiction_top_half"], 9) for r in verify.context_statistics(df, "id", "e", "n", "c").collect()}
    assert got == {"q": round((0.9 + 0.5 + 0.5) / 3, 9), "r": 0.4, None: 0.2}


def test_written_tables_are_dropped(spark):
    session.drop_tables(spark)
    df = session.materialise(spark.range(5).withColumn("x", F.lit(1)))
    assert df.count() == 5 and session.drop_tables(spark) == 1 and session.drop_tables(spark) == 0


def test_split_windows_equal_plain_ones(spark):
    import random

    from pyspark.sql import Window

    from quaystone.operators import joins, metrics

    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([None, "x", "y"]), rng.choice([None, 1, 2, 5]), rng.choice([0.1, 0.25, 0.5, 0.9])) for i in rng.sample(range(1000), 120)]
    df = spark.createDataFrame(rows, "g string, o int, v string, k int, s double")
    w = Window.partitionBy("g").orderBy("o")
    plain = df.withColumn("c", F.concat_ws(" ", F.lag("v").over(w), "v", F.lead("v").over(w))).withColumn("b", F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    want = sorted((r["o"], r["c"], r["b"]) for r in plain.collect())
    for ranges in (1, 7, 64):
        got = joins.running_before(joins.neighbours(df, "g", "o", "v", "c", ranges=ranges), "g", "o", "k", "b", ranges=ranges)
        assert sorted((r["o"], r["c"], r["b"]) for r in got.collect()) == want
    exact = {r["g"]: (r["m"], r["q"]) for r in df.groupBy("g").agg(F.percentile("s", F.lit(0.5)).alias("m"), F.percentile("s", F.lit(0.9)).alias("q")).collect()}
    near = {r["g"]: (r["m"], r["q"]) for r in metrics.quantiles(df, "g", "s", {"m": 0.5, "q": 0.9}).collect()}
    assert {k: tuple(round(x, 9) for x in v) for k, v in near.items()} == {k: tuple(round(x, 9) for x in v) for k, v in exact.items()}
    assert joins.neighbours(df.limit(0), "g", "o", "v", "c").count() == 0


def test_most_related_pairs_of_each_two_values(spark):
    from quaystone.operators import joins

    df = spark.createDataFrame([(1, "x", ["a", "b"]), (2, "y", ["a", "b"]), (3, "y", ["b"]), (4, "z", ["b"])], "id int, d string, t array<string>")
    assert sorted(map(tuple, joins.related_pairs(df, "id", "t", "d").collect())) == [(1, 2, 2), (1, 3, 1), (1, 4, 1), (2, 4, 1), (3, 4, 1)]
    assert sorted(map(tuple, joins.related_pairs(df, "id", "t", "d", per_pair=1).collect())) == [(1, 2, 2), (1, 4, 1), (2, 4, 1)]


def test_plugged_in_scores_keep_the_original(spark):
    df = spark.createDataFrame([("1", "ankara capital", "Ankara is the capital", 0.3), ("1", "ankara capital", "Inflation rose", 0.9)], "id string, q string, c string, score double")
    shared = lambda qs, cs: [len(set(q.lower().split()) & set(c.lower().split())) for q, c in zip(qs, cs)]
    rows = retrieval.top_k(retrieval.score_with(df, "q", "c", shared), "id", [F.desc("score"), "c"], 1).collect()
    assert [(r["c"], r["original_score"], r["score"]) for r in rows] == [("Ankara is the capital", 0.3, 2.0)]


def test_reranker_weighs_meaning_above_the_retriever(spark):
    df = spark.createDataFrame([("1", "q", "Ankara", "t", 0.3, 0, 1.0, 0), ("1", "q", "Inflation", "t", 0.9, 1, 0.0, 0), ("1", "q", " ", "t", 0.9, 2, 1.0, 9)], "id string, q string, c string, t string, s double, p int, m double, e int")
    out = retrieval.rerank_features(df, "id", "q", "c", "t", "s", "p", "m", "e").orderBy(F.desc("final_score")).collect()
    assert [r["c"] for r in out] == ["Ankara", "Inflation"]
    tie = retrieval.rerank_features(df.where("p < 2").withColumn("m", F.lit(0.5)), "id", "q", "c", "t", "s", "p", "m", "e").orderBy(F.desc("final_score")).collect()
    assert tie[0]["c"] == "Inflation"


def test_candidates_are_a_corpus_of_their_own(spark):
    df = spark.createDataFrame([("1", 1, "red fox", "a red fox runs"), ("1", 2, "red fox", "a dog sleeps"), ("2", 1, None, "a red fox runs"), ("1", 3, "red fox", None)], "id string, d int, q string, c string")
    got = {(r["id"], r["d"]): r["score"] for r in retrieval.bm25_candidates(df, "id", "d", "q", "c").collect()}
    assert got[("1", 1)] > 0 and got[("1", 2)] == got[("1", 3)] == got[("2", 1)] == 0


def test_word_overlap_either_way(spark, monkeypatch):
    import random

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["the"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 12))) if i % 9 else None) for i in range(80)], "doc_id bigint, text string").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", "The " + " ".join(rng.choice(vocabulary) for _ in range(4)) if i else None) for i in range(7)], "id string, query string")
    run = lambda: sorted(map(tuple, retrieval.overlap_top_k(asked, docs, "id", "query", "doc_id", "text", 5).select("id", "doc_id", "shared", "rank").collect()))
    sent = run()
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", -1)
    assert sent and run() == sent
    assert retrieval.overlap_top_k(asked.limit(0), docs, "id", "query", "doc_id", "text", 5).count() == 0
