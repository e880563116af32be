import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quaystone.functions import numeric, text as T, vectors
from quaystone.operators import chunking, converters, joins, lexical, metrics, retrieval, sampling, verify
from quaystone.sinks import files as sinks
from quaystone.sources import files as sources


def one(spark, column, **values):
    cols = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], cols) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


# ---- functions


def test_text_functions(spark):
    assert one(spark, T.squeeze(F.col("a")), a=("string", "  a\t b \n")) == "a b"
    assert one(spark, T.slug(F.col("a")), a=("string", " Über die Regeln (2) ")) == "ber-die-regeln-2"
    assert one(spark, T.plain(F.col("a")), a=("string", "A\n—B, 5%!")) == "a b, 5%"
    assert one(spark, T.numbers(F.col("a")), a=("string", "3,5 and 3.5 or 10%")) == ["3.5", "10"]
    assert one(spark, T.ngrams(F.col("a"), 2), a=("array<string>", ["a", "b", "c"])) == ["a b", "b c"]
    assert one(spark, T.ngrams(F.col("a"), 2), a=("array<string>", ["a"])) == []
    for line, want in (("3.1 Scope of rules", True), ("Scope of Rules", True), ("Scope of rules.", False), ("the scope", False), ("", False), ("X" * 121, False)):
        assert one(spark, T.is_heading(F.col("a")), a=("string", line)) is want


def test_overlaps(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "c"]), ([], ["a"]), (["a"], ["a"])], "l array<string>, r array<string>")
    assert [tuple(r) for r in df.select(T.jaccard("l", "r"), T.containment("l", "r")).collect()] == [(1 / 3, 1 / 3), (0.0, 0.0), (1.0, 1.0)]


def test_numeric_functions(spark):
    a, b = F.lit(0.2), F.lit(0.2)
    assert one(spark, numeric.argmax(["x", "y"], [a, b])) == "x"
    assert abs(one(spark, numeric.entropy([F.lit(0.5), F.lit(0.5)])) - 1) < 1e-12
    assert one(spark, numeric.entropy([F.lit(1.0), F.lit(0.0)])) == 0
    assert one(spark, numeric.ratio(F.lit(1), F.lit(0), 7)) == 7
    assert one(spark, numeric.nearest_rank(F.col("a"), 0.5), a=("array<double>", [4.0, 1.0, 3.0, 2.0])) == 3.0
    assert [one(spark, numeric.bin_of(F.lit(x), 10)) for x in (-1.0, 0.0, 0.1, 0.999, 1.0, 2.0)] == [0, 0, 1, 9, 9, 9]
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=("array<float>", [1.0, 0.0]), b=("array<float>", [0.0, 0.0])) == 0


# ---- chunkers


def test_fixed_chunks(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "  \n "), (5, "short")], "doc_id bigint, text string")
    rows = chunking.fixed(df, 100, 10).orderBy("doc_id", "chunk_index").collect()
    want = [text[s : s + 100] for s in range(0, 1000, 90)]
    assert [r["chunk"] for r in rows if r["doc_id"] == 1] == want
    assert [r["doc_id"] for r in rows if r["doc_id"] != 1] == [5]
    with pytest.raises(ValueError):
        chunking.fixed(df, 10, 10)


def test_backing_off_and_packing():
    text = "First clause. " * 20
    pieces = chunking.backing_off(text, 100, 20)
    assert all(p.endswith(".") for p in pieces[:-1]) and all(len(p) <= 100 for p in pieces)
    assert chunking.backing_off("", 10, 2) == [] and chunking.backing_off("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    assert chunking.packed(["aaaa", "bbbb", "cccc"], 10, 4) == ["aaaa\n\nbbbb", "bbbb\n\ncccc"]
    assert chunking.packed(["aaaa", "bbbb"], 6, 0) == ["aaaa", "bbbb"] and chunking.packed([], 6, 0) == []


def test_sections_carry_headings(spark):
    df = spark.createDataFrame([(1, "1. First Part\nline one\nline two\n\nmore\nSecond Part\nlast"), (2, None)], "doc_id bigint, text string")
    rows = chunking.sections(df).orderBy("block_no").collect()
    assert [(r["block_no"], r["heading"], r["block"]) for r in rows] == [(1, "1. First Part", "line one line two"), (2, "1. First Part", "more"), (3, "Second Part", "last")]


def test_clean(spark):
    assert one(spark, chunking.clean(F.col("a")), a=("string", "A regu-\nlation\nof banks.\n\n\n12\n\nPage 3\n\nNext")) == "A regulation of banks.\n\nNext"


def test_sequential_chunkers(spark):
    assert chunking.within("One two. Three four. " + "X" * 30, 20) == ["One two. Three four.", "X" * 20, "X" * 10]
    assert chunking.tail("Short.", 50) == "Short." and chunking.tail("A long first sentence here. And a last one that stays whole and is long.", 50) == "And a last one that stays whole and is long."
    assert chunking.tail("Aaaa bbbb cccc dddd. Tiny.", 10) == ""
    import numpy as np

    vs = [np.array(v, float) for v in ([1, 0], [1, 0], [0, 1], [0, 1])]
    assert chunking.grouped(["a" * 60, "b" * 60, "c" * 120, "d"], vs, 0.7, 100, 1000) == ["a" * 60 + " " + "b" * 60, "c" * 120 + " d"]
    df = spark.createDataFrame([(1, "1. First Part\n" + "A sentence of the first part. " * 20 + "\n\n2. Second Part\n" + "More of the second part. " * 20), (2, None), (3, "")], "doc_id bigint, text string")
    rows = chunking.by_section(chunking.sections(df), 300, 60).orderBy("chunk_index").collect()
    assert rows[0]["heading"] == "1. First Part" and rows[-1]["heading"] == "2. Second Part" and all(len(r["chunk"]) <= 370 for r in rows)
    assert chunking.semantic(df).count() > 0 and chunking.paragraphs(df).count() > 0 and chunking.numbered_paragraphs(df).where("doc_id <> 1").count() == 0


# ---- phrases


def test_phrases(spark):
    rows = [("It is not used to rank retail branches.", "rank retail branches", False), ("We rank retail branches. " + "x " * 80 + "Not so.", "rank retail branches", True), ("none", "", False), (None, "a", False), ("a.b (c", ".b (", True)]
    df = spark.createDataFrame([r[:2] for r in rows], "t string, p string")
    assert [r[0] for r in df.select(lexical.unnegated(F.col("t"), F.col("p"))).collect()] == [r[2] for r in rows]
    assert one(spark, lexical.citations(F.col("a")), a=("string", "Section 3.1 and section 3.1, Article 5")) == ["section 3.1", "article 5"]
    assert one(spark, lexical.first_rewrite(F.col("a"), [(r"\bshall\b", "need not"), (r"\bmust\b", "may")]), a=("string", "It must and must")) == "It may and must"
    assert one(spark, lexical.first_rewrite(F.col("a"), [(r"\bshall\b", "x")]), a=("string", "no rule")) is None
    pairs = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(60)], "id int, g string")
    got = lexical.ring_partners(pairs, "id", ["g"], buckets=2).collect()
    kinds = dict((r["id"], r["g"]) for r in pairs.collect())
    assert len(got) > 50 and all(kinds[r["id"]] != kinds[r["partner"]] for r in got)


# ---- ranking, classification, calibration


def test_ranking_metrics_graded(spark):
    ranked = spark.createDataFrame([(1, f"doc_{c}", i + 1) for i, c in enumerate("abcde")] + [(2, "z", 1)], "q int, d string, rank int")
    labels = spark.createDataFrame([(1, "doc_a", 2.0), (1, "doc_c", 1.0), (1, "doc_f", 0.5), (3, "y", 1.0)], "q int, d string, rel double")
    rows = {r["q"]: r for r in metrics.ranking(ranked, labels, "q", "d", (5, 10, 0)).collect()}
    ideal = 3 / math.log2(2) + 1 / math.log2(3) + (2**0.5 - 1) / math.log2(4)
    assert abs(rows[1]["ndcg_5"] - (3 / math.log2(2) + 1 / math.log2(4)) / ideal) < 1e-12
    assert rows[1]["recall_5"] == 2 / 3 and rows[1]["precision_5"] == rows[1]["precision_10"] == 0.4 and rows[1]["mrr"] == 1
    assert all(rows[2][c] == 0 for c in ("ndcg_5", "recall_5", "hit_5", "mrr")) and rows[3]["mrr"] == 0


def test_calibration(spark):
    perfect = spark.createDataFrame([(1.0, 1), (0.0, 0)], "p double, y int")
    assert metrics.calibration_error(metrics.reliability(perfect, "p", "y")).first()["ece"] == 0
    off = spark.createDataFrame([(0.6, 1), (0.6, 0), (None, 1)], "p double, y int")
    assert abs(metrics.calibration_error(metrics.reliability(off, "p", "y", 1)).first()["ece"] - 0.1) < 1e-12
    assert metrics.reliability(off, "p", "y").count() == 10


def test_best_threshold_brute_force(spark):
    rng = random.Random(1)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(500)]
    got = metrics.best_f1(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    pos = sum(y for _, y in rows)

    def score(t):
        tp = sum(y for s, y in rows if s >= t)
        fp = sum(1 - y for s, y in rows if s >= t)
        return (2 * tp / (tp + fp + pos), tp / pos, -fp, -t)

    best = max({s for s, _ in rows}, key=score)
    assert got["threshold"] == best and abs(got["f1"] - score(best)[0]) < 1e-12


def test_quantiles_and_consistency(spark):
    rows = [("a", float(x)) for x in (1, 1, 2, 5, 9)] + [("b", 3.0), ("b", None)]
    got = {r["g"]: r for r in metrics.nearest_rank_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert (got["a"]["q10"], got["a"]["q50"], got["a"]["q90"]) == (1, 2, 9) and got["b"]["q50"] == 3
    vs = [("a", [1.0, 0.0]), ("a", [0.0, 2.0]), ("a", [1.0, 1.0]), ("b", [1.0, 0.0]), ("c", [0.0, 0.0]), ("c", [1.0, 0.0])]
    c = {r["g"]: r["consistency"] for r in metrics.mean_pairwise_cosine(spark.createDataFrame(vs, "g string, v array<float>"), "g", "v").collect()}
    assert abs(c["a"] - (0 + 2 / math.sqrt(2)) / 3) < 1e-6 and c["b"] == 1 and c["c"] == 0


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "s double, y int, g string")
    assert metrics.best_f1(none, "s", "y").count() == 0
    assert metrics.histogram(none, "s", 5).agg(F.sum("n")).first()[0] == 0
    assert metrics.distribution(none, "g", "s").count() == 0


# ---- retrieval


def test_vector_top_k_in_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(200, [0.0] * 8), (201, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = retrieval.vector_top_k(df.where("vec_id % 20 = 0"), df, 3, per_block=17).collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)) or 1)
    known = dict(rows)
    for q in range(0, 120, 20):
        best = sorted((-cos(known[q], v), i) for i, v in known.items() if v and i != q)[:3]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for _, i in best]


def test_round_robin_ranks_after_dedup(spark):
    hits = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 1, 2), (1, "b", 2, 1), (1, "c", 2, 2)], "q int, key string, bucket int, rank int")
    rows = retrieval.merge_round_robin(hits, "q", "key", "bucket", "rank", 10).orderBy("merged_rank").collect()
    assert [r["key"] for r in rows] == ["a", "c", "b"]


def test_feature_rerank_prefers_title(spark):
    hits = spark.createDataFrame([(1, "liquidity rules", "some text", "Liquidity rules", 0.5, 1), (1, "liquidity rules", "some text", "Other", 0.5, 0), (1, "liquidity rules", " ", "x", 0.9, 2)], "q int, query string, content string, title string, score double, position int")
    rows = retrieval.rerank_features(hits, "q", "query", "content", "title", "score", "position").orderBy(F.desc("final_score")).collect()
    assert len(rows) == 2 and rows[0]["title"] == "Liquidity rules" and rows[0]["f_title_overlap"] == 1


# ---- verification


def test_support(spark):
    df = spark.createDataFrame([("q", "the ratio is 5%", "it says the ratio is 5% now"), ("q", "the ratio is 7% for banks", "the ratio is 5% for banks"), ("q", "bees make honey", "the ratio is 5%"), (None, None, None)], "q string, c string, e string")
    assert [r["support_status"] for r in verify.support(df, "q", "c", "e").collect()] == ["supported", "contradicted", "unsupported", "unsupported"]


def test_context_statistics(spark):
    df = spark.createDataFrame([(1, 0.8, 0.1, 0.1), (1, 0.1, 0.1, 0.8)], "id int, e double, n double, c double")
    r = verify.context_statistics(df, "id", "e", "n", "c").first()
    assert r["contexts"] == 2 and abs(r["conflict_mass"] - 0.1) < 1e-12 and r["contradiction_top_half"] == 0.8 and r["disagreement"] == 0.5


# ---- joins, sampling


def test_join_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "")], "id int, v string")
    b = spark.createDataFrame([(1, "y"), (3, "z")], "id int, w string")
    assert tuple(joins.coverage(a, b, "id").first()) == (1, 1, 1)
    with pytest.raises(ValueError):
        joins.strict(a, b, "id")
    new = spark.createDataFrame([(1, ""), (2, "n")], "id int, v string")
    assert {tuple(r) for r in joins.update_from(a, new, "id", ["v"]).collect()} == {(1, "x"), (2, "n")}
    assert {tuple(r) for r in joins.insert_absent(a, spark.createDataFrame([(2, "q"), (5, "n")], "id int, v string"), "id").collect()} == {(1, "x"), (2, ""), (5, "n")}


def test_sampling_is_deterministic_and_exact(spark):
    df = spark.createDataFrame([(f"i{i}", "ab"[i % 3 == 0]) for i in range(90)], "id string, g string")
    assert sampling.sample(df, 10, "id").count() == 10
    assert {r["id"] for r in sampling.sample(df, 10, "id").collect()} == {r["id"] for r in sampling.sample(df.repartition(7), 10, "id").collect()}
    assert {tuple(r) for r in sampling.balance(df, "g", "id").groupBy("g").count().collect()} == {("a", 30), ("b", 30)}
    assert {tuple(r) for r in sampling.balance(df, "g", "id", "over").groupBy("g").count().collect()} == {("a", 60), ("b", 60)}
    parts = {tuple(r)[:2]: r["count"] for r in sampling.split(df, "g", (0.8, 0.1), "id").groupBy("g", "split").count().collect()}
    assert parts[("a", "train")] == 48 and parts[("a", "validation")] == 6 and parts[("b", "test")] == 3


# ---- converters


def test_converters(spark):
    claims = spark.createDataFrame([("1", "c", "SUPPORTS", ["e", "e", "f"]), ("2", "c", "odd", [" "])], "id string, claim string, label string, evidence array<string>")
    assert sorted(tuple(r) for r in converters.claims(claims).collect()) == [("1", "e", "c", 0, "claim"), ("1", "f", "c", 0, "claim")]
    qa = spark.createDataFrame([("1", "q", [("q1", "a1"), ("q2", "a2")]), ("2", "q", [("q", "a")])], "id string, question string, pairs array<struct<question: string, answer: string>>")
    rows = converters.question_pairs(qa).collect()
    assert len(rows) == 8 and {r["hypothesis"] for r in rows if r["id"] == "1" and r["label"] == 1} == {"The answer is a1.", "The answer is a2."}
    assert all(r["premise"].split()[-1] not in r["hypothesis"] for r in rows if r["kind"] == "mismatch")
    answers = spark.createDataFrame([("1", "text", ["A b", "C d", "E f", "G h"])], "id string, answer string, claims array<string>")
    assert converters.long_answers(answers).count() == 9
    lines = spark.createDataFrame([(1, "bank\tN\t0-1\tone\ttwo"), (2, "bad")], "line_no int, line string")
    gold = spark.createDataFrame([(1, "T"), (2, "F")], "line_no int, gold string")
    assert [r["label"] for r in converters.word_senses(lines, gold).collect()] == [0]
    cond = spark.createDataFrame([("1", "q", [("if", "a")], "ctx")], "id string, question string, properties array<struct<condition: string, answer: string>>, context string")
    assert converters.conditions(cond).count() == 3
    amb = spark.createDataFrame([("1", "q", True, "c"), ("2", "q", False, "")], "id string, question string, ambiguous boolean, clarification string")
    assert sorted((r["id"], r["label"]) for r in converters.clarifications(amb).collect()) == [("1", 0), ("1", 1), ("2", 2)]
    assert converters.merged({"a": (claims, 1.5), "b": (claims, 0.5), "c": (claims, 0.0)}).groupBy("dataset").count().orderBy("dataset").collect()[0]["count"] == 3
    assert converters.valid(converters.claims(claims)).count() == 2


# ---- files


def test_file_scans(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\n\n\n\ntwo\nthree")
    (tmp_path / "sub" / "b.jsonl").write_text('{"content": "x", "k": 1}\nnot json\n{"other": "y"}\n')
    (tmp_path / "c.json").write_text(json.dumps({"documents": [{"content": "d1"}, {"content": "d2", "k": "v"}]}))
    (tmp_path / "d.html").write_text("<html><script>var x;</script><body><p>Hello&nbsp;&amp; bye</p></body></html>")
    (tmp_path / "e.bin").write_text("?")
    got = sources.directory(spark, str(tmp_path)).collect()
    assert sorted(r["content"] for r in got if r["content"] != "one\n\n\n\ntwo\nthree") == ["Hello & bye", "d1", "d2", "x", '{"other": "y"}']
    assert [(r["content"], r["metadata"]["index"]) for r in sources.text(spark, str(tmp_path / "a.txt"), "paragraph").collect()] == [("one", "1"), ("two\nthree", "3")]
    assert [r["metadata"]["index"] for r in sources.jsonl(spark, str(tmp_path / "sub" / "b.jsonl")).collect()] == ["1", "3"]
    (tmp_path / "m.yaml").write_text("sources:\n - {id: a, url: u}\n - {id: b}\n")
    assert sources.manifest(spark, str(tmp_path / "m.yaml"), ids=["b"]).collect()[0]["url"] is None
    (tmp_path / "bad.yaml").write_text("sources: []\n")
    with pytest.raises(ValueError):
        sources.manifest(spark, str(tmp_path / "bad.yaml"))
    pages = spark.createDataFrame([("s", 2, "b"), ("s", 1, "a")], "source string, page int, content string")
    assert sources.page_document(pages).first()["content"] == "[PAGE 1]\na\n\n[PAGE 2]\nb"
    with pytest.raises(ValueError):
        sources.required(pages, ["content", "title"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], {"k": "v"}), (2, None, None)], "id int, xs array<string>, m map<string, string>")
    sinks.csv(df, str(tmp_path / "csv"))
    assert {r["xs"] for r in sources.csv(spark, str(tmp_path / "csv")).collect()} == {'["a","b"]', None}
    sinks.bundle(spark.createDataFrame([("x", 1.0, True), (None, 0.0, False)], "f string, score double, ok boolean"), str(tmp_path / "b"), ["f"], ["score"], "not ok")
    assert spark.read.json(str(tmp_path / "b/overall")).first()["score"] == 0.5 and spark.read.json(str(tmp_path / "b/failures")).count() == 1
    store = sinks.Collection(spark, str(tmp_path / "store"))
    assert store.count() == 0
    rows = spark.createDataFrame([([1.0, 0.0], f"t{i}", {"g": "a" if i < 3 else None}) for i in range(5)], "embedding array<float>, content string, metadata map<string, string>")
    store.add(rows, "content")
    store.add(rows, "content")
    assert sorted(r["id"] for r in store.read().collect()) == list(range(10)) and not store.ensure(rows.union(rows), "content")
    hits = store.search(spark.createDataFrame([(0, [1.0, 0.1])], "query_id bigint, embedding array<float>"), 2, where="metadata['g'] = 'a'")
    assert [r["id"] for r in hits.orderBy("rank").collect()] == [0, 1]


def test_library_does_not_need_the_llm_folder():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "quaystone"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "quaystone.llm" not in path.read_text(), path


def test_bm25_either_way(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the Cat sat"), (2, "the dog sat sat"), (3, None), (4, ""), (5, "a bird"), (6, "the cat the cat")], "d bigint, t string")
    queries = spark.createDataFrame([("x", "cat sat"), ("y", None), ("z", "the the bird"), ("w", "nothing")], "q string, s string")
    a = {tuple(r) for r in retrieval.bm25_top_k(queries, docs, "q", "s", "d", "t", 2).collect()}
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 0)
    b = {tuple(r) for r in retrieval.bm25_top_k(queries, docs, "q", "s", "d", "t", 2).collect()}
    assert a == b and {r[0] for r in a} == {"x", "z"}
    assert retrieval.bm25_top_k(queries.limit(0), docs, "q", "s", "d", "t", 2).count() == 0
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 100)
    assert retrieval.bm25_top_k(queries, docs.limit(0), "q", "s", "d", "t", 2).count() == 0 and retrieval.bm25_top_k(queries.limit(0), docs, "q", "s", "d", "t", 2).count() == 0
