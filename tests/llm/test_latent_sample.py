import random

from quaystone.llm import latent, sample


def test_common_subsequence_brute_force():
    rng = random.Random(3)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 15))] for _ in range(2))
        assert latent.common_subsequence(a, b) == slow(a, b)


def _tables(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    texts = [[rng.choice(words) for _ in range(24)] for _ in range(30)]
    docs, want = [], set()
    for i in range(60):
        body = [rng.choice(words) for _ in range(48)]
        if i < 20:
            copy = list(texts[i])
            for k in (3, 11):
                copy[k] = "changed"
            body[24:24] = copy
            want.add((i, f"r{i}"))
        docs.append((i, " ".join(body), "x"))
    docs += [(90, None, "x"), (91, "", "x"), (92, "short text", "x"), docs[0]]
    records = [(f"r{i}", " ".join(t), 1) for i, t in enumerate(texts)] + [("null", None, 1), ("r0", " ".join(texts[0]), 1)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, ids string"), spark.createDataFrame(records, "id string, text string, start int"), want


def test_edited_copies_are_found_either_way(spark, monkeypatch):
    docs, records, want = _tables(spark)
    options = dict(features=1 << 10, rank=32, cosine=0.6, least=0.5)
    got = {(r["doc_id"], r["id"]) for r in latent.similar_passages(docs, records, **options).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 2
    monkeypatch.setattr(latent, "BROADCAST_BYTES", -1)
    again = {(r["doc_id"], r["id"]) for r in latent.similar_passages(docs, records, **options).collect()}
    assert again == got


def test_latent_of_nothing(spark):
    docs, records, _ = _tables(spark)
    assert latent.similar_passages(docs.limit(0), records, features=256, rank=8).count() == 0
    assert latent.similar_passages(docs, records.limit(0), features=256, rank=8).count() == 0


def test_bounded_sample(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    rows = sample.bounded(df, "doc_id", ["doc_id"], 500, 1)
    assert 400 < len(rows) < 600 and rows == sample.bounded(df.repartition(7), "doc_id", ["doc_id"], 500, 1)
    assert len(sample.bounded(df, "doc_id", ["doc_id"], 10**6, 1)) == 20_000 and sample.bounded(df.limit(0), "doc_id", ["doc_id"], 5, 1) == []


def test_answer_check(spark):
    text = "in 2019 the ratio of the second line rose to 14 percent while all other limits of the group stayed flat as planned"
    docs = spark.createDataFrame([(1, text), (2, text.replace("2019", "2021").replace("14", "15")), (3, text.replace("14", "15"))], "doc_id bigint, text string")
    records = spark.createDataFrame([("r1", text)], "id string, text string")
    got = {r["doc_id"]: r["answered"] for r in latent.similar_passages(docs, records, features=1 << 8, rank=8, cosine=-1.0).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.5}
