import random

from quaystone.llm import packing, tokenize


def _reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_ids_equal_the_library(spark, odd_docs):
    encode = _reference()
    got = tokenize.token_ids(odd_docs, block_chars=50_000).collect()
    assert len(got) == 8
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in got:
        assert list(r["ids"]) == encode(texts[r["doc_id"]])


def test_markers_are_ordinary_text_and_decode(spark):
    texts = ["<|endoftext|> it's   a\n\n test ١٢٣ 漢字", "I'll we've  ", "", None, "naïve   café…"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ids = tokenize.token_ids(df)
    encode = _reference()
    assert {r["doc_id"]: list(r["ids"]) for r in ids.collect()} == {i: encode(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in tokenize.decode(ids).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_empty_table(spark, no_docs):
    assert tokenize.token_ids(no_docs).count() == 0
    assert packing.containers(tokenize.token_counts(no_docs)).count() == 0


def _pack(spark, sizes, capacity=100, per_bucket=7):
    df = spark.createDataFrame([(i, s, 0, 0) for i, s in enumerate(sizes)], "doc_id bigint, n_tokens bigint, size int, piece int")
    return packing.containers(df, capacity, per_bucket=per_bucket).collect()


def test_containers_hold_every_piece_once(spark):
    rng = random.Random(3)
    sizes = [rng.choice([1, 5, 33, 50, 50, 99, 100, 101, 250, 1000]) for _ in range(400)] + [0, None, -3] + [50] * 300
    rows = _pack(spark, sizes)
    by_doc, load = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], {})[r["piece"]] = r["size"]
        load[r["container"]] = load.get(r["container"], 0) + r["size"]
    assert max(load.values()) <= 100
    for i, s in enumerate(sizes):
        if not s or s < 0:
            assert i not in by_doc
        else:
            assert sum(by_doc[i].values()) == s and len(by_doc[i]) == -(-s // 100)
    assert sorted(load) == list(range(len(load)))
    assert len(load) <= 1.05 * sum(load.values()) / 100 + 1


def test_histogram_packing_is_tight():
    rng = random.Random(5)
    histogram = {n: rng.randint(0, 50) for n in range(1, 2049)}
    patterns = packing.pack_histogram(histogram, 2048)
    placed = {}
    for count, pattern in patterns:
        assert sum(length * k for length, k in pattern) <= 2048
        for length, k in pattern:
            placed[length] = placed.get(length, 0) + k * count
    assert placed == {k: v for k, v in histogram.items() if v}
    assert sum(c for c, _ in patterns) <= 1.01 * sum(k * v for k, v in histogram.items()) / 2048 + 1
