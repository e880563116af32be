import random

import numpy as np
import pytest

from quaystone.llm import latent


def test_common_subsequences_equal_the_single_one():
    rng = np.random.default_rng(4)
    for columns in (1, 24, 64):
        a, b = rng.integers(-1, 6, (200, columns)), rng.integers(-1, 6, (200, 30))
        got = latent.common_subsequences(a, b)
        want = [latent.common_subsequence([f"{x}" if x >= 0 else f"a{i}" for i, x in enumerate(r)], [f"{x}" if x >= 0 else f"b{i}" for i, x in enumerate(s)]) for r, s in zip(a, b)]
        assert got.tolist() == want


@pytest.mark.parametrize("bytes_", [latent.BROADCAST_BYTES, -1])
def test_copies_off_the_stride_with_the_production_parameters(spark, monkeypatch, bytes_):
    monkeypatch.setattr(latent, "BROADCAST_BYTES", bytes_)
    rng = random.Random(12)
    words = [f"w{k}" for k in range(400)]
    texts = [[rng.choice(words) for _ in range(24)] for _ in range(24)]
    docs = []
    for i, copy in enumerate(texts):
        body = [rng.choice(words) for _ in range(72)]
        at = 24 + i % 12
        copy = [f"e{i}x{k}" if k % 5 == 2 else w for k, w in enumerate(copy)]  # 5 of 24; 13 are left in the worst window
        docs.append((i, " ".join(body[:at] + copy + body[at:])))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    records = spark.createDataFrame([(f"r{i}", " ".join(t)) for i, t in enumerate(texts)], "id string, text string")
    got = {(r["doc_id"], r["id"]) for r in latent.similar_passages(df, records).collect()}
    want = {(i, f"r{i}") for i in range(len(texts))}
    assert want <= got
