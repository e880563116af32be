from quaystone.llm import splitting

PARAGRAPHS = "\n\n".join(["Rain fell on the hills all night. " * 5] * 4 + ["Banks report their liquidity each day. " * 5] * 4)
TEXTS = [PARAGRAPHS, PARAGRAPHS.replace("\n\n", " "), "word " * 300, "short"]


def test_cut_at_comes_from_the_pass_that_cuts(monkeypatch):
    measured = []
    plain = splitting.cohesion
    monkeypatch.setattr(splitting, "cohesion", lambda text, cuts, *a: measured.append(text) or plain(text, cuts, *a))
    assert splitting.cut_at(TEXTS, 400, 50) == ["paragraph", "sentence", "hard", None]
    assert measured == TEXTS[:3]


def test_kinds_and_pieces_agree(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    kinds = dict(map(tuple, splitting.kinds(df, limit=400, overlap=50).collect()))
    assert kinds == {0: "paragraph", 1: "sentence", 2: "hard"}
    assert {r["doc_id"] for r in splitting.pieces(df, limit=400, overlap=50).collect()} == set(kinds)


def test_pieces_are_cut_at_the_boundaries_that_are_reported():
    pars = "\n\n".join("word " * 1199 + "wordy" for _ in range(3))
    assert [len(p) for p in pars.split("\n\n")] == [6000] * 3
    kind, pieces = splitting.parted(pars)
    assert kind == "paragraph" and [pars[b:e] for _, b, e in pieces] == pars.split("\n\n")
    import random

    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["A few words here. ", "x" * rng.randrange(1, 70) + " ", "\n\n", "\n \n", "\n", "  ", "Another one ends? "]) for _ in range(rng.randrange(5, 80)))
        kind, pieces = splitting.parted(text, 100, 20)
        assert kind == (splitting.boundary_kind(text, 100) if len(text) > 100 else None), text
        at = 0
        for begin, new, end in pieces:
            assert begin <= new < end and end - begin <= 100 and new - begin <= 20 and not text[at:new].strip()
            at = end
        assert not text[at:].strip()
