"""Counts and chains of the sentence model come from every document, however they are spread over tasks and blocks."""

import pytest

from quaystone.llm import sentences

THAI = "ธนาคารต้องรายงานความเสี่ยงทุกเดือน ผู้ตรวจสอบยืนยันตัวเลขแล้ว รายงานฉบับนี้เป็นฉบับสุดท้าย"


@pytest.fixture(scope="module")
def texts():
    return [f"The bank met Quil. {i % 7} staff on site. Its report named item{i} twice! We read it. The bank replied, and the panel agreed.\n\nAll of it ended well. {THAI if i % 3 == 0 else ''}" for i in range(2600)] + ["", "   ", None]


def frame(spark, texts, tasks):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(tasks)


def test_words_are_counted_over_all_documents(spark, texts):
    marks, _ = sentences.models(frame(spark, texts, 5), "doc_id", "text", block_docs=900)
    tally = sentences.Tally()
    tally.add(sentences._paragraphs(t for t in texts if t))
    whole = tally.settled()
    assert marks.words.stopped["quil"] == marks.words.numbered["quil"] == 2600
    for name in ("tokens", "all", "large", "stopped", "starts", "numbered"):
        own, full = getattr(marks.words, name), getattr(whole, name)
        assert {w: own.get(w, 0) for w in tally.beside} == {w: full.get(w, 0) for w in tally.beside}


def test_tasks_do_not_matter_and_one_block_is_the_plain_fit(spark, texts):
    few = texts[:400]
    ask = lambda tasks, n: sentences.models(frame(spark, few, tasks), "doc_id", "text", block_docs=n)
    for a, b in zip(ask(1, 90), ask(6, 90)):
        assert a.weights == pytest.approx(b.weights, abs=1e-9)
    given = [t for t in few if t]
    for a, b in zip(ask(3, 1000), (sentences.train_punctuated(given), sentences.train_unpunctuated(given))):
        assert a.weights == pytest.approx(b.weights, abs=1e-9)


def test_every_place_is_taken_in_some_round(monkeypatch):
    monkeypatch.setattr(sentences, "ROUND_PLACES", 10)
    chain, taken = sentences.Chain(), set()
    beliefs = chain._beliefs
    monkeypatch.setattr(chain, "_beliefs", lambda scores, trans, clamp: taken.add(len(scores)) or beliefs(scores, trans, clamp))
    chain.fit([[(["x"], ["e"], 1)] * n for n in range(1, 90)])
    assert taken == set(range(1, 90))


def test_no_documents(spark):
    marks, letters = sentences.models(frame(spark, [None, ""], 1), "doc_id", "text")
    assert not any(marks.weights) and not any(letters.weights) and not marks.words.all
