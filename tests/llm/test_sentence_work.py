"""What is alike is looked at once in the fitting, and the short ways give what the long ones give."""

import itertools
import math
import random

import pytest

from quaystone.llm import sentences

THAI = "ธนาคารต้องรายงานความเสี่ยงทุกเดือน ผู้ตรวจสอบยืนยันตัวเลขแล้ว รายงานฉบับนี้เป็นฉบับสุดท้าย"
MIXED = "銀行は2024年にABC社を監査した。é結果は良好だった！リスク𠀋は低い。😀規則は守られた。"


def calls(monkeypatch, name, run):
    count, real = [0], getattr(sentences, name)

    def counted(*args):
        count[0] += 1
        return real(*args)

    monkeypatch.setattr(sentences, name, counted)
    run()
    monkeypatch.setattr(sentences, name, real)
    return count[0]


def test_letters_are_not_hashed_place_by_place(monkeypatch):
    places = 60 * len(THAI)
    assert calls(monkeypatch, "_slot", lambda: sentences.train_unpunctuated([THAI] * 60)) < places / 20


def test_equal_places_are_judged_once(monkeypatch):
    texts = [f"The bank met Quil. It replied in {i}. We read it! Then the panel agreed." for i in range(300)]
    assert calls(monkeypatch, "_sure", lambda: sentences.train_punctuated(texts)) < 400


def test_slots_of_letters_are_those_of_their_features():
    runs = ["".join(sentences._DENSE_GAP.split(t)) for t in (THAI, MIXED, "中", "銀行")]
    codes, begin = sentences._framed(runs)
    for run, at in zip(runs, begin.tolist()):
        inner = range(1, len(run))
        got = sentences._around_slots(codes, at + sentences._floats(list(inner)).astype(int))
        assert got.tolist() == [[sentences._slot(f) for f in sentences._around(run, i)] for i in inner]


def paths(scores, trans, clamp):
    """Weights of the tag pairs at every place, over all tag sequences."""
    out, whole = [[0.0] * 3 for _ in scores], 0.0
    for tags in itertools.product((0, 1), repeat=len(scores)):
        if any(c is not None and c != t for c, t in zip(clamp, tags)):
            continue
        pairs = list(zip((1, *tags), tags))
        weight = math.prod((s if b else 1.0) * {(0, 0): 1.0, (0, 1): t[0], (1, 0): t[1], (1, 1): t[2]}[a, b] for (a, b), s, t in zip(pairs, scores, trans))
        whole += weight
        for row, pair in zip(out, pairs):
            if pair != (0, 0):
                row[{(0, 1): 0, (1, 0): 1, (1, 1): 2}[pair]] += weight
    return [[x / whole for x in row] for row in out]


def test_beliefs_are_those_of_all_tag_sequences():
    draw = random.Random(3)
    for n in (1, 2, 5, 8):
        for clamp in ([None] * n, [draw.choice((None, 0, 1)) for _ in range(n)], [draw.choice((0, 1)) for _ in range(n)]):
            scores, trans = [math.exp(draw.uniform(-9, 9)) for _ in range(n)], [[math.exp(draw.uniform(-4, 4)) for _ in range(3)] for _ in range(n)]
            for got, want in zip(sentences.Chain()._beliefs(scores, trans, clamp), paths(scores, trans, clamp)):
                assert got == pytest.approx(want, abs=1e-12)


def test_runs_learn_as_sequences_do():
    chain = sentences.Chain()
    runs, _ = sentences._stripped(chain, [THAI, MIXED] * 8)
    listed = [[(tuple(fs), tuple(run.edges), int(y)) for fs, y in zip(run.slots.tolist(), run.labels.tolist())] for run in runs]
    plain = sentences.Chain().fit_slots(listed, rate=3.0)
    assert chain.fit_slots(runs, rate=3.0).weights == pytest.approx(plain.weights, abs=1e-9)


def test_scores_of_a_batch_change_no_sentence():
    marks, letters = sentences.train_punctuated([MIXED, THAI] * 20), sentences.train_unpunctuated([MIXED, THAI] * 20)
    texts = [MIXED, None, "", THAI + "\n\n" + MIXED, "No dense letters. None at all.", "中"]
    scores = sentences._letter_scores(texts, letters)
    for t in texts:
        assert sentences.sentence_spans(t, marks, letters, scores) == sentences.sentence_spans(t, marks, letters)
