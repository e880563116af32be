import re

from quaystone.llm import langid, ocr, pairs, sentences, splitting


def test_pieces_cover_and_respect_limits(spark, odd_docs, no_docs):
    rows = splitting.pieces(odd_docs).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {5, 6}
    for i, ps in by.items():
        ps.sort(key=lambda r: r["piece"])
        t = texts[i]
        assert ps[0]["start_pos"] == 1 and ps[-1]["end_pos"] == len(t)
        for a, b in zip(ps, ps[1:]):
            assert b["new_pos"] == a["end_pos"] + 1 and 0 <= b["new_pos"] - b["start_pos"] <= 200
        for p in ps:
            assert p["text"] == t[p["start_pos"] - 1 : p["end_pos"]] and len(p["text"]) <= 6000
    assert {(r["doc_id"], r["cut_at"]) for r in splitting.kinds(odd_docs).collect()} == {(5, "sentence"), (6, "hard")}
    assert splitting.pieces(no_docs).count() == 0 and splitting.kinds(no_docs).count() == 0


def test_boundary_kinds():
    par = "A sentence of words. " * 100
    assert splitting.boundary_kind("\n\n".join([par] * 5)) == "paragraph"
    assert splitting.boundary_kind(par * 4) == "sentence"
    assert splitting.boundary_kind("\n".join(["x" * 3000] * 4)) == "sentence"
    assert splitting.boundary_kind("word " * 2000) == "hard"
    assert splitting.boundary_kind("y" * 6000 + "\n \n" + "z") == "paragraph"


def test_cohesion_prefers_the_topic_change():
    a, b = "apples pears plums cherries orchard. ", "engines pistons valves gears torque. "
    text = "\n\n".join([a * 12] * 6 + [b * 12] * 6)
    cut = splitting.cut(text, limit=4000, overlap=100)
    topic = text.index("engines") - 2
    assert any(abs(e - topic) < 3 for _, _, e in cut)


SAMPLES = [
    ("Dr. Lee paid approx. 3.5 million (cf. Table 2.1), as Mr. J. K. Marlow said. It rose… Then it fell.", 3),
    ('"Is it so?" the clerk asked. The panel replied: "No. 558 stays!" We left.', 3),
    ("Laut Art. 8 Abs. 1 prüfen sie z. B. Daten. Am 16. März 2022 stieg der Wert um 5 Mio. Einheiten. „Wer?“, fragte Dr. X.", 3),
    ("Mme Y a répondu : « Rien ne change. » « Faut-il ? » a demandé M. Z.", 2),
    ("检查员问：“谁负责？”“已经记录。”银行这样回答。没有。", 3),
    ("「十分ですか。」と尋ねた。銀行は「記録する。」と答えた。", 2),
    ("ในปี 2023 ฝ่ายตรวจสอบ ทีมกำกับดูแล", 2),
    ("सेवा है। 905 मामलों में डॉ. तेरमा बैंक है।", 2),
    ("Γιατί δοκιμάζουν; Ρώτησε ο κ. Xik αρ. 5 κ.λπ. πάλι.", 2),
    ("one line\nends not here. But\n\nthis is new", 3),
    ("no mark at all", 1),
    ("", 0),
    (" \n ", 0),
]


def test_sentence_samples(spark):
    chain = sentences.train_punctuated([t for t, _ in SAMPLES] * 40)
    for text, n in SAMPLES:
        spans = sentences.sentence_spans(text, chain)
        assert len(spans) == n, (text, [text[a - 1 : b] for a, b in spans])
        for a, b in spans:
            assert text[a - 1 : b] == text[a - 1 : b].strip()
        assert "".join(text[a - 1 : b] for a, b in spans).split() == "".join(text.split()) or re.sub(r"\s", "", "".join(text[a - 1 : b] for a, b in spans)) == re.sub(r"\s", "", text)


def test_sentences_odd_input(spark, odd_docs, no_docs):
    rows = sentences.sentences(odd_docs).collect()
    assert sum(r["doc_id"] == 5 for r in rows) == 3000 and sum(r["doc_id"] == 6 for r in rows) == 1
    assert sentences.sentences(no_docs).count() == 0


def test_unpunctuated_model_finds_held_out_boundaries():
    import random

    rng = random.Random(1)
    words = ["กขค", "จฉช", "ดตถ", "นบป", "มยร", "ลวส"]
    make = lambda: " ".join("เริ่ม" + "".join(rng.choice(words) for _ in range(4)) + "จบ" for _ in range(12))
    chain = sentences.train_unpunctuated([make() for _ in range(60)])
    held = make()
    run = held.replace(" ", "")
    truth, at = set(), 0
    for part in held.split(" ")[:-1]:
        at += len(part)
        truth.add(at)
    found = {b for _, b in sentences.sentence_spans(run, sentences.Chain(), chain)[:-1]}
    assert len(found & truth) >= 0.9 * len(truth) and len(found - truth) <= 0.1 * len(truth) + 1


def _corpus(rng, n):
    """(text, ends): English-like text with an abbreviation before names, one before figures, and one that may end a sentence."""
    nouns = "records ledgers audits limits reports models losses claims buffers plans".split()
    verbs = "exceed follow cover replace support delay affect measure".split()
    names = ["Alder", "Birch", "Cedar", "Denholm", "Elm", "Fir"]
    out = []
    for _ in range(n):
        text, ends = "", []
        for _ in range(rng.randrange(4, 9)):
            a, b, v = rng.choice(nouns), rng.choice(nouns), rng.choice(verbs)
            s = rng.choice([
                f"The {a} {v} the {b}.", f"Some {a} {v} new {b}.", f"Later we {v} some {b}.", f"The {a} of Dr. {rng.choice(names)} {v} {b}.", f"They {v} no. {rng.randrange(99)} and the {b}.",
                f"The {a} {v} Holm Inc. and the {b}.", f"The {a} {v} Holm Inc.", f"We {v} J. K. {rng.choice(names)} and the {b}.", f"He said: \"The {a} {v}.\"",
            ])
            text += (" " if text else "") + s
            ends.append(len(text))
        out.append((text, ends))
    return out


def _f1(pairs):
    hit = found = true = 0
    for a, b in pairs:
        hit, found, true = hit + len(a & b), found + len(a), true + len(b)
    return 2 * hit / max(1, found + true)


def test_chain_learns_abbreviations_and_needs_its_transitions():
    import random

    rng = random.Random(3)
    train, held = [t for t, _ in _corpus(rng, 500)], _corpus(rng, 200)
    scores = {}
    for transitions in (True, False):
        chain = sentences.train_punctuated(train, transitions=transitions)
        scores[transitions] = _f1([({b for _, b in sentences.sentence_spans(t, chain)}, set(e)) for t, e in held])
    naive = _f1([({m.end() for m in re.finditer(r'[.]"?(?=\s+[A-Z"]|$)', t)}, set(e)) for t, e in held])
    lower = _f1([({m.end() for m in re.finditer(r'[.]"?(?=\s|$)', t)}, set(e)) for t, e in held])
    assert scores[True] > 0.98 > max(naive, lower) and scores[True] >= scores[False], (scores, naive, lower)


def test_places_without_a_sure_label_are_decided_by_the_chain():
    import random

    texts = [t for t, _ in _corpus(random.Random(5), 300)]
    chain = sentences.train_punctuated(texts)
    open_, cut = 0, 0
    for t in texts:
        found = sentences.choices(t, chain.words)
        tags = chain.decode([chain.score(c.features) for c in found], [c.edges for c in found])
        open_ += sum(c.label is None for c in found)
        cut += sum(tag for c, tag in zip(found, tags) if c.label is None)
    assert 0 < cut <= open_


CLEAN = "The management body should monitor certified findings before each meeting. " * 30


def test_scan_is_repaired(spark):
    page = "\n".join([
        "3.1 Notes on findings   4",
        "The managernent body should monitor certifi-",
        "ed findings before each meeting. The manage-",
        "ment body should rnonitor findings before",
        "                 Page 4",
        "3.1 Notes on findings   5",
        "each meeting. The body should monitor cert1-",
        "fied findings before each meeting before the",
        "management body should monitor findings and",
        "should monitor certified findings before the",
        "management body should monitor the body and",
        "each meeting before findings and meeting the",
        "body.",
    ])
    df = spark.createDataFrame([(1, page, "x"), (2, CLEAN, "x"), (3, None, "x"), (4, "", "x"), (1, page, "x")], "doc_id bigint, text string, word string")
    rows = ocr.repaired(df).collect()
    assert len(rows) == 2 and {r["doc_id"] for r in rows} == {1}
    found = {(x["line_no"], x["kind"]) for x in rows[0]["lines"]}
    assert found == {(1, "header"), (2, "ocr"), (2, "hyphen"), (3, "hyphen"), (4, "ocr"), (5, "page_no"), (6, "header"), (7, "hyphen"), (7, "ocr")}
    text = rows[0]["text"]
    assert text.startswith("The management body should monitor certified findings before each meeting. The management body should monitor findings before each meeting.")
    assert "Page" not in text and "Notes" not in text


def test_lattice_merges_splits_and_keeps():
    known = {w: (900, 0, None, 0) for w in "the institutions and supervision of banks with controls".split()}
    known |= {"insti": (0, 1, None, 0), "tutions": (0, 1, None, 0), "super": (3, 0, None, 0), "vision": (4, 0, None, 0), "withcontrols": (0, 1, None, 0), "ofbanks": (0, 0, None, 0), "bauks": (0, 1, None, 0)}
    read = lambda *ws: [(k, w) for _, k, w in ocr.viterbi([(0, w, False) for w in ws], known, 1e6)]
    assert read("the", "insti", "tutions") == [("keep", None), ("merge", "institutions")]
    assert read("super", "vision", "and") == [("merge", "supervision"), ("keep", None)]
    assert read("withcontrols", "of", "banks") == [("split", "with controls"), ("keep", None), ("keep", None)]
    assert read("of", "banks") == [("keep", None), ("keep", None)]


def test_short_pages_wide_lines_and_broken_words(spark):
    page = "The management body should monitor certifi-\ned findings before each meet ing. The manage-\nment body should monitor find-\nings and monitor the findings before each"
    wide = page + "\nmeeting. " + "The body should monitor findings " * 4 + "before\neach meeting before the management body should\nmonitor findings."
    clean = CLEAN + "The body should monitor the findings. " * 10
    df = spark.createDataFrame([(1, page), (2, wide), *((3 + k, clean) for k in range(20))], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in ocr.repaired(df).collect()}
    assert set(got) == {1, 2}
    assert got[1]["text"].startswith("The management body should monitor certified findings before each meeting. The management body should monitor findings and")
    assert {(x["line_no"], x["kind"]) for x in got[1]["lines"]} == {(1, "hyphen"), (2, "hyphen"), (3, "hyphen")}


def test_scan_odd_input(spark, odd_docs, no_docs):
    assert ocr.repaired(odd_docs).count() == 0 and ocr.repaired(no_docs).count() == 0


def test_misread_directions():
    assert ocr.misread("management", "managernent") == 6
    assert ocr.misread("found", "foiind") == 2
    assert ocr.misread("bases", "hases") is None and ocr.misread("same", "same") is None
    assert set(ocr.foldings("resolution", True)) & set(ocr.foldings("resoliition", False))


def _cases(spark, rows):
    return spark.createDataFrame([(*r, "v", 0) for r in rows], "id string, query string, candidate_answer string, votes string, share int")


def test_defects(spark):
    q = "Which of the steps must the firm take first so that fund controls do not become late findings?"
    good = [f"The text expects the {w} to monitor fund controls once a month, and it names late findings as the second priority." for w in ("owner", "board", "desk", "panel", "office", "manager", "college", "team")] * 5
    rows = [(f"g{i}", q, a) for i, a in enumerate(good)] + [
        ("e1", q, None), ("e2", q, " ​ "), ("e3", q, "(no answer)"), ("e4", q, "N/A"), ("t1", q, "The text expects the owner to monitor fund cont"), ("t2", q, "The text expects the board to monitor fund controls once a"),
        ("r1", q, "I'm sorry, but I can't help with that request."), ("r2", q, "No comment."), ("c1", q, "You asked: " + q), ("c2", q, q.upper()), ("ok1", q, "Yes."), ("ok2", q, good[0][:-1]), ("l1", q, "Die Aufsicht prüft alle offenen Feststellungen und meldet sie jährlich an den Ausschuss."),
        ("n1", None, good[0]), ("e1", q, None),
    ]
    docs = [(i, "de", "Die Aufsicht prüft alle Feststellungen. Der Ausschuss meldet sie an die Behörde und prüft die offenen Daten jährlich.") for i in range(5)] + [(9 + i, "en", g + " " + q) for i, g in enumerate(good[:8])] + [(99, None, "x")]
    langs = langid.fit(spark.createDataFrame(docs, "doc_id bigint, lang string, text string"))
    got = {}
    for r in pairs.defects(_cases(spark, rows), langs).collect():
        got.setdefault(r["id"], set()).add(r["defect"])
    want = {"e1": {"empty"}, "e2": {"empty"}, "e3": {"empty"}, "e4": {"empty"}, "t1": {"truncated"}, "t2": {"truncated"}, "r1": {"refusal"}, "r2": {"refusal"}, "c1": {"copy"}, "c2": {"copy"}, "l1": {"language"}}
    assert got == want


def test_defects_of_nothing(spark):
    assert pairs.defects(_cases(spark, []) if False else spark.createDataFrame([], "id string, query string, candidate_answer string"), langid.Languages([])).count() == 0


def test_label_model_trusts_agreement():
    post = pairs.label_model([((1, 1, 1), 30), ((-1, -1, -1), 300), ((1, 1, 0), 10), ((0, -1, -1), 40)])
    assert post[(1, 1, 1)] > 0.9 and post[(1, 1, 0)] > 0.5 and post[(-1, -1, -1)] < 0.1 and post[(0, -1, -1)] < 0.3


def test_label_model_beats_majority_vote():
    import random

    rng = random.Random(2)
    hit, alarm, n = (0.95, 0.6, 0.55, 0.6), (0.01, 0.3, 0.35, 0.3), 20_000
    rows = []
    for _ in range(n):
        y = rng.random() < 0.1
        rows.append((y, tuple(0 if rng.random() < 0.1 else 1 if rng.random() < (hit if y else alarm)[j] else -1 for j in range(4))))
    counts = {}
    for _, p in rows:
        counts[p] = counts.get(p, 0) + 1
    post = pairs.label_model(list(counts.items()))
    wrong = lambda say: sum(say(p) != y for y, p in rows)
    assert wrong(lambda p: post[p] > 0.5) < 0.5 * wrong(lambda p: sum(p) > 0)
    assert pairs.LabelModel(list(counts.items())).posterior((0, 0, 0, 0)) < 0.5


def test_cutoffs_are_validated_on_planted_answers():
    model = pairs.LabelModel([((1, 1), 50), ((1, -1), 50), ((-1, -1), 900)])
    rows = [("copy", (1, 1), 20), ("copy", (1, -1), 2), ("none", (1, -1), 30), ("none", (-1, -1), 100)]
    cutoff, precision, recall = pairs.validated(model, "copy", rows)
    assert precision == 1.0 and recall > 0.9 and model.posterior((1, -1)) <= cutoff < model.posterior((1, 1))
    assert pairs.validated(model, "copy", [])[0] == 0.5
