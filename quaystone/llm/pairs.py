"""Problem 4: broken prompt and response pairs.

Each defect has several noisy labelling functions that look at different things and
vote +1, -1 or 0. A label model per defect, fitted by expectation-maximisation on the
counts of all vote patterns (their number is bounded by the functions, not by the
data), estimates how far each function can be trusted; a function that abstains says
nothing, so a pattern without votes keeps the defect's share as its posterior.

Cutoffs are validated in every run: in a bounded sample of cases (``PLANTED``)
answers are replaced by defective ones of a known kind, and each defect gets the
middle of the cutoffs with the best F1 on them. They are seen by neither the counts nor the fit.

What a complete sentence looks like is learned from all answers: words with
varied neighbours are masked, and how an answer ends is held against the masked
ends of sentences that do have a full stop, and against their insides.

Defined results: a null, empty or blank answer is ``empty``; a null query has no
``copy`` or ``language`` vote; repeated rows of an id give one row per defect; no
cases give no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, functions as F

from quaystone.llm import cues, langid
from quaystone.llm.sample import bounded
from quaystone.llm.sentences import _BREAK
from quaystone.llm.words import RUN
from quaystone.session import materialise

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")
#: Cases whose answers are replaced to validate the cutoffs.
PLANTED = 900
#: Cutoffs that are tried.
GRID = tuple(x / 20 for x in range(1, 20))
#: Least share of all words that a word of a sentence frame has; bounds the frame list to its inverse.
FRAME_SHARE = 2e-5

#: What stands for an answer that was never given.
PLACEHOLDERS = frozenset(
    "none null nil nan na n/a tbd tba todo tbc pending empty blank missing unknown undefined no_answer unanswered placeholder answer response".split()
    + ["no answer", "not available", "not applicable", "no response", "to be done", "to be determined", "not provided", "keine antwort", "sin respuesta", "pas de réponse", "sans réponse", "cevap yok", "k a"]
)
_FIRST = r"\b(?:i|i['’]m|i['’]d|i['’]ll|we|me|my|this one i)\b"
_REFUSALS = (
    re.compile(_FIRST + r"[^.;]{0,40}\b(?:can['’]?t|cannot|can not|unable|not able|won['’]t|will not|must decline|have to decline|decline to|not feel comfortable|rather not|have to pass|told not|not allowed|not permitted|refuse)\b", re.I),
    re.compile(r"\b(?:not possible for me|against my|my (?:instructions|guidelines|rules|policy|policies)|talk about something else|change the (?:subject|topic)|not something i|something i (?:cannot|can['’]t|won['’]t))\b", re.I),
    re.compile(r"^\W*(?:(?:request|answer|reply|question) )?(?:declined|refused|denied|rejected)\W*$|^\W*no comment\W*$|^\W*(?:i )?(?:decline|refuse|pass)\W*$", re.I),
    re.compile(
        r"\b(?:kann|möchte|darf|werde) (?:ich|diese|dazu|das)[^.]{0,40}\bnicht\b[^.]{0,40}(?:beantworten|helfen|antworten|sagen|äußern)|\bje (?:ne peux|ne suis|refuse|dois refuser|regrette)|\b(?:no puedo|lo siento|no me es posible|prefiero no|debo negarme)|\b(?:yardımcı olamam|yanıtlayamam|cevap veremem|üzgünüm)",
        re.I,
    ),
)
#: Hand-labelled refusals that only validate the cutoff.
HELD_REFUSALS = (
    "I must pass on this one.", "That is outside what I may discuss.", "I'd rather not say.", "I'm afraid I can't assist with this question.", "My rules keep me from answering.", "I won't be able to help here.",
    "Please ask someone else, I cannot comment.", "Unfortunately we are not able to answer that.", "Ich kann diese Frage nicht beantworten.", "Je ne peux pas répondre à cette question.", "Lo siento, no puedo responder.", "Üzgünüm, bu soruyu yanıtlayamam.",
)
_OPENINGS = re.compile(r"^\W*(?:(?:i['’]m |i am |we are )?sorry|apologies|i apologi[sz]e|i regret|unfortunately|as an (?:assistant|ai)|with respect|thank you for asking|regrettably|es tut mir leid|leider|désolé|lo siento|üzgünüm)\b", re.I)
_FRAMES = re.compile(r"^\W*(?:q|question|query|prompt|a|answer|you asked|the question (?:is|was)|frage|pregunta|soru)\b", re.I)
_ENDS = re.compile(r"[.!?。！？؟।;…][\"”“»’」』)\]]*$")
_ZERO_WIDTH = re.compile("[​-‏⁠﻿­]")
_STRAY = re.compile(r"[\[({<\-–—,;:/\\&+*=~|]$")


def _clean(text: str | None) -> str:
    return _ZERO_WIDTH.sub("", text or "").strip()


def _sentences(text: str) -> list[str]:
    """Sentences by the cues alone, which is enough to count frames."""
    out = []
    for par in _BREAK.split(text):
        begin = 0
        for end in [*cues.ends(par), len(par)]:
            body = par[begin:end].strip()
            if body:
                out.append(body)
            begin = end
    return out


def _finished(sentence: str) -> bool:
    """Ends in a closing mark that is not the stop of an abbreviation."""
    if not _ENDS.search(sentence):
        return False
    last = sentence.rstrip("\"”“»’」』)] ")
    if last.endswith("."):
        token = re.split(r"[\s(\[\"“„«]", last[:-1].lower())[-1]
        if token == last[:-1].lower():
            return True
        return token not in cues.BOUND and token not in cues.COUNTED
    return True


def _ends(marked: tuple[str, ...]) -> tuple[str, str]:
    """The last four and the last three marks of a masked sentence or its beginning."""
    padded = ("▸", *marked)
    return " ".join(padded[-4:]), " ".join(padded[-3:])


def _tokens(sentence: str) -> list[str]:
    return ["9" if w[0].isdigit() else w.lower() for w in RUN.findall(sentence)]


def signature(tokens: list[str], frame) -> tuple[str, ...]:
    """Frame words as they are, everything else as one mark."""
    out: list[str] = []
    for w in tokens:
        mark = w if w in frame or w == "9" else "□"
        if mark != "□" or not out or out[-1] != mark:
            out.append(mark)
    return tuple(out)


def frame_words(answers: DataFrame, share: float = FRAME_SHARE, varied: float = 12.0, frequent: float = 0.008) -> frozenset:
    """Words of sentence frames: frequent, or with few different neighbours; at most 1 / share words."""

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                for s in _sentences(_clean(text)):
                    ws = ["▸", *_tokens(s), "◂"]
                    for a, w, b in zip(ws, ws[1:], ws[2:]):
                        seen[(w, 0, a)] += 1
                        seen[(w, 1, b)] += 1
            cols = list(zip(*((w, k, n, c) for (w, k, n), c in seen.items()))) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], ["w", "side", "other", "c"])

    pairs = answers.select("answer").where("answer is not null").mapInArrow(count, "w string, side int, other string, c bigint").groupBy("w", "side", "other").agg(F.sum("c").alias("c"))
    sides = pairs.groupBy("w", "side").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("l"))
    words = sides.groupBy("w").agg(F.max("n").alias("n"), F.max(F.exp(F.ln("n") - F.col("l") / F.col("n"))).alias("p"))
    words = materialise(words, "frame")
    total = words.agg(F.sum("n")).first()[0] or 0
    kept = words.where((F.col("n") >= max(3, total * share)) & ((F.col("n") >= total * frequent) | (F.col("p") < varied)))
    return frozenset(r["w"] for r in kept.select("w").collect())


def _in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    row = full = (1 << len(a)) - 1
    for w in b:
        m = row & at.get(w, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def _overlap(query: str, answer: str) -> tuple[float, int]:
    """(share of the query's words that the answer repeats in order, other words of the answer)."""
    q, a = [w.lower() for w in RUN.findall(query)], [w.lower() for w in RUN.findall(answer)]
    if not q or not a:
        return 0.0, len(a)
    same = _in_order(q, a)
    return same / len(q), len(a) - same


def _trigrams(text: str) -> set[str]:
    folded = " ".join(w.lower() for w in RUN.findall(text))
    return {folded[i : i + 3] for i in range(len(folded) - 2)} or {folded}


def _votes(query: str | None, answer: str | None, langs: langid.Languages, repeated: tuple[float, int]) -> dict[str, list[int]]:
    """Votes of the functions that need no counts, by defect."""
    text = _clean(answer)
    words = RUN.findall(text)
    folded = " ".join(w.lower() for w in words)
    placeholder = not words or folded in PLACEHOLDERS or text.lower() in PLACEHOLDERS
    # letters at all; a known placeholder; an answer of some length
    votes = {"empty": [-1 if words else 1, 1 if placeholder else -1, -1 if len(words) > 4 else 1]}

    # says what it won't do; speaks of rules or another matter; begins as an excuse; speaks of the matter; gives figures or declines late; goes on at length
    patterns = [bool(p.search(text)) for p in _REFUSALS]
    topic = {w.lower() for w in RUN.findall(query or "") if len(w) > 3 or w.isdigit()}
    about = len(topic & {w.lower() for w in words}) / max(1, len(topic))
    figures = any(w.isdigit() for w in words)
    head = " ".join(text.split()[:15])
    late = any(patterns) and not any(p.search(head) for p in _REFUSALS)
    detailed = figures or len(words) > 30
    votes["refusal"] = [0] * 6 if placeholder else [
        1 if patterns[0] or patterns[3] else -1,
        1 if patterns[1] or patterns[2] else -1,
        1 if _OPENINGS.match(text) else -1,
        -1 if about > 0.1 else 1,
        -1 if figures or late else 1,
        -1 if len(words) > 30 else 1,
    ]

    # repeats the query's words in order; adds little of its own; has no other letter runs; is put as the query is
    shared, others = repeated
    if placeholder or not query:
        votes["copy"] = [0] * 4
    else:
        own = _trigrams(text)
        foreign = len(own - _trigrams(query)) / len(own)
        votes["copy"] = [
            1 if shared >= 0.9 else -1 if shared < 0.7 else 0,
            1 if others <= 3 else -1 if others > 12 else 0,
            1 if foreign < 0.15 else -1 if foreign > 0.25 else 0,
            1 if _FRAMES.match(text) or text[-1:] == query.strip()[-1:] == "?" else -1,
        ]

    # script; letter trigrams; everyday words
    vote = [0] * 3
    letters = sum(c.isalpha() for c in text)
    if query and letters and not placeholder and not (any(patterns) and not detailed):
        q_script, a_script = langid.script(query), langid.script(text)
        vote[0] = 1 if q_script != a_script else -1 if q_script == a_script != "latin" else 0
        if langs.langs:
            q_best = langs.best(query)
            scores = langs.scores(text)
            margin = max(scores.values()) - scores[q_best]
            vote[1] = 1 if margin > 12 else -1 if margin < 4 else 0
            here, best = langs.everyday(text, q_best)
            vote[2] = 1 if best - here >= 2 else -1 if here >= best and here > 0 else 0
    votes["language"] = vote
    return votes


class LabelModel:
    """Functions independent given the class; one that abstains (0) has nothing to judge by and is no evidence.

    Starts from, and is held near (``trust`` times the cases, ten at least, as
    pseudo-counts), functions that are mostly right; the defect's share is
    estimated too.
    """

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, prior: float = 0.05, trust: float = 0.002, hit: float = 0.8, alarm: float = 0.05):
        patterns = [(p, c) for p, c in patterns if any(p)]
        n = len(patterns[0][0]) if patterns else 0
        self.share, self.plus = prior, {1: [hit] * n, 0: [alarm] * n}
        total = sum(c for _, c in patterns)
        trust = max(10.0, trust * total)
        for _ in range(rounds):
            post = [self.posterior(p) for p, _ in patterns]
            self.share = (sum(c * q for (_, c), q in zip(patterns, post)) + trust * prior) / (total + trust)
            for y, start in ((1, hit), (0, alarm)):
                for j in range(n):
                    mass = [(c * (q if y else 1 - q), p[j]) for (p, c), q in zip(patterns, post) if p[j]]
                    self.plus[y][j] = (sum(m for m, v in mass if v > 0) + trust * start) / (sum(m for m, _ in mass) + trust)

    def posterior(self, pattern: tuple[int, ...]) -> float:
        odds = math.log(self.share) - math.log(1 - self.share)
        for j, v in enumerate(pattern):
            if v:
                a, b = self.plus[1][j], self.plus[0][j]
                odds += math.log(a / b) if v > 0 else math.log((1 - a) / (1 - b))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def label_model(patterns: list[tuple[tuple[int, ...], int]], **options) -> dict[tuple[int, ...], float]:
    """{pattern: posterior of the defect} of a ``LabelModel`` fitted on (pattern, count)."""
    model = LabelModel(patterns, **options)
    return {p: model.posterior(p) for p, _ in patterns}


def planted(cases: DataFrame, langs: langid.Languages, n: int = PLANTED) -> list[tuple]:
    """(id, query, answer, kind): sampled cases with an answer of a known defect, and as they are (kind ``none``)."""
    import random

    out, rng = [], random.Random(5)
    rows = bounded(cases.where(F.length("query") > 0).where(F.length("answer") > 40), "id", ["id", "query", "answer"], n, 7)
    for k, r in enumerate(rows):
        kind = (*DEFECTS, "none")[k % 6]
        text = _clean(r["answer"])
        if kind == "truncated":
            last = (_sentences(text) or [text])[-1]
            if len(last) < 12:
                continue
            text = text[: len(text) - rng.randrange(4, len(last) - 4)].rstrip()
        elif kind == "empty":
            text = rng.choice(["", " ", "…", "n/a", "TBD", "none", "-", "(no answer)"])
        elif kind == "refusal":
            text = HELD_REFUSALS[k // 6 % len(HELD_REFUSALS)]
        elif kind == "copy":
            text = rng.choice(["", "You asked: ", "Question: "]) + r["query"]
        elif kind == "language":
            others = [t for lang in langs.langs if lang != langs.best(r["query"]) for t in langs.samples.get(lang, ())] if langs.langs else []
            if not others:
                continue
            text = rng.choice(others)
        out.append((r["id"], r["query"], text, kind))
    return out


def validated(model: LabelModel, defect: str, rows: list[tuple[str, tuple[int, ...], int]]) -> tuple[float, float, float]:
    """(cutoff, precision, recall) over planted (kind, pattern, count): the middle of the cutoffs whose F1 is within 0.02 of the best, 0.5 where none are.

    Only answers that are, or begin as, a case's own text stand against the defect.
    """
    tried = []
    rows = [r for r in rows if r[0] in (defect, "none", "truncated")]
    for cutoff in GRID:
        hit = sum(c for kind, p, c in rows if kind == defect and model.posterior(p) > cutoff)
        found = sum(c for kind, p, c in rows if model.posterior(p) > cutoff)
        true = sum(c for kind, _, c in rows if kind == defect)
        if true:
            tried.append((2 * hit / (found + true), cutoff, hit / max(1, found), hit / true))
    best = [t for t in tried if t[0] >= max(tried)[0] - 0.02]
    return best[len(best) // 2][1:] if best else (0.5, 0.0, 0.0)


def voted(cases: DataFrame, langs: langid.Languages, n: int = PLANTED) -> DataFrame:
    """(id, kind, defect, votes array<int>) of each case (kind null) and planted case, and defect."""
    spark = cases.sparkSession
    rows = materialise(cases.select("id", "query", "answer").distinct(), "cases")
    frame = frame_words(rows)
    id_type = rows.schema["id"].dataType.simpleString()
    held = spark.createDataFrame(planted(rows, langs, n), f"id {id_type}, query string, answer string, kind string")

    def known_sentences(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                found = _sentences(_clean(text))
                for at, s in enumerate(found):
                    # an ellipsis is a proper end only if the answer goes on after it
                    if not _finished(s) or (s.rstrip("\"”“»’」』)] ").endswith(("…", "...")) and at == len(found) - 1):
                        continue
                    ws = _tokens(s)
                    for k in range(1, len(ws) + 1):
                        four, three = _ends(signature(ws[:k], frame))
                        last = k == len(ws)
                        seen[("4", four, last)] += 1
                        seen[("3", three, last)] += 1
                        seen[("w", ws[k - 1], last)] += 1
            cols = list(zip(*((k, s, c if last else 0, 0 if last else c) for (k, s, last), c in seen.items()))) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["kind", "s", "final", "middle"])

    known = rows.select("answer").where("answer is not null").mapInArrow(known_sentences, "kind string, s string, final bigint, middle bigint")
    known = materialise(known.groupBy("kind", "s").agg(F.sum("final").alias("final"), F.sum("middle").alias("middle")), "known-sentences")

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            fours, threes, lasts, flags, votes = [], [], [], [], []
            for query, answer in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = _clean(answer)
                shared, others = _overlap(query or "", text)
                v = _votes(query, answer, langs, (shared, others))
                found = _sentences(text)
                last = found[-1] if found else ""
                ws = _tokens(_STRAY.sub("", last).strip())
                thai = langid.script(last) in ("thai", "")
                open_bracket = last.count("(") > last.count(")") or last.count("[") > last.count("]")
                capital = bool(ws) and RUN.findall(last)[-1][0].isupper() and len(ws[-1]) >= 6
                cut = last.endswith(("…", "..."))
                silent = not ws or thai or v["empty"][1] > 0 or (shared >= 0.9 and others <= 12)
                flags.append([int(_finished(last) and not cut), int(bool(_STRAY.search(last))), int(open_bracket), int(capital), int(silent), int(langid.script(last) in ("han", "kana"))])
                four, three = _ends(signature(ws, frame))
                fours.append(four)
                threes.append(three)
                lasts.append(ws[-1] if ws else "")
                votes.append([v["empty"], v["refusal"], v["copy"], v["language"]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(fours, pa.string()), pa.array(threes, pa.string()), pa.array(lasts, pa.string()), pa.array(flags, pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.list_(pa.int32())))],
                ["id", "kind", "four", "three", "last", "flags", "votes"],
            )

    all_rows = rows.withColumn("kind", F.lit(None).cast("string")).union(held)
    judged = materialise(all_rows.mapInArrow(judge, f"id {id_type}, kind string, four string, three string, last string, flags array<int>, votes array<array<int>>"), "judged")
    facts = judged
    for k, on in (("4", "four"), ("3", "three"), ("w", "last")):
        own = known.where(F.col("kind") == k).select(F.col("s").alias(on), F.col("final").alias(f"f{k}"), F.col("middle").alias(f"m{k}"))
        facts = facts.join(own, on, "left").fillna(0, [f"f{k}", f"m{k}"])
    f = lambda k: F.col("flags")[k]
    # an answer that has its full stop was counted itself
    facts = facts.withColumns({c: F.col(c) - F.when((f(0) == 1) & F.col("kind").isNull() & (F.col(c) > 0), 1).otherwise(0) for c in ("f4", "f3", "fw")})
    vote = lambda plus, minus: F.when(plus, 1).when(minus, -1).otherwise(0)
    strange = (F.col("fw") + F.col("mw") == 0) & (f(3) == 0) & (F.col("last") != "9")
    never_last = (F.col("fw") * 20 < F.col("mw")) & (F.col("mw") >= 3)
    seen4 = F.col("f4") + F.col("m4") > 0
    ends = (F.col("f4") * 50 >= F.col("m4")) & (F.col("f4") > 0) | ~seen4 & (F.col("f3") * 20 >= F.col("m3")) & (F.col("f3") > 0)
    # the closing mark; stray marks and open brackets; a last word that is none; one that never ends a sentence; how
    # sentences with these last words go on (the last three say nothing before a stray mark or without blanks)
    hangs = f(1) == 1
    mute = hangs | (f(5) == 1)
    usual = (F.col("fw") > 0) | (f(3) == 1) | (F.col("last") == "9")
    truncated = F.array(
        vote(f(0) == 0, f(0) == 1),
        vote((f(2) == 1) | hangs, F.lit(True)),
        vote(strange & ~mute, usual & ~mute),
        vote(never_last & ~mute, usual & ~mute),
        vote(~ends & (F.col("m4") + F.col("m3") > 0) & (f(5) == 0), ends & ~mute),
    )
    truncated = F.when(f(4) == 1, F.array(*[F.lit(0)] * 5)).otherwise(truncated)
    per = [F.struct(F.lit(d).alias("defect"), (truncated if d == "truncated" else F.col("votes")[("empty", "refusal", "copy", "language").index(d)]).alias("votes")) for d in DEFECTS]
    return facts.select("id", "kind", F.explode(F.array(*per)).alias("x")).select("id", "kind", "x.defect", "x.votes")


def defects(cases: DataFrame, langs: langid.Languages, id_col: str = "id", query_col: str = "query", answer_col: str = "candidate_answer", cutoffs: dict[str, float] | None = None, n: int = PLANTED) -> DataFrame:
    """(id, defect, posterior) of every defect whose posterior exceeds its cutoff: the one given, else the validated one."""
    spark = cases.sparkSession
    votes = materialise(voted(cases.select(F.col(id_col).alias("id"), F.col(query_col).alias("query"), F.col(answer_col).alias("answer")), langs, n), "votes")
    seen: dict[str, list] = {d: [] for d in DEFECTS}
    held: dict[str, list] = {d: [] for d in DEFECTS}
    for r in votes.groupBy("defect", "votes", "kind").count().collect():  # 3 ** functions rows per defect and kind at most
        if r["kind"] is None:
            seen[r["defect"]].append((tuple(r["votes"]), r["count"]))
        else:
            held[r["defect"]].append((r["kind"], tuple(r["votes"]), r["count"]))
    found = []
    for d in DEFECTS:
        model = LabelModel(seen[d])
        cutoff = cutoffs[d] if cutoffs and d in cutoffs else validated(model, d, held[d])[0]
        found += [(d, list(p), q) for p, _ in seen[d] if (q := model.posterior(p)) > cutoff]
    table = spark.createDataFrame(found, "defect string, votes array<int>, posterior double")
    return votes.where("kind is null").join(F.broadcast(table), ["defect", "votes"]).groupBy("id", "defect").agg(F.max("posterior").alias("posterior"))
