"""Language of a text by a naive Bayes model over letter trigrams, fitted on labelled documents."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from quaystone.llm.sample import bounded

#: Labelled documents the model is fitted on.
SAMPLE_DOCS = 3_000
_WHOLE = re.compile(r"[^\n]{20,300}?[^\W\d_]{2}[.!?。！？؟।]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def _grams(text: str) -> Counter:
    clean = " " + _NOT_LETTERS.sub(" ", text.lower()) + " "
    return Counter(clean[i : i + 3] for i in range(len(clean) - 2))


def script(text: str) -> str:
    """The script most letters of the text are in."""
    counts: Counter = Counter()
    for c in text:
        if c.isalpha():
            o = ord(c)
            counts[
                "latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "greek" if o < 0x400 or 0x1F00 <= o < 0x2000 else "cyrillic" if o < 0x530
                else "arabic" if 0x600 <= o < 0x780 else "indic" if 0x900 <= o < 0xE00 else "thai" if 0xE00 <= o < 0xE80 else "kana" if 0x3040 <= o < 0x3100 else "han" if 0x3400 <= o < 0xA000 else "other"
            ] += 1
    if not counts:
        return ""
    if counts["kana"] * 5 >= counts["han"] and counts["kana"]:
        counts["kana"] += counts.pop("han", 0)
    return max(counts, key=lambda k: (counts[k], k))


class Languages:
    """``samples`` holds a few openings of texts of each language; ``common`` its everyday words."""

    def __init__(self, rows: list[tuple[str, str]], known: int = 20_000, everyday: int = 60, openings: int = 12):
        import numpy as np

        counts: dict[str, Counter] = {}
        words: dict[str, Counter] = {}
        self.samples: dict[str, list[str]] = {}
        for lang, text in rows:
            counts.setdefault(lang, Counter()).update(_grams(text))
            words.setdefault(lang, Counter()).update(w.lower() for w in _NOT_LETTERS.split(text) if w)
            if len(own := self.samples.setdefault(lang, [])) < openings and (whole := _WHOLE.match(text)):
                own.append(whole.group())
        total = sum(counts.values(), Counter())
        vocabulary = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:known]]
        self.langs = sorted(counts)
        self.at = {g: i for i, g in enumerate(vocabulary)}
        # a row for each known trigram, the last one for all others
        self.logs = np.zeros((len(vocabulary) + 1, len(self.langs)))
        for k, lang in enumerate(self.langs):
            own = np.array([counts[lang].get(g, 0) for g in vocabulary] + [0]) + 0.5
            self.logs[:, k] = np.log(own / own.sum())
        self.common = {lang: {w for w, _ in words[lang].most_common(everyday)} for lang in self.langs}

    def scores(self, text: str) -> dict[str, float]:
        grams = _grams(text)
        rows = [self.at.get(g, len(self.at)) for g in grams]
        return dict(zip(self.langs, (self.logs[rows] * [[c] for c in grams.values()]).sum(0).tolist()))

    def best(self, text: str) -> str:
        scores = self.scores(text)
        return max(self.langs, key=lambda k: (scores[k], k))

    def everyday(self, text: str, lang: str) -> tuple[int, int]:
        """(words that are everyday words of ``lang``, the largest such number of any language)."""
        ws = [w.lower() for w in _NOT_LETTERS.split(text) if w]
        count = {k: sum(w in own for w in ws) for k, own in self.common.items()}
        return count[lang], max(count.values())


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Languages:
    """From about ``sample_docs`` labelled documents taken by the hash of their id; wrong labels are outvoted."""
    rows = docs.where(F.col(lang_col).isNotNull() & (F.lower(lang_col) != "und") & (F.length(text_col) > 20))
    found = bounded(rows, id_col, [F.lower(lang_col).alias("lang"), F.col(text_col).alias("t")], sample_docs, 3)
    return Languages([(r["lang"], r["t"]) for r in found])
