"""Problem 10: sentence boundaries across languages and scripts.

Characters are tagged as the last of a sentence (boundary) or inside by a linear
chain with Viterbi decoding within each paragraph. There are no word lists. Counts
and both chains come from all rows and whole texts: words are counted in one pass;
then each block of documents fits its own chains, and a weight is the mean over the
blocks, by how often each of them met its feature.

* Punctuated text (``marks``): only closing marks with their quotes have a choice,
  all other characters are inside, as are all marks within a quotation. A mark's
  score is log-linear in what stands around it and in word statistics of the
  corpus: how often the word before it goes without a stop, how often the word
  after it is written small, how often it surely begins a sentence. Transition
  scores hang on the distance of two choices and on whether a quotation begins
  right after the one before. All weights are learned together, by the gradient of
  the partial-label likelihood: only positions that a small letter, a comma, a
  paragraph end or a long everyday word with a large letter after it make sure
  have a label; abbreviations, ordinals, figures, quotations and letters without
  case have none and are left to the chain.
* Scripts written without stops or blanks (``letters``): every place between two
  letters of Thai, Lao, Khmer, Burmese, Han or kana has a choice. This chain is
  fitted on text from which the marks and blanks that end sentences were stripped.

In Thai a blank between two letters ends a sentence by the definition of the
result, so it is a sure boundary for both.

Defined results: null, empty and blank texts have no sentence; a text without any
boundary is one sentence per paragraph; a blank line ends a sentence, a line end
alone does not; sentences have no outer blanks and keep their closing marks.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from quaystone.session import materialise

#: Documents of a block, which fits chains of its own.
BLOCK_DOCS = 10_000
#: Places of one round of fitting: with fewer each round takes all, with more each place comes in one round at least.
ROUND_PLACES = 60_000
#: Width of the hashed feature space.
WIDTH = 1 << 16

#: Marks that stand together, or one semicolon (the Greek question mark); begins with one class, which is searched for fast.
_TERM = re.compile(r"[.!?…。！？｡؟।॥;](?:(?<=;)|[.!?…。！？｡؟।॥]*)")
_WIDE = "。！？｡"
_BREAK = re.compile(r"\n[^\S\n]*(?:\r?\n)[\s]*|\r[^\S\n\r]*\r\s*")
_TOKEN = re.compile(r"[^\s(\[{\"“”„«»‘「『—–]+$")
_FOLLOW = re.compile(r"[\s\"“„«‘「『(\[¿¡  ]*")
_OPENS = re.compile(r"[\"“„«「『]")
_LETTERS = re.compile(r"[^\W\d_]+")
#: What stands between a mark and the letters that follow it, and these letters.
_NEXT = re.compile(rf"({_FOLLOW.pattern})([^\W\d_]*)")
#: A mark with what closes after it, where no quotation does, and ``_NEXT``.
_PLAIN = re.compile(rf"({_TERM.pattern})[)\]}}’]*(?={_NEXT.pattern})")
_QUOTE = re.compile(r'["“”„«»「」『』]')
#: A word; an initial keeps its full stop.
_WRITTEN = re.compile(r"[^\W\d_]{2,}|[^\W\d_]\.?")
_THAI = r"[ก-ฺเ-๎]"
_THAI_GAP = re.compile(rf"{_THAI}(\s+)(?={_THAI})")
#: Letters of scripts that are written without blanks between words.
_DENSE = r"[ก-ฺเ-๎຀-ໟក-៓က-႟぀-ヿ㐀-䶿一-鿿]"
_DENSE_LETTER = re.compile(_DENSE)
_DENSE_RANGES = [(ord(a), ord(b)) for a, b in re.findall("(.)-(.)", _DENSE)]
_DENSE_PAIR = re.compile(rf"{_DENSE}{_DENSE}")
_MARKS = ".,;:!?…()[]{}<>\"'“”„«»‘’‚‹›「」『』〈〉《》【】。，、；：！？｡؟،؛।॥·•*_/|—–-"
_DENSE_RUN = re.compile(rf"{_DENSE}{{8,}}")
_DENSE_GAP = re.compile(rf"(?<={_DENSE})(?:[。！？｡।.!?…]+\s*|\s+)(?={_DENSE})")
_PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "‘": "’", "‹": "›", "《": "》"}


def _quotes(par: str) -> list[tuple[int, int]]:
    """(first, last) of each quotation of a paragraph that is closed."""
    spans, stack, straight = [], [], None
    for m in _QUOTE.finditer(par):
        c, i = m.group(), m.start()
        if c == '"':
            if straight is None:
                straight = i
            else:
                spans.append((straight, i))
                straight = None
        elif stack and _PAIRS[stack[-1][0]] == c:
            spans.append((stack.pop()[1], i))
        elif c in _PAIRS:
            stack.append((c, i))
    return sorted(spans)


class Choice:
    """A place where a sentence may end: its end, features, what its transition hangs on, and a sure label or None."""

    __slots__ = ("end", "features", "edges", "label")

    def __init__(self, end: int, features: list[str], edges: list[str], label: int | None):
        self.end, self.features, self.edges, self.label = end, features, edges, label


@functools.lru_cache(maxsize=10_000)
def _kind(c: str) -> str:
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "lower" if c.islower() else "upper" if c.isupper() or c.istitle() else "caseless"
    return "comma" if c in ",;:،、，؛：-–—)%" else "other"


def _level(part: float, whole: float, prior: float = 0.5, weight: float = 1.0) -> int:
    """A share in six steps, drawn to a prior where little was seen."""
    return min(5, int(6 * (part + prior * weight) / (whole + weight)))


class Words:
    """Counts over the texts: word before a stop, words after, and how they are written."""

    def __init__(self):
        self.tokens: Counter = Counter()  # what stands between blanks, without outer marks
        self.all: Counter = Counter()  # a folded word, anywhere
        self.stopped: dict[str, int] = {}  # directly before a full stop
        self.large: Counter = Counter()  # with a large first letter
        self.starts: dict[str, int] = {}  # after what surely ends a sentence
        self.numbered: dict[str, int] = {}  # before a full stop that a figure follows

    def add(self, pars: list[str]) -> None:
        """Counts the words of paragraphs; what is written alike is looked at once. No word goes over a blank."""
        tokens, written, pairs = Counter(), Counter(), Counter()
        for par in pars:
            tokens.update(par.split())
        for t, n in tokens.items():
            self.tokens[t.strip(_MARKS).lower()] += n
            if t.isalpha() and len(t) > 1:
                written[t] += n
            else:
                for w in _WRITTEN.findall(t):
                    written[w] += n
        for w, n in written.items():
            if _DENSE_LETTER.match(w):  # no blanks: two letters stand for the word
                w = w.rstrip(".")
                if n == 1:
                    pairs.update(map(operator.add, w, w[1:]))
                    continue
                for pair in map(operator.add, w, w[1:]):
                    pairs[pair] += n
                continue
            self.all[w.lower()] += n
            if not w[0].islower():
                self.large[w.lower()] += n
        self.all.update(pairs)
        self.large.update(pairs)

    def stops(self, before: str, n: int, figures: int) -> None:
        self.stopped[before] = self.stopped.get(before, 0) + n
        self.numbered[before] = self.numbered.get(before, 0) + figures

    def start(self, word: str, n: int = 1) -> None:
        self.starts[word] = self.starts.get(word, 0) + n

    def free(self, before: str) -> int:
        """How often a word goes without a stop, in six steps; an inner stop and single letters have their own."""
        if "." in before:
            return 7
        if len(before) < 2:
            return 6
        return _level(self.tokens.get(before, 0) - self.stopped.get(before, 0), self.tokens.get(before, 0))

    def small(self, word: str) -> int:
        """How often a word is written small, in six steps; an initial's small twin is another word."""
        return 0 if word.endswith(".") else _level(self.all.get(word, 0) - self.large.get(word, 0), self.all.get(word, 0), 0.3)

    def figures(self, before: str) -> int:
        """How often a figure follows a word's full stop."""
        return _level(self.numbered.get(before, 0), self.stopped.get(before, 0), 0.15, 2.0)

    def begins(self, word: str) -> int:
        """Share of a word's large spellings that surely begin a sentence, on a scale of its own for rare ones."""
        return _level(self.starts.get(word, 0) * 6.0, self.large.get(word, 0), 0.5, 4.0) if self.large.get(word, 0) > 3 else -1


@functools.lru_cache(maxsize=100_000)
def _folded(letters: str, stop: bool) -> str:
    """A word without case; an initial keeps its full stop, and two letters stand for a word of a dense script."""
    return letters[:2] if _DENSE_LETTER.match(letters) else letters.lower() + ("." if stop else "")


def _word_of(par: str, letters: str, end: int) -> str:
    return _folded(letters, len(letters) == 1 and par[end : end + 1] == ".") if letters else ""


def _word_at(par: str, i: int) -> str:
    m = _LETTERS.match(par, i)
    return _word_of(par, m.group(), m.end()) if m else ""


def places(par: str, spans: list[tuple[int, int]]):
    """(start of the mark, end, mark, opening of a quotation closed there or None) of every mark outside quotations."""
    opened = {b: a for a, b in spans}
    out, k = [], 0
    for m in _TERM.finditer(par):
        e, quote = m.end(), None
        while e < len(par):
            c = par[e]
            if e in opened:
                quote = opened[e]
                e += 1
            elif c in ")]}’":
                e += 1
            elif c in "   " and e + 1 in opened and par[e + 1] in "»›":
                quote = opened[e + 1]
                e += 2
            else:
                break
        if out and out[-1][1] >= e:
            continue
        mark = m.group()[-1]
        spaced = e >= len(par) or par[e].isspace()
        if not spaced and mark not in _WIDE:
            if mark in ".…":
                continue
            after = _FOLLOW.match(par, e).end()
            if after < len(par) and par[e] not in "“„«「『¿¡" and _kind(par[after]) != "comma":
                continue
        while k < len(spans) and spans[k][1] < m.start():
            k += 1
        if any(a < m.start() and b >= e for a, b in spans[max(0, k - 2) : k + 6]):
            continue  # a quotation that the sentence frames
        out.append((m.start(), e, mark, quote))
    return out


def _surroundings(par: str) -> list[tuple]:
    """(start, end, mark, opening, where the text goes on, its kind, word before, word after) of every place."""
    out, size, spans = [], len(par), _quotes(par)
    if spans:
        for start, end, mark, quote in places(par, spans):
            m = _NEXT.match(par, end)
            after = m.end(1)
            out.append((start, end, mark, quote, after, _kind(par[after]) if after < size else "end", _tail(par, start), _word_of(par, m.group(2), m.end())))
        return out
    for m in _PLAIN.finditer(par):
        start, end = m.span()
        mark, after = par[m.end(1) - 1], m.end(2)
        kind = _kind(par[after]) if after < size else "end"
        if end < size and not par[end].isspace() and mark not in _WIDE:
            if mark in ".…" or after < size and par[end] not in "“„«「『¿¡" and kind != "comma":
                continue
        out.append((start, end, mark, None, after, kind, _tail(par, start), _word_of(par, m.group(3), m.end(3))))
    return out


def _sure(mark: str, quoted: bool, fresh: str, words: Words, kind: str, tail: str, large: bool, follower: str) -> int | None:
    """The label that a place has for certain or by the statistics of the words, or None."""
    if kind == "end":
        return 1
    if kind in ("lower", "comma"):
        return 0
    if quoted and fresh:
        return 1
    free = words.free(tail)
    everyday = len(tail) >= 3 and tail.isalpha() and free >= 3
    if quoted:
        if kind == "upper":
            return 1 if words.small(follower) >= 3 or words.begins(follower) >= 3 else None
        return 0 if kind == "caseless" and mark in _WIDE and words.begins(follower) == 0 else None
    if mark in "!?。！？｡؟।॥":
        return 1
    if kind == "digit":
        if words.figures(tail) >= 4:
            return 0
        return 1 if words.figures(tail) <= (1 if everyday else 2) and (everyday or len(tail) > 4) else None
    if kind == "upper":
        if everyday or words.small(follower) >= 3 or (len(tail) > 4 and tail.isalpha()):
            return 1
        return 0 if free in (0, 6, 7) and not tail.isdigit() and len(tail) < 4 + large and words.begins(follower) <= 1 else None
    return 1 if kind == "caseless" and everyday else None


def _tail(par: str, start: int) -> str:
    """The word directly before a mark, folded."""
    if start and not par[start - 1].isspace():
        last = par[max(0, start - 24) : start].rsplit(None, 1)[-1]
        return last.lower() if last.isalnum() else _last(last)
    return _last(par[max(0, start - 24) : start])


@functools.lru_cache(maxsize=100_000)
def _last(text: str) -> str:
    token = _TOKEN.search(text)
    return token.group().lower().strip("'’").rsplit("’", 1)[-1] if token else ""


@functools.lru_cache(maxsize=100_000)
def _features(mark: str, shape: str, frame: str, go: str, small: int | str, begins: int | str, figures: int | str, wide: str) -> list[str]:
    return ["bias", f"m={mark}", f"h={shape}", f"f={frame}", f"k={go}", f"s={small}", f"b={begins}", f"d={figures}", f"hs={shape}|{small}", f"hb={shape}|{begins}", f"hd={shape}|{figures}", f"fs={frame}|{small}", f"fb={frame}|{begins}", f"fk={frame}|{go}", f"{wide}|{frame}|{begins}"]


def _contexts(par: str) -> list[tuple[int, tuple]]:
    """End of every place, in order, and all that its features, edges and label hang on besides the counts."""
    out, before = [], 0
    for start, end, mark, quote, after, kind, tail, follower in _surroundings(par):
        frame = "none"
        if quote is not None:
            lead = par[before:quote].rstrip()
            frame = "colon" if lead[-1:] in (":", "：") and lead else "open" if not lead else "mid"
        fresh = "q" if after > end and _OPENS.search(par, end, after) else ""
        # the case of the word before is asked for where it has four letters
        large = len(tail) == 4 and par[start - 4].isupper()
        out.append((end, (mark, frame, fresh, kind, tail, large, follower if kind in ("upper", "caseless") else "", min(8, (end - before).bit_length()))))
        before = after if after < len(par) and par[after - 1 : after] not in "\"“„«‘「『([" else _skip(par, end)
    return out


def _judged(context: tuple, words: Words) -> tuple[list[str], list[str], int | None]:
    """Features, edges and label of a context."""
    mark, frame, fresh, kind, tail, large, follower, gap = context
    shape = f"n{len(tail)}" if tail.isdigit() else f"r{words.free(tail)}l{min(len(tail), 6)}" if mark == "." else "r"
    edges = [f"gap{gap}"] if frame == "none" else [f"gap{gap}", f"q-{frame}"]
    go = fresh + "on" if kind in ("lower", "comma") else fresh + kind if kind in ("end", "digit") else fresh + "new"
    small, begins = (words.small(follower), words.begins(follower)) if follower and not fresh else (go, go)
    figures = words.figures(tail) if kind == "digit" else "-"
    features = _features(mark, shape, frame, go, small, begins, figures, f"w{int(mark in _WIDE)}")
    return features, edges, _sure(mark, frame != "none", fresh, words, kind, tail, large, follower)


def _thai_gaps(par: str) -> list[int]:
    return [] if par.isascii() else [m.start(1) for m in _THAI_GAP.finditer(par)]


def choices(par: str, words: Words) -> list[Choice]:
    """Every place of a paragraph that has a choice, in order."""
    out = [Choice(end, *_judged(context, words)) for end, context in _contexts(par)]
    out += [Choice(at, ["thai-gap"], [], 1) for at in _thai_gaps(par)]
    out.sort(key=lambda c: c.end)
    return out


def _skip(par: str, at: int) -> int:
    while at < len(par) and par[at].isspace():
        at += 1
    return at


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (WIDTH - 1)


#: Odds of a certain boundary, beyond all that scores give.
_SURE = 1e100


class Chain:
    """A linear chain of two tags, inside and boundary, with hashed log-linear scores.

    A feature scores the boundary tag; an edge scores each of the four pairs of
    neighbouring tags. ``words`` are the counts that features are made of.
    """

    def __init__(self, words: Words | None = None, transitions: bool = True):
        self.words, self.transitions, self.weights = words or Words(), transitions, [0.0] * WIDTH
        self._slots: dict[str, int] = {}
        self._places: dict[tuple, tuple] = {}
        self._alike: dict[tuple, tuple] = {}

    def __getstate__(self):
        return {**self.__dict__, "_slots": {}, "_places": {}, "_alike": {}}

    def place(self, context: tuple) -> tuple[tuple[int, ...], tuple[tuple[int, int, int], ...], int | None]:
        """Slots of the features and edges of a context, and its label; equal ones are one object."""
        held = self._places.get(context)
        if held is None:
            features, edges, label = _judged(context, self.words)
            # the features are kept with their slots, so that no other ones get their id
            key = (id(features), label, *edges)
            found = self._alike.get(key)
            if found is None:
                found = self._alike[key] = (features, (*self.slots(features, edges), label))
            held = found[1]
            if len(self._places) < 200_000:
                self._places[context] = held
        return held

    def slot(self, feature: str) -> int:
        s = self._slots.get(feature)
        if s is None:
            s = _slot(feature)
            if len(self._slots) < 200_000:
                self._slots[feature] = s
        return s

    def score(self, features) -> float:
        w, slot = self.weights, self.slot
        return sum(w[slot(f)] for f in features)

    def edge(self, edges) -> tuple[float, float, float]:
        """Scores of the pairs (inside, boundary), (boundary, inside), (boundary, boundary); the first pair has 0."""
        if not self.transitions or not edges:
            return 0.0, 0.0, 0.0
        w, slot = self.weights, self.slot
        return sum(w[slot(e + "|ib")] for e in edges), sum(w[slot(e + "|bi")] for e in edges), sum(w[slot(e + "|bb")] for e in edges)

    def decode(self, scores: list[float], edges: list, sure: list | None = None) -> list[bool]:
        """Viterbi; what comes before the first place counts as a boundary. ``sure`` tags are kept."""
        known = {id(e): self.edge(e) for e in {id(e): e for e in edges}.values()}
        return self._best(scores, [known[id(e)] for e in edges], sure)

    @staticmethod
    def _best(scores, trans, sure: list | None = None) -> list[bool]:
        low = -1e9
        inside, bound, came = low, 0.0, []
        for s, (ib, bi, bb), fixed in zip(scores, trans, sure or itertools.repeat(None)):
            to_in, from_in, from_b = bound + bi, inside + ib, bound + bb
            came.append((to_in > inside, from_b > from_in))
            if fixed == 1:
                inside = low
            elif to_in > inside:
                inside = to_in
            bound = low if fixed == 0 else (from_b if from_b > from_in else from_in) + s
        tags, tag = [], bound > inside
        for from_in, from_b in reversed(came):
            tags.append(tag)
            tag = from_b if tag else from_in
        return tags[::-1]

    def _beliefs(self, scores, trans, clamp):
        """Probabilities of the tag pairs by forward-backward, given the clamped tags.

        Both passes carry one number, boundary over inside; ``_SURE`` stands for a tag that is a boundary for certain.
        """
        fwd, r = [], _SURE
        for s, (ib, bi, bb), fixed in zip(scores, trans, clamp):
            fwd.append(r)
            r = s * (ib + r * bb) / (1.0 + r * bi) if fixed is None else _SURE if fixed else 0.0
        out, back = [], 1.0
        for s, (ib, bi, bb), fixed, r in zip(reversed(scores), reversed(trans), reversed(clamp), reversed(fwd)):
            x = s * back if fixed is None else _SURE if fixed else 0.0
            jb, ji, jj = ib * x, r * bi, r * bb * x
            z = 1.0 + jb + ji + jj
            out.append((jb / z, ji / z, jj / z))
            back = (bi + bb * x) / (1.0 + jb)
        return out[::-1]

    def slots(self, features: list[str], edges: list[str]) -> tuple[tuple[int, ...], tuple[tuple[int, int, int], ...]]:
        return tuple(map(self.slot, features)), tuple(tuple(self.slot(e + x) for x in ("|ib", "|bi", "|bb")) for e in edges) if self.transitions else ()

    def fit(self, sequences: list[list[tuple[list[str], list[str], int | None]]], epochs: int = 4, rate: float = 1.5, seed: int = 11) -> Chain:
        """Averaged stochastic gradient of the partial-label likelihood: clamped minus free expectations."""
        return self.fit_slots([[(*self.slots(fs, es), y) for fs, es, y in seq] for seq in sequences], epochs, rate, seed)

    def fit_slots(self, sequences: list, epochs: int = 4, rate: float = 1.5, seed: int = 11) -> Chain:
        """``fit`` on features and edges that are slots; of many places each round takes a share, so that all are taken."""
        import random

        slotted = [seq for seq in sequences if isinstance(seq, Run) or any(y is not None for *_, y in seq)]
        dense = bool(slotted) and isinstance(slotted[0], Run)
        learn, w = (self._learn_run, _floats(self.weights)) if dense else (self._learn, self.weights)
        order, total, steps = random.Random(seed), [0.0] * WIDTH, 0
        size = math.ceil(len(slotted) * max(1 / epochs, min(1.0, ROUND_PLACES / max(1, sum(map(len, slotted))))))
        queue: list = []
        for epoch in range(epochs):
            while slotted and len(queue) < size:
                order.shuffle(slotted)
                queue += slotted
            chunk, queue = queue[:size], queue[size:]
            pace = rate / (1 + 0.5 * epoch)
            for seq in chunk:
                learn(w, seq, pace)
            if epoch >= epochs // 2:
                steps += 1
                total = [a + b for a, b in zip(total, w)]
        if steps:
            self.weights = [float(x) / steps for x in total]
        return self

    def _learn(self, w: list[float], seq: list, pace: float) -> None:
        at, exp, scores, trans = w.__getitem__, math.exp, [], []
        for fs, es, _ in seq:
            scores.append(exp(max(-30.0, min(30.0, sum(map(at, fs))))))
            pairs = map(at, es[0]) if len(es) == 1 else map(sum, zip(*[map(at, e) for e in es])) if es else (0.0, 0.0, 0.0)
            trans.append([exp(max(-20.0, min(20.0, x))) for x in pairs])
        labels = [y for *_, y in seq]
        free, held = self._beliefs(scores, trans, [None] * len(seq)), self._beliefs(scores, trans, labels)
        slow = 0.1 * pace
        for (fs, es, _), (f0, f1, f2), (h0, h1, h2) in zip(seq, free, held):
            g = (h0 + h2) - (f0 + f2)
            if abs(g) > 1e-3:
                d = pace * g / max(1, len(fs))
                for s in fs:
                    w[s] += d
            for a, b, c in es:
                w[a] += slow * (h0 - f0)
                w[b] += slow * (h1 - f1)
                w[c] += slow * (h2 - f2)

    def _learn_run(self, w, seq: Run, pace: float) -> None:
        """``_learn`` for a run whose labels are all known and whose places have the same edges."""
        import numpy as np

        slots, labels = seq.slots, seq.labels
        scores = np.exp(np.clip(w[slots].sum(axis=1), -30.0, 30.0))
        ib, bi, bb = (math.exp(max(-20.0, min(20.0, sum(w[e[k]] for e in seq.edges)))) for k in range(3))
        fwd, r, listed = [], _SURE, scores.tolist()
        for s in listed:
            fwd.append(r)
            r = s * (ib + r * bb) / (1.0 + r * bi)
        xs, back = [], 1.0
        for s in reversed(listed):
            x = s * back
            xs.append(x)
            back = (bi + bb * x) / (1.0 + ib * x)
        r, x = np.array(fwd), np.array(xs[::-1])
        jb, ji, jj = ib * x, bi * r, bb * r * x
        z = 1.0 + jb + ji + jj
        g = labels - (jb + jj) / z
        far = np.abs(g) > 1e-3
        np.add.at(w, slots[far].ravel(), np.repeat(pace * g[far] / slots.shape[1], slots.shape[1]))
        before = np.concatenate(([1.0], labels[:-1]))
        pairs = ((1.0 - before) * labels - jb / z).sum(), (before * (1.0 - labels) - ji / z).sum(), (before * labels - jj / z).sum()
        for e in seq.edges:
            for k in range(3):
                w[e[k]] += 0.1 * pace * pairs[k]


class Run:
    """Places of a run: slots of the features of each, edges that all have, and the labels."""

    __slots__ = ("slots", "edges", "labels")

    def __init__(self, slots, edges: list[tuple[int, int, int]], labels):
        self.slots, self.edges, self.labels = slots, edges, labels

    def __len__(self) -> int:
        return len(self.labels)


def _floats(weights: list[float]):
    import numpy as np

    return np.array(weights)


class Tally:
    """What ``Words`` are made of, from some of the texts."""

    def __init__(self):
        self.words = Words()
        self.beside: set[str] = set()  # words next to a mark, the only ones that are ever asked for
        self.waiting: Counter = Counter()  # (word before, word after) of stops that end a sentence if the first is an everyday word

    def add(self, pars: list[str]) -> None:
        self.words.add(pars)
        words = self.words
        for (mark, tail, follower, figure, start, asked), n in Counter(itertools.chain.from_iterable(map(self._marks, pars))).items():
            self.beside.add(tail)
            if asked:
                self.beside.add(follower)
            if mark == ".":
                words.stops(tail, n, n * figure)
            if start:
                if mark in "!?。！？｡؟।॥":
                    words.start(follower, n)
                elif len(tail) >= 3:
                    self.waiting[tail, follower] += n

    def _marks(self, par: str):
        """For every place: mark, word before, word after, is that a figure, may it begin a sentence, is it ever asked for."""
        first = _FOLLOW.match(par, 0).end()
        if not par[first : first + 1].islower():
            self.words.start(_word_at(par, first))
        for _, _, mark, quote, after, kind, tail, follower in _surroundings(par):
            yield mark, tail, follower, kind == "digit", kind != "end" and quote is None and not par[after].islower(), kind in ("upper", "caseless")

    def settled(self) -> Words:
        for (tail, follower), n in self.waiting.items():
            if self.words.free(tail) >= 3:
                self.words.starts[follower] = self.words.starts.get(follower, 0) + n
        return self.words


def _paragraphs(texts) -> list[str]:
    return [par for text in texts for par in _BREAK.split(text) if par and not par.isspace()]


def _marked(chain: Chain, pars: list[str]) -> tuple[list, Counter]:
    """Slots and labels of the places of every paragraph, and how often each slot is met; equal places share theirs."""
    out = []
    for par in pars:
        contexts = _contexts(par)
        if contexts:
            out.append(tuple([chain.place(context) for _, context in contexts]))
    met: Counter = Counter()
    held = {id(place): place for seq in out for place in seq}
    for k, n in Counter(map(id, itertools.chain.from_iterable(out))).items():
        fs, es, _ = held[k]
        for s in itertools.chain(fs, *es):
            met[s] += n
    return out, met


def train_punctuated(texts: list[str], transitions: bool = True) -> Chain:
    """The chain of punctuated text, from the sure places of the texts."""
    pars, tally = _paragraphs(texts), Tally()
    tally.add(pars)
    chain = Chain(tally.settled(), transitions)
    return chain.fit_slots(_marked(chain, pars)[0])


def _around(run: str, i: int) -> list[str]:
    """Letters before and after position ``i`` of a stripped run."""
    a, b = "▸" * (6 - i) + run[max(0, i - 6) : i], run[i : i + 6] + "◂" * (i + 6 - len(run))
    return ["bias", *(f"a{k}{a[-k:]}" for k in (1, 2, 3, 4, 6)), *(f"b{k}{b[:k]}" for k in (1, 2, 3, 4, 6)), f"ab{a[-2:]}|{b[:2]}"]


#: Features of ``_around``: name, letters before and after the place, and whether a bar parts them.
_KINDS = [*((f"a{k}", k, 0, False) for k in (1, 2, 3, 4, 6)), *((f"b{k}", 0, k, False) for k in (1, 2, 3, 4, 6)), ("ab", 2, 2, True)]


@functools.cache
def _crc_steps():
    """What a byte of zeros makes of each low byte of a CRC-32."""
    import numpy as np

    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


def _crc_shifted(values, most: int) -> list:
    """Low 16 bits of CRC-32 states after 0 to ``most`` bytes of zeros."""
    steps, out = _crc_steps(), []
    for _ in range(most + 1):
        out.append((values & 0xFFFF).astype("uint16"))
        values = steps[values & 255] ^ (values >> 8)
    return out


def _framed(runs: list[str]):
    """Code points of the runs, each with six marks more on either side, and where each begins."""
    import numpy as np

    codes = np.frombuffer("".join(f"▸▸▸▸▸▸{run}◂◂◂◂◂◂" for run in runs).encode("utf-32-le"), np.uint32)
    return codes, np.cumsum([6, *(len(run) + 12 for run in runs)])[:-1]


def _dense(codes):
    """Which code points are letters of dense scripts."""
    import numpy as np

    return np.logical_or.reduce([(codes >= a) & (codes <= b) for a, b in _DENSE_RANGES])


def _around_slots(codes, at):
    """Slots of ``_around`` for the places ``at`` of framed runs.

    A CRC is linear: a character adds what its bytes make, shifted by the number of
    bytes behind it.
    """
    import numpy as np

    letters, ids = np.unique(np.append(codes, ord("|")), return_inverse=True)
    own, bar = [chr(c).encode() for c in letters.tolist()], int(ids[-1])
    sizes = np.cumsum([0, *np.array([len(b) for b in own])[ids[:-1]]])
    table = np.concatenate(_crc_shifted(np.array([zlib.crc32(b, 0xFFFFFFFF) ^ 0xFFFFFFFF for b in own], np.uint32), 25))
    out = np.empty((len(at), len(_KINDS) + 1), np.uint16)
    out[:, 0] = _slot("bias")
    for k, (name, left, right, barred) in enumerate(_KINDS, 1):
        first = np.array(zlib.crc32(name.encode()) ^ 0xFFFFFFFF, np.uint32)
        end = sizes[at + right]
        slots = np.array(_crc_shifted(first, 25), np.uint16)[end - sizes[at - left] + barred] ^ np.uint16(0xFFFF)
        for i in range(-left, right):
            slots ^= table[(end - sizes[at + i + 1] + (barred and i < 0)) * len(own) + ids[at + i]]
        if barred:
            slots ^= table[(end - sizes[at]) * len(own) + bar]
        out[:, k] = slots
    return out


def _stripped(chain: Chain, pars: list[str]) -> tuple[list[Run], Counter]:
    """``_marked`` for the places between letters of text whose marks and blanks between letters were stripped."""
    import numpy as np

    out, (_, step), counts = [], chain.slots([], ["step"]), np.zeros(WIDTH, np.int64)
    split = (_DENSE_GAP.split(par) for par in pars if not par.isascii() and _DENSE_LETTER.search(par))
    split = (parts for parts in split if len(parts) > 1)
    while some := list(itertools.islice(split, 1000)):
        codes, begin = _framed(["".join(parts) for parts in some])
        dense, ends = _dense(codes), np.zeros(len(codes))
        for at, parts in zip(begin.tolist(), some):
            ends[[at + n for n in itertools.accumulate(map(len, parts[:-1]))]] = 1.0
        places = np.flatnonzero(dense[1:] & dense[:-1]) + 1
        slots, labels = _around_slots(codes, places), ends[places]
        counts += np.bincount(slots.ravel(), minlength=WIDTH)
        cuts = np.searchsorted(places, [*begin.tolist(), len(codes)]).tolist()
        out += [Run(slots[a:b], step, labels[a:b]) for a, b in itertools.pairwise(cuts) if b > a]
    met = Counter({s: n for s, n in enumerate(counts.tolist()) if n})
    met.update({s: sum(map(len, out)) for s in itertools.chain(*step)})
    return out, met


def train_unpunctuated(texts: list[str], transitions: bool = True) -> Chain:
    """The chain of unpunctuated scripts."""
    chain = Chain(None, transitions)
    return chain.fit_slots(_stripped(chain, _paragraphs(texts))[0], rate=3.0)


def _letter_scores(texts: list[str | None], letters: Chain) -> dict[str, list[float]]:
    """Scores of the places before each letter, for every paragraph with letters of dense scripts as it is without its gaps."""
    import numpy as np

    pars = (par for text in texts if text and not text.isascii() for par in _BREAK.split(text) if _DENSE_PAIR.search(par))
    runs = list({"".join(_DENSE_GAP.split(par)): None for par in pars})
    if not runs:
        return {}
    codes, begin = _framed(runs)
    dense, w, scores = _dense(codes), _floats(letters.weights), np.zeros(len(codes))
    places = np.flatnonzero(dense[1:] & dense[:-1]) + 1
    scores[places] = w[_around_slots(codes, places)].sum(axis=1)
    return {run: scores[at : at + len(run)].tolist() for run, at in zip(runs, begin.tolist())}


def _unmarked_ends(par: str, marked: set[int], letters: Chain, scores: dict[str, list[float]]) -> list[int]:
    """Ends between two letters of dense scripts; what the marks say is kept, and the marks are not looked at."""
    pieces, start, fixed, at, gone = [], [], {}, 0, 0
    for m in _DENSE_GAP.finditer(par):
        pieces.append(par[at : m.start()])
        start.append((at - gone, at))
        gone += m.end() - m.start()
        at = m.end()
        fixed[at - gone] = int(any(m.start() <= e <= m.end() for e in marked))
    pieces.append(par[at:])
    start.append((at - gone, at))
    own, ends, k = "".join(pieces), [], 0
    own_scores, step = scores[own], letters.edge(["step"])
    for run in _DENSE_RUN.finditer(own):
        inner = range(run.start() + 1, run.end())
        tags = letters._best(own_scores[run.start() + 1 : run.end()], itertools.repeat(step), [fixed.get(i) for i in inner])
        for i in itertools.compress(inner, tags):
            while k + 1 < len(start) and start[k + 1][0] <= i:
                k += 1
            if i not in fixed:
                ends.append(start[k][1] + i - start[k][0])
    return ends


def _marked_ends(par: str, marks: Chain) -> list[int]:
    """Ends at marks and at blanks between letters of Thai."""
    w = marks.weights.__getitem__
    found = [(end, *marks.place(context)[:2], None) for end, context in _contexts(par)]
    if gaps := _thai_gaps(par):
        found = sorted([*found, *((at, [marks.slot("thai-gap")], [], 1) for at in gaps)], key=operator.itemgetter(0))
    trans = [tuple(map(w, es[0])) if len(es) == 1 else tuple(map(sum, zip(*[map(w, e) for e in es]))) or (0.0, 0.0, 0.0) for _, _, es, _ in found]
    tags = marks._best([sum(map(w, fs)) for _, fs, _, _ in found], trans, [sure for *_, sure in found])
    return [end for (end, *_), cut in zip(found, tags) if cut]


def sentence_spans(text: str | None, marks: Chain, letters: Chain | None = None, scores: dict[str, list[float]] | None = None) -> list[tuple[int, int]]:
    """(first, last) character of each sentence, from 1; ``scores`` are those of ``_letter_scores``, where many texts share a call."""
    if not text or text.isspace():
        return []
    if letters is not None and scores is None:
        scores = _letter_scores([text], letters)
    out: list[tuple[int, int]] = []
    at = 0
    for m in [*_BREAK.finditer(text), None]:
        stop = m.start() if m else len(text)
        par = text[at:stop]
        if par and not par.isspace():
            ends = _marked_ends(par, marks)
            if letters is not None and not par.isascii() and _DENSE_PAIR.search(par):
                ends += _unmarked_ends(par, set(ends), letters, scores)
            begin = 0
            for end in [*sorted(set(ends)), len(par)]:
                body = par[begin:end]
                short = body.strip()
                if short:
                    first = begin + len(body) - len(body.lstrip())
                    out.append((at + first + 1, at + first + len(short)))
                begin = end
        at = m.end() if m else len(text)
    return out


#: Counts of ``Words``, in the order of their rows.
_COUNTS = ("tokens", "all", "large", "stopped", "starts", "numbered")
_BESIDE, _WAITING = len(_COUNTS), len(_COUNTS) + 1


def corpus_words(rows: DataFrame, text_col: str) -> Words:
    """The counts of all texts, for every word that stands next to a mark anywhere."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            tally = Tally()
            tally.add(_paragraphs(batch.column(0).to_pylist()))
            found = [(k, w, None, n) for k, c in enumerate(_COUNTS) for w, n in getattr(tally.words, c).items() if n]
            found += [(_BESIDE, w, None, 1) for w in tally.beside]
            found += [(_WAITING, a, b, n) for (a, b), n in tally.waiting.items()]
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64())
            columns = list(zip(*found)) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["k", "a", "b", "n"])

    counts = rows.select(text_col).mapInArrow(count, "k int, a string, b string, n bigint").groupBy("k", "a", "b").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "sentence-counts")
    words = Words()
    beside = counts.where(F.col("k") == _BESIDE).select("a")
    for r in counts.where(F.col("k") < _BESIDE).join(beside, "a", "left_semi").collect():
        getattr(words, _COUNTS[r["k"]])[r["a"]] = r["n"]

    def everyday(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([words.free(tail) >= 3 for tail in batch.column(0).to_pylist()], pa.bool_()))

    waiting = counts.where(F.col("k") == _WAITING).select("a", "b", "n")
    for r in waiting.mapInArrow(everyday, waiting.schema).groupBy("b").agg(F.sum("n").alias("n")).collect():
        words.starts[r["b"]] = words.starts.get(r["b"], 0) + r["n"]
    return words


def models(docs: DataFrame, id_col: str, text_col: str, block_docs: int = BLOCK_DOCS) -> tuple[Chain, Chain]:
    """Both chains, fitted on all documents; blocks are made by the hash of the id, so that tasks do not matter."""
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    words = corpus_words(rows, "t")
    blocks = max(1, math.ceil(rows.count() / block_docs))

    def fit(group):
        import pyarrow as pa

        pars = _paragraphs(group.sort_by([("id", "ascending"), ("t", "ascending")]).column("t").to_pylist())
        out = []
        for which, chain, make, rate in ((0, Chain(words), _marked, 1.5), (1, Chain(), _stripped, 3.0)):
            sequences, met = make(chain, pars)
            chain.fit_slots(sequences, rate=rate)
            out += [(which, s, chain.weights[s] * n, n) for s, n in met.items() if n]
            del sequences
        columns = list(zip(*out)) if out else [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.int64()))], names=["which", "slot", "w", "n"])

    placed = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    fitted = placed.groupBy("block").applyInArrow(fit, "which int, slot int, w double, n bigint").groupBy("which", "slot").agg((F.sum("w") / F.sum("n")).alias("w"))
    chains = Chain(words), Chain()
    for r in fitted.collect():
        chains[r["which"]].weights[r["slot"]] = r["w"]
    return chains


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fitted: tuple[Chain, Chain] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(id_col, start_pos, end_pos) of each sentence of each row, in order of position."""
    marks, letters = fitted or models(docs, id_col, text_col, block_docs)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, first, last = [], [], []
            texts = enumerate(batch.column(1).to_pylist())
            while some := list(itertools.islice(texts, 200)):
                scores = _letter_scores([text for _, text in some], letters)
                for i, text in some:
                    for a, b in sentence_spans(text, marks, letters, scores):
                        rows.append(i)
                        first.append(a)
                        last.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(first, pa.int64()), pa.array(last, pa.int64())], [id_col, "start_pos", "end_pos"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start_pos bigint, end_pos bigint")
