"""Problem 5: oversized texts cut at natural boundaries, with overlap.

A text above the limit is cut at the coarsest kind of boundary that suffices for
it: blank lines, else sentence ends (a line end counts as one), else anywhere.
Lexical cohesion chooses among them: every boundary gets the cosine similarity of
the word blocks before and after it, its depth is how far the similarity rises
again on either side, and each piece ends at the deepest valley within the window
of sizes that are allowed. Pieces are cut over new text only; then each takes
over the last ``overlap`` characters of the one before, from a word on, as far as
the limit allows.

A text is handled by the task that reads it, in time linear in its length.

Defined results: null texts and texts within the limit give no piece in
``pieces`` and no row in ``kinds``; repeated rows each give their own pieces; a
single sentence above the limit is cut hard, at a blank if there is one.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from quaystone.llm import cues
from quaystone.llm.words import RUN

LIMIT = 6_000
OVERLAP = 200
#: Words on either side of a boundary that are compared.
BLOCK_WORDS = 120
_BLANK = re.compile(r"\n(?:[^\S\n]*\n)+")


def stretches(text: str) -> list[tuple[int, int]]:
    """(first, after) of what lies between blank lines."""
    out, at = [], 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at:
            out.append((at, end))
        at = m.end() if m else at
    return out


def sentence_ends(text: str, first: int, after: int) -> list[int]:
    """Ends of the sentences of a stretch; a line end is one."""
    ends, at = [], first
    for line in text[first:after].split("\n"):
        if line.strip():
            ends += [at + e for e in cues.ends(line) if e < len(line)]
            ends.append(at + len(line))
        at += len(line) + 1
    return ends


def _size(text: str, a: int, b: int) -> int:
    return len(text[a:b].strip())


def boundary_kind(text: str, limit: int = LIMIT) -> str:
    """The coarsest kind of boundary that suffices: paragraph, sentence or hard."""
    kind = "paragraph"
    for a, b in stretches(text):
        if _size(text, a, b) > limit:
            kind = "sentence"
            at = a
            for e in sentence_ends(text, a, b):
                if _size(text, at, e) > limit:
                    return "hard"
                at = e
    return kind


KINDS = ("paragraph", "sentence", "hard")


def _cuts(text: str, limit: int) -> tuple[list[int], list[int]]:
    """Allowed ends of pieces in order, the end of the text last, and how fine each is (a place in ``KINDS``).

    A stretch within the limit is only cut after it, a longer one after its sentences too.
    """
    cuts: list[int] = []
    fine: list[int] = []
    for a, b in stretches(text):
        end = a + len(text[a:b].rstrip())
        if _size(text, a, b) > limit:
            inner = [e for e in sentence_ends(text, a, b) if e < end]
            cuts += inner
            fine += [1] * len(inner)
        if end > a:
            cuts.append(end)
            fine.append(0)
    if not cuts or cuts[-1] != len(text):
        cuts.append(len(text))
        fine.append(0)
    return cuts, fine


def cohesion(text: str, cuts: list[int], block: int = BLOCK_WORDS) -> list[float]:
    """Similarity across each cut: cosine of the ``block`` words before and after it."""
    words, starts = [], []
    for m in RUN.finditer(text):
        words.append(m.group().lower())
        starts.append(m.start())
    left: Counter = Counter()
    right: Counter = Counter(words[:block])
    dot = sum(left[w] * c for w, c in right.items())
    norms = [0.0, float(sum(c * c for c in right.values()))]
    out, at = [], 0

    def change(side: int, w: str, by: int) -> None:
        nonlocal dot
        own, other = (left, right) if side == 0 else (right, left)
        norms[side] += by * (2 * own[w] + by)
        dot += by * other[w]
        own[w] += by

    for cut in cuts:
        to = bisect.bisect_left(starts, cut)
        while at < to:
            change(1, words[at], -1)
            if at + block < len(words):
                change(1, words[at + block], 1)
            change(0, words[at], 1)
            if at - block >= 0:
                change(0, words[at - block], -1)
            at += 1
        out.append(dot / math.sqrt(norms[0] * norms[1]) if norms[0] > 0 and norms[1] > 0 else 0.0)
    return out


def depths(similarity: list[float]) -> list[float]:
    """How far the similarity climbs on both sides of each boundary before it falls again."""
    n = len(similarity)
    left, right = list(similarity), list(similarity)
    for i in range(1, n):
        left[i] = max(similarity[i], left[i - 1]) if similarity[i - 1] >= similarity[i] else similarity[i]
    for i in range(n - 2, -1, -1):
        right[i] = max(similarity[i], right[i + 1]) if similarity[i + 1] >= similarity[i] else similarity[i]
    return [left[i] + right[i] - 2 * s for i, s in enumerate(similarity)]


def parted(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str | None, list[tuple[int, int, int]]]:
    """The finest kind of boundary that a cut was made at, None if the text is within the limit, and its pieces as of ``cut``."""
    if len(text) <= limit:
        return None, [(0, 0, len(text))]
    cuts, fine = _cuts(text, limit)
    depth = depths(cohesion(text, cuts))
    pieces, at, k, finest = [], 0, 0, 0
    while at < len(text):
        # room is kept for the overlap unless no boundary allows it; at last blanks before the piece are left out
        for most, skip in ((limit - overlap, False), (limit, False), (limit, True)):
            if skip:
                at += len(text[at:]) - len(text[at:].lstrip()) if pieces or cuts[k] - at > limit else 0
            j = bisect.bisect_right(cuts, at + most) - 1
            if j >= k and cuts[j] > at:
                break
        if at >= len(text):
            break
        if j < k or cuts[j] <= at:
            end = at + limit - overlap
            blank = text.rfind(" ", at + (limit - overlap) // 2, end)
            end = min(len(text), blank + 1 if blank > 0 else end)
            finest = 2
        else:
            low = bisect.bisect_left(cuts, at + most // 2, k, j + 1)
            best = j if cuts[j] == len(text) and cuts[j] - at <= most else max(range(min(low, j), j + 1), key=lambda i: (-fine[i], depth[i], i))
            end = cuts[best]
            finest = max(finest, fine[best])
        k = bisect.bisect_right(cuts, end)
        back = min(overlap, limit - (end - at), at) if pieces else 0
        begin = at - back
        if back:
            m = re.compile(r"\s+").search(text, begin, at)
            begin = begin if begin == 0 or text[begin - 1].isspace() else m.end() if m else begin
        pieces.append((begin, at, end))
        at = end
    return KINDS[finest], pieces


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start with overlap, start of new text, end) of each piece, in order; all of the text but blanks between two pieces is in one."""
    return parted(text, limit, overlap)[1]


def cut_at(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[str | None]:
    """The kind of boundary each text was cut at, from the pass that cuts it."""
    return [parted(t, limit, overlap)[0] for t in texts]


def kinds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, cut_at) of each text above the limit, all of which are cut as for ``pieces``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut_at(batch.column(1).to_pylist(), limit, overlap), pa.string())], [id_col, "cut_at"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.where(F.length(text_col) > limit).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, cut_at string")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, piece, start_pos, new_pos, end_pos, text) of each piece of each text above the limit, positions from 1."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows: list[tuple] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                rows += [(i, n + 1, a + 1, b + 1, e, t[a:e]) for n, (a, b, e) in enumerate(cut(t, limit, overlap))]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array(cols[5], pa.string())],
                [id_col, "piece", "start_pos", "new_pos", "end_pos", "text"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.where(F.length(text_col) > limit).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece bigint, start_pos bigint, new_pos bigint, end_pos bigint, text string")
