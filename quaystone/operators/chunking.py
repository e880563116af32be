"""Chunkers: fixed, boundary-aware, packed segments, sections, sliding passages."""

from __future__ import annotations

import bisect
import itertools
import re

from pyspark.sql import DataFrame, Window, functions as F

from quaystone.functions import text as T


def parts(docs: DataFrame, separator: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part_no, part): parts between separators, numbered over all of them, blank ones dropped."""
    spread = docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, separator, -1)).alias("pos", "part"))
    return spread.select(id_col, (F.col("pos") + 1).alias("part_no"), T.strip("part").alias("part")).where(F.col("part") != "")


def fixed(docs: DataFrame, size: int = 512, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, total_chunks, chunk): slices of ``size`` characters, blank ones dropped before counting."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_col) - 1, F.lit(0)), F.lit(size - overlap))
    slices = F.filter(F.transform(starts, lambda s: F.substring(F.col(text_col), s + 1, F.lit(size))), lambda c: T.strip(c) != "")
    kept = docs.where(F.length(text_col) > 0).select(id_col, slices.alias("chunks"))
    return kept.select(id_col, F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "chunk")).select(id_col, "chunk_index", "total_chunks", "chunk")


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sent_no, sentence): cut at blanks between a closing mark and a Latin or Cyrillic capital."""
    spread = docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, r"(?<=[.!?])[ \t\n\r\x0B\f]+(?=[A-ZА-Я])")).alias("pos", "s"))
    return spread.select(id_col, (F.col("pos") + 1).alias("sent_no"), T.strip("s").alias("sentence")).where("sentence <> ''")


def passages(sents: DataFrame, width: int = 3, low: int = 220, high: int = 900, key_chars: int = 240, per_doc: int = 18, id_col: str = "doc_id") -> DataFrame:
    """(id, sent_no, passage): runs of ``width`` sentences within the bounds, first of equal beginnings, ``per_doc`` a document."""
    w = Window.partitionBy(id_col).orderBy("sent_no")
    run = F.concat_ws(" ", "sentence", *[F.lead("sentence", k).over(w) for k in range(1, width)])
    ok = sents.select(id_col, "sent_no", run.alias("passage"), F.lead("sent_no", width - 1).over(w).alias("_last")).where(F.col("_last").isNotNull() & F.length("passage").between(low, high))
    first = Window.partitionBy(id_col, F.substring(F.lower("passage"), 1, key_chars)).orderBy("sent_no")
    kept = ok.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_doc).select(id_col, "sent_no", "passage")


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", page: str | None = None) -> DataFrame:
    """(id, block_no, heading, block): paragraphs joined from their lines under the last heading seen.

    Gaps and islands per document: blank lines and headings close a block. Lines
    that match ``page``, such as ``^\\[Page [0-9]+\\]$``, close one too and set the
    page of those that follow, a column that is there only then.
    """
    lines = docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line")).withColumn("line", T.squeeze("line"))
    w = Window.partitionBy(id_col).orderBy("pos")
    kind = F.when(F.col("line") == "", "blank")
    kind = (kind.when(F.col("line").rlike(page), "page") if page else kind).when(T.is_heading(F.col("line")), "heading").otherwise("text")
    marked = lines.withColumn("kind", kind)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("heading", F.last(F.when(F.col("kind") == "heading", F.col("line")), ignorenulls=True).over(so_far))
    marked = marked.withColumn("island", F.sum(F.when(F.col("kind") != "text", 1).otherwise(0)).over(so_far))
    held = [F.last(F.when(F.col("kind") == "page", F.regexp_extract("line", "([0-9]+)[^0-9]*$", 1).cast("int")), ignorenulls=True).over(so_far).alias("page")] if page else []
    marked = marked.select("*", *held)
    kept = [F.max("page").alias("page")] if page else []
    blocks = marked.where("kind = 'text'").groupBy(id_col, "island").agg(F.min("pos").alias("first"), *kept, F.max("heading").alias("heading"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    joined = F.array_join(F.transform("ls", lambda x: x["line"]), " ")
    return blocks.select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("first")).alias("block_no"), *(["page"] if page else []), "heading", joined.alias("block"))


def backing_off(text: str, size: int, overlap: int, least: float = 0.6) -> list[str]:
    """Slices that end at a blank line, sentence or clause if one lies beyond ``least`` of the size.

    All places a slice may end at are found once; each slice then looks up the last
    one within its reach.
    """
    ends = [m.start() + 1 for m in re.finditer(r"(?=\n\n|\. |; )", text)]
    spans = [(0, 0)]
    while spans[-1][1] < len(text):
        first, last = spans[-1]
        # the next slice starts ``overlap`` before the end of this one, and never where this one did
        start = max(last - overlap, first + 1) if len(spans) > 1 else 0
        stop = min(start + size, len(text))
        reach = ends[: bisect.bisect_right(ends, stop - 1)][-1:] if stop < len(text) else []
        spans.append((start, reach[0] if reach and reach[0] - start > int(size * least) + 1 else stop))
    return [piece for a, b in spans if (piece := text[a:b].strip())]


def packed(segments: list[str], size: int, overlap: int) -> list[str]:
    """Segments joined by blank lines up to ``size``; the last ones that fit ``overlap`` open the next chunk.

    Works on running lengths: a chunk is a range of segments, so both its end and
    the start of the next one are binary searches.
    """
    upto = list(itertools.accumulate((len(s) + 2 for s in segments), initial=0))  # segments [i, j) joined: upto[j] - upto[i] - 2
    out, first, taken = [], 0, 0
    while taken < len(segments):
        taken = max(taken + 1, bisect.bisect_right(upto, upto[first] + size + 2) - 1)
        out.append("\n\n".join(segments[first:taken]))
        first = max(first, min(taken - 1, bisect.bisect_left(upto, upto[taken] - 2 - overlap))) if overlap > 0 else taken
    return out


def folded(docs: DataFrame, cut, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, chunk) by a sequential chunker ``cut(text) -> list``, one document at a time."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(i, k, c) for i, t in enumerate(batch.column(1).to_pylist()) if t for k, c in enumerate(cut(t))]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], [id_col, "chunk_index", "chunk"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, chunk_index int, chunk string")


def boundary_aware(docs: DataFrame, size: int = 1200, overlap: int = 200, **cols) -> DataFrame:
    return folded(docs, lambda t: backing_off(t, size, overlap), **cols)


def segments(docs: DataFrame, size: int = 1200, overlap: int = 200, **cols) -> DataFrame:
    """Paragraphs packed with whole-segment overlap."""
    return folded(docs, lambda t: packed([p for p in ("\n".join(x.strip() for x in q.split("\n") if x.strip()) for q in re.split(r"\n[^\S\n]*\n", t)) if p], size, overlap), **cols)


def by_strategy(docs: DataFrame, strategy: str, size: int = 1200, overlap: int = 200, **cols) -> DataFrame:
    """Chunks by a named strategy: ``fixed`` or ``structure_aware``, each also ``_small``: half the size, at least 400, a quarter of it overlapping at most."""
    kind, _, small = strategy.partition("_small")
    if strategy.endswith("_small"):
        size = max(400, size // 2)
        overlap = min(overlap, size // 4)
    if kind not in ("fixed", "structure_aware") or small:
        raise ValueError(f"unknown strategy {strategy}")
    return (fixed if kind == "fixed" else segments)(docs, size, overlap, **cols)


def _sentence_list(text: str) -> list[str]:
    return [x for x in re.split(r"(?<=[.!?])\s+(?=[A-ZА-Я])", text.strip()) if x]


def within(text: str, most: int) -> list[str]:
    """Sentences packed greedily up to ``most`` characters; a longer sentence is sliced."""
    out, now = [], ""
    for s in _sentence_list(text):
        if now and len(now) + 1 + len(s) > most:
            out.append(now)
            now = ""
        while len(s) > most:
            out.append(s[:most])
            s = s[most:]
        now = f"{now} {s}" if now else s
    return out + ([now] if now else [])


def tail(text: str, overlap: int) -> str:
    """Whole sentences from the end of a text that fit ``overlap``; nothing below min(40, overlap)."""
    if len(text) <= overlap:
        return text
    kept: list[str] = []
    for s in reversed(_sentence_list(text[-3 * overlap :])):
        if sum(map(len, kept)) + len(kept) + len(s) > overlap:
            break
        kept.insert(0, s)
    joined = " ".join(kept)
    return joined if len(joined) >= min(40, overlap) else ""


def by_section(blocks: DataFrame, most: int = 1200, overlap: int = 150, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk_index, heading, chunk) from the blocks of ``sections``: packed up to ``most`` characters within a document.

    A chunk opens with the last sentences of the one before and has the heading of
    its first block. One document's blocks are folded in one task.
    """
    ordered = blocks.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("block_no", "heading", "block"))).alias("bs"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i, bs in enumerate(batch.column(1).to_pylist()):
                now, heading, k = [], None, 0
                for b in bs:
                    for part in within(b["block"], most):
                        if now and sum(map(len, now)) + len(part) > most:
                            whole = "\n\n".join(now)
                            rows.append((i, k, heading, whole))
                            k += 1
                            over = tail(whole, overlap)
                            now, heading = ([over] if over else []), b["heading"]
                        elif not now:
                            heading = b["heading"]
                        now.append(part)
                if now:
                    rows.append((i, k, heading, "\n\n".join(now)))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], [id_col, "chunk_index", "heading", "chunk"]
            )

    kind = blocks.schema[id_col].dataType.simpleString()
    return ordered.mapInArrow(run, f"`{id_col}` {kind}, chunk_index int, heading string, chunk string")


def hashed_vector(text: str, size: int = 256):
    """A bag of hashed words, unit length: a stand-in where no embedding model is plugged in."""
    import zlib

    import numpy as np

    v = np.zeros(size)
    for w in re.findall(r"[^\W_]+", text.lower()):
        v[zlib.crc32(w.encode()) % size] += 1.0
    n = float(np.linalg.norm(v))
    return v / n if n else v


def grouped(sentences: list[str], vectors, threshold: float = 0.7, least: int = 100, most: int = 1000) -> list[str]:
    """A chunk ends where neighbours are less alike than ``threshold`` or it would exceed ``most``; small ones join the one before."""
    out, now = [], []
    for i, s in enumerate(sentences):
        if now and (float(vectors[i - 1] @ vectors[i]) < threshold or sum(map(len, now)) + len(now) + len(s) > most):
            out.append(" ".join(now))
            now = []
        now.append(s)
    if now:
        out.append(" ".join(now))
    merged: list[str] = []
    for c in out:
        if merged and len(c) < least and len(merged[-1]) + 1 + len(c) <= most:
            merged[-1] += " " + c
        else:
            merged.append(c)
    return merged


def semantic(docs: DataFrame, embed=hashed_vector, threshold: float = 0.2, least: int = 100, most: int = 1000, **cols) -> DataFrame:
    """Chunks of neighbouring sentences that are alike; ``embed(text) -> unit vector`` runs in the tasks."""

    def cut(text: str) -> list[str]:
        ss = _sentence_list(text)
        return [text] if len(ss) < 2 else grouped(ss, [embed(s) for s in ss], threshold, least, most)

    return folded(docs, cut, **cols)


def paragraphs(docs: DataFrame, most: int = 900, least: int = 200, **cols) -> DataFrame:
    """Paragraphs packed up to ``most`` characters, chunks below ``least`` dropped, longer paragraphs by sentences."""

    def cut(text: str) -> list[str]:
        parts = [x for p in text.split("\n\n") if p.strip() for x in within(p, most)]
        return [c for c in packed(parts, most, 0) if len(c) >= least]

    return folded(docs, cut, **cols)


def numbered_paragraphs(docs: DataFrame, low: int = 220, high: int = 1300, window: int = 380, most_numbers: int = 18, **cols) -> DataFrame:
    """Paragraphs for citation: short ones and those full of numbers dropped, long ones cut into windows of sentences."""

    def cut(text: str) -> list[str]:
        out = []
        for p in re.split(r"\n[^\S\n]*\n", text):
            p = " ".join(p.split())
            if len(p) < low or len(re.findall(r"\d+(?:[.,]\d+)?", p)) >= most_numbers:
                continue
            if len(p) <= high:
                out.append(p)
                continue
            now = ""
            for s in _sentence_list(p):
                now = f"{now} {s}" if now else s
                if len(now) >= window:
                    out.append(now[:high])
                    now = ""
            if len(now) >= low:
                out.append(now[:high])
        return out

    return folded(docs, cut, **cols)


def clean(c):
    """Repairs of extracted page text: odd blanks, hyphens at line ends, soft line breaks, bare page numbers."""
    c = F.regexp_replace(F.regexp_replace(c, " ", " "), "[​­]", "")
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[ \t]+", " ")
    c = F.regexp_replace(c, r"([^\n])-\n(\w)", "$1$2")
    c = F.regexp_replace(c, r"(?m)^ *(?:[0-9]+|(?i:page [0-9]+)|(?i:confidential|draft)) *$", "")
    c = F.regexp_replace(c, r"([^.!?:;\n]) ?\n ?([a-z0-9(])", "$1 $2")
    return T.strip(F.regexp_replace(F.regexp_replace(c, r" *\n *", "\n"), r"\n{3,}", "\n\n"))
