"""Phrase, concept, citation and claim operators on native columns."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaystone.functions import text as T
from quaystone.session import materialise


def _words(c) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def phrase_hit(text, phrase) -> Column:
    """The phrase is in the text, or enough of its words are: 60 %, or from 12 words on 35 % between 4 and 8."""
    ws = F.array_distinct(_words(phrase))
    n = F.size(ws)
    hits = F.size(F.array_intersect(ws, _words(text)))
    need = F.when(n >= 12, F.greatest(F.lit(4), F.least(F.lit(8), F.bround(n * F.lit(0.35)).cast("int")))).otherwise(F.greatest(F.lit(1), F.bround(n * F.lit(0.6)).cast("int")))
    return F.coalesce((n > 0) & (F.contains(F.lower(text), F.lower(phrase)) | (hits >= need)), F.lit(False))


def unnegated(text, phrase, before: int = 90, after: int = 120, negations: str = r"\b(not|no|never|cannot|without)\b") -> Column:
    """Some occurrence of the phrase has no negation in the characters around it."""
    low = F.lower(F.coalesce(text, F.lit("")))
    key = F.lower(F.coalesce(phrase, F.lit("")))
    parts = F.split(low, F.concat(F.lit(r"\Q"), key, F.lit(r"\E")), -1)
    left = lambda i: F.right(F.element_at(parts, i), F.lit(before))
    clear = lambda i: ~F.rlike(F.concat(left(i), F.lit(" | "), F.substring(F.element_at(parts, i + 1), 1, after)), F.lit(negations))
    return F.when((key == "") | (F.size(parts) < 2), F.lit(False)).otherwise(F.exists(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), clear))


def concepts(rows: DataFrame, text_col: str, patterns: dict[str, str]) -> DataFrame:
    """Adds ``concepts``: names of the patterns the text matches, in the order given; one projection, no join."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    return rows.withColumn("concepts", F.filter(F.array(*[F.when(F.rlike(low, F.lit(p)), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull()))


def coverage(required, found) -> Column:
    """Share of the required names that were found, 1 if none is required."""
    return F.when(F.size(required) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(required, found)) / F.size(required))


def citations(text) -> Column:
    """Distinct "kind number" citations of sections, articles and paragraphs, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\b(?:section|paragraph|item|article) [0-9]+(?:\.[0-9]+)?"), F.lit(0)))


def claims(rows: DataFrame, id_col: str, text_col: str, most: int = 6, least_words: int = 5) -> DataFrame:
    """(id, claim_no, claim): sentences cut at "; " and " and ", those of enough words, with a full stop, the first ``most``."""
    marked = F.regexp_replace(T.squeeze(F.col(text_col)), r"([.!?]) +([A-Z])", "$1\u0001$2")
    parts = F.split(F.regexp_replace(marked, "; | and ", "\u0001"), "\u0001")
    tidy = F.transform(parts, lambda p: F.concat(F.regexp_replace(F.trim(p), "[.!?;]+$", ""), F.lit(".")))
    kept = F.slice(F.filter(tidy, lambda p: F.size(F.split(p, " ")) >= least_words), 1, most)
    return rows.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(kept).alias("pos", "claim")).select(id_col, (F.col("pos") + 1).alias("claim_no"), "claim")


def first_rewrite(c, rules: list[tuple[str, str]]) -> Column:
    """The text with the first rule that applies, once; null if none does."""
    out = []
    for pattern, to in rules:
        head = F.regexp_extract(c, f"^(.*?)({pattern})(.*)$", 1)
        tail = F.regexp_extract(c, f"^(.*?)({pattern})(.*)$", 3)
        out.append(F.when(F.rlike(c, F.lit(pattern)), F.concat(head, F.lit(to), tail)))
    return F.coalesce(*out)


def token_f1(a, b) -> Column:
    """F1 of the distinct words of two texts; 0 if they share none."""
    x, y = F.array_distinct(_words(a)), F.array_distinct(_words(b))
    shared = F.size(F.array_intersect(x, y))
    return F.when(shared == 0, F.lit(0.0)).otherwise(2.0 * shared / (F.size(x) + F.size(y)))


#: Words of the texts that are sent to the tasks at once, and old texts that a task scores at once.
BLOCK_WORDS, OLD_ROWS = 2_000_000, 65_536


def most_similar(rows: DataFrame, old: DataFrame, id_col: str, text_col: str, old_id: str, old_text: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, old_id, similarity): the most similar old text by Jaccard, over pairs that share a word.

    The texts go in blocks of about ``block_words`` words to the tasks that scan the
    old ones, each of which passes on its best one a text: no pair leaves its task,
    however common the word it shares.
    """
    side = lambda df, i, t, n: df.where(F.col(t).isNotNull()).select(F.col(i).alias(n), F.array_distinct(_words(F.col(t))).alias("ws")).where(F.size("ws") > 0)
    a, b = side(rows, id_col, text_col, "a"), side(old, old_id, old_text, "b")
    blocks = max(1, math.ceil((a.agg(F.sum(F.size("ws"))).first()[0] or 0) / block_words))
    block = F.pmod(F.xxhash64("ws"), F.lit(blocks))
    scored = functools.reduce(DataFrame.union, [_scored(a.where(block == k), b) for k in range(blocks)])
    best = scored.groupBy("a").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "b")).alias("x"))
    return best.select(F.col("a").alias(id_col), F.col("x.b").alias("old_id"), (-F.col("x.s")).alias("similarity"))


def _scored(asked: DataFrame, old: DataFrame) -> DataFrame:
    """(a, b, similarity): for each group of old texts of a task, the best of them for each text that is asked for."""
    held = old.sparkSession.sparkContext.broadcast(asked.toArrow())

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = held.value
        n = table.num_rows
        lists = pa.concat_arrays(table.column("ws").chunks) if n else pa.array([], pa.list_(pa.string()))
        flat = lists.flatten().dictionary_encode()
        codes, sizes = flat.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(flat.dictionary)))])
        holders = np.repeat(np.arange(n), sizes)[np.argsort(codes, kind="stable")]
        # the 64 most common words are one bit each, so that only the others are counted text by text
        common = np.argsort(-np.diff(starts), kind="stable")[:64]
        bit_of = np.zeros(len(flat.dictionary), np.uint64)
        bit_of[common] = np.uint64(1) << np.arange(len(common), dtype=np.uint64)
        bits = np.zeros(n, np.uint64)
        np.bitwise_or.at(bits, np.repeat(np.arange(n), sizes), bit_of[codes])

        def best_of(part):
            ids, words = part.column(0), part.column(1)
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
            lengths = pc.list_value_length(words).to_numpy().astype(np.int64)
            ends = np.cumsum(lengths)
            own = pc.fill_null(pc.index_in(words.flatten(), flat.dictionary), -1).to_numpy()
            bit = np.where(own < 0, np.uint64(0), bit_of[own])
            shown = np.zeros(len(ids), np.uint64)
            np.bitwise_or.at(shown, np.repeat(np.arange(len(ids)), lengths), bit)
            rare = (own >= 0) & (bit == 0)
            best, who, held_rank, last = np.full(n, 1e-300), np.full(n, -1), np.zeros(n, np.int64), None
            for i in np.argsort(shown, kind="stable"):
                if last is None or shown[i] != last:
                    last, base = shown[i], np.bitwise_count(bits & shown[i]).astype(np.int64)
                at = slice(ends[i] - lengths[i], ends[i])
                met = [holders[starts[w] : starts[w + 1]] for w in own[at][rare[at]]]
                shared = base + np.bincount(np.concatenate(met), minlength=n) if met else base
                similarity = shared / (sizes + lengths[i] - shared)
                over = np.flatnonzero(similarity >= best)
                over = over[(similarity[over] > best[over]) | (rank[i] < held_rank[over])]
                best[over], who[over], held_rank[over] = similarity[over], i, rank[i]
            kept = np.flatnonzero(who >= 0)
            found = pa.table({"a": table.column("a").take(pa.array(kept)), "b": ids.take(pa.array(who[kept])), "similarity": pa.array(best[kept])})
            yield from found.combine_chunks().to_batches(max_chunksize=10_000)

        waiting, many = [], 0
        for batch in batches if n else ():
            waiting.append(batch)
            many += batch.num_rows
            if many >= OLD_ROWS:
                yield from best_of(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
                waiting, many = [], 0
        if many:
            yield from best_of(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "a"), (old, "b"))]
    return old.mapInArrow(run, f"a {kinds[0]}, b {kinds[1]}, similarity double")


#: Rows of the sample that a row without a partner in its ring may draw from.
POOL_ROWS = 64


def _witnesses(placed: DataFrame, id_col: str, different: list[str]) -> list:
    """Few rows (16 for three columns) among which each row finds one that differs in every column, if any row does.

    Rows that share values with a witness are asked for another one that differs from
    those values, until all columns are settled: a tree as deep as there are columns.
    """
    nodes, found = {frozenset(): {}}, {}
    while nodes:
        free = [F.when(_differs(lambda c, shared=shared: F.lit(shared[c]), list(shared)), F.struct("_k", id_col, *different)) for shared in nodes.values()]
        picks = placed.agg(*[F.min(c).alias(f"w{i}") for i, c in enumerate(free)]).first()
        deeper = [shared | {c: pick[c]} for shared, pick in zip(nodes.values(), picks) if pick is not None for c in different if c not in shared]
        found |= {pick[id_col]: pick for pick in picks if pick is not None}
        nodes = {frozenset(d.items()): d for d in deeper}
    return list(found.values())


def _differs(other, different: list[str]) -> Column:
    out = F.lit(True)
    for c in different:
        out = out & (F.col(c) != other(c))
    return out


def ring_partners(rows: DataFrame, id_col: str, different: list[str], seed: int = 42, buckets: int = 64) -> DataFrame:
    """(id, partner): a row that differs in every ``different`` column, for each row that has one.

    A stand-in for random unrelated pairs without a theta join: rows are ordered
    within hash buckets, each a ring, and each looks at its next eight. What finds
    none there draws from a sample of rows and the witnesses, which are enough for
    every row with any partner. A null in a column differs from nothing.
    """
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")), 256)
    placed = rows.select(id_col, *different).dropna(subset=different).withColumn("_k", key).withColumn("_b", F.pmod(F.crc32("_k"), F.lit(buckets)))
    placed = materialise(placed, "partners")
    named = placed.where(F.col(id_col).isNotNull())
    chosen = {r[id_col]: r for r in [*named.orderBy("_k").limit(POOL_ROWS).collect(), *_witnesses(named, id_col, different)]}
    fields = placed.select(id_col, *different).schema
    pool = rows.sparkSession.createDataFrame([tuple(r[f] for f in fields.names) for r in chosen.values()], fields).agg(F.collect_list(F.struct(*fields.names)).alias("_pool"))

    w = Window.partitionBy("_b").orderBy("_k")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct(id_col, *different)
    ring = placed.withColumn("_n", F.row_number().over(w) - F.count("*").over(Window.partitionBy("_b")))
    ring = ring.withColumns({f"_next{s}": F.lead(row, s).over(w) for s in range(1, 9)} | {f"_first{s}": F.nth_value(row, s).over(whole) for s in range(1, 9)})
    first = F.array(*[F.col(f"_first{s}") for s in range(1, 9)])
    tries = []
    for step in range(1, 9):
        other = F.when(F.col("_n") + step <= 0, F.col(f"_next{step}")).otherwise(F.get(first, F.col("_n") + step - 1))
        tries.append(F.when(_differs(lambda c: other[c], different), other[id_col]))
    apart = F.filter("_pool", lambda o: _differs(lambda c: o[c], different))
    drawn = F.array_min(F.transform(apart, lambda o: F.struct(F.xxhash64(F.lit(seed), F.col(id_col), o[id_col]).alias("h"), o[id_col].alias("partner"))))["partner"]
    return ring.crossJoin(F.broadcast(pool)).select(id_col, F.coalesce(*tries, drawn).alias("partner")).where("partner is not null")


def decided(rows: DataFrame, by: str, probability: str, cut: float = 0.5) -> DataFrame:
    """(by, any, majority, all, mean, top_half): how a group's verdict depends on the way its contexts are combined."""
    hit = (F.col(probability) >= cut).cast("int")
    out = rows.where(F.col(probability).isNotNull()).groupBy(by).agg(F.max(hit).alias("any"), (F.avg(hit.cast("double")) > 0.5).cast("int").alias("majority"), F.min(hit).alias("all"), F.avg(probability).alias("mean"), F.sort_array(F.collect_list(probability), asc=False).alias("_p"))
    half = F.ceil(F.size("_p") / 2).cast("int")
    return out.withColumn("top_half", F.aggregate(F.slice("_p", F.lit(1), half), F.lit(0.0), lambda a, x: a + x) / half).drop("_p")
