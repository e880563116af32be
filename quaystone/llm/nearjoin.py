"""Problem 3: near-duplicate records by an exact set-similarity self-join.

Equal texts collapse to one class, equal word sets to one set. Sets are joined by
universe partitioning: words are hashed into m segments; if two sets differ in at
most H words and segment budgets d_i in {skip, equal, one deletion} satisfy
sum(d_i + 1) > H, some segment differs by at most d_i. The smaller set of a pair
is indexed in the scheme of its size band, with each segment subset and its
one-deletion neighbourhood; the larger set probes the schemes of the bands down
to t times its size. Budgets are allocated per probe from counted index
frequencies: what the pigeonhole leaves free is taken off the costliest segments,
which keeps the words of a template from meeting in one list.

Each row of the index and of the probes carries a parity sketch of its set (every
word flips one of 128 bits). Two sets that differ in d words differ in at most d
bits, so a meeting whose sketches differ in more than H bits is no pair and is
dropped inside the join, before anything is shuffled for it. A signature that
more than ``hot`` sets share is split further: its rows are met on the signature
and one of the first words, in order of rarity, of either set, of which a pair
always shares one. What is left is verified exactly on the words.

Segments and signatures are vector operations over Arrow batches, all else is JVM
expressions.

Defined results: null texts and texts without a word have no pair; repeated rows
of an id count once; equal texts under several ids are one class and no pair;
texts with equal words but other characters are a pair of similarity 1.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

from quaystone.llm.words import words
from quaystone.session import materialise

#: Sets on one signature beyond which it is split by rare words.
HOT = 512


def bands(threshold: Fraction, largest: int, growth: Fraction = Fraction(135, 100), spare: int = 2) -> list[tuple[int, int, int]]:
    """[(lo, hi, segments)] of the size bands up to ``largest`` words."""
    out, lo = [], 1
    while lo <= largest:
        hi = max(lo, int(lo * growth) - 1)
        worst = _differences(threshold, hi, int(hi / threshold))
        out.append((lo, hi, (worst + 2) // 2 + spare))
        lo = hi + 1
    return out


def _differences(t: Fraction, a: int, b: int) -> int:
    return int((1 - t) / (1 + t) * (a + b))


def _key(part: str, what: Column) -> Column:
    """128 bits that stand for a text or a set of a part."""
    return F.unhex(F.md5(F.concat_ws("\x00", F.col(part), what)))


def classes(records: DataFrame, part_col: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, texts, sets): ids of each text, texts of each word set, and the sets.

    members (part, text_id, id); texts (part, set_id, text_id); sets (part, set_id, words, n).
    """
    rows = records.select(F.col(part_col).alias("part"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null")
    rows = materialise(rows.withColumn("text_id", _key("part", F.col("text"))), "near-rows")
    members = rows.select("part", "text_id", "id").distinct()
    texts = rows.groupBy("part", "text_id").agg(F.min("text").alias("text")).select("part", "text_id", F.array_sort(F.array_distinct(words(F.col("text")))).alias("words")).where(F.size("words") > 0)
    texts = materialise(texts.withColumn("set_id", _key("part", F.array_join("words", " "))), "near-texts")
    sets = texts.groupBy("part", "set_id").agg(F.min("words").alias("words")).withColumn("n", F.size("words"))
    return members, texts.select("part", "set_id", "text_id"), materialise(sets, "near-sets")


def _mixed(x):
    """A 64-bit finaliser over a vector of unsigned integers."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _segments(parts, bands_of, counts, hashes, table):
    """Segments of a batch of (set, band): (first, m, full, row of word, segment of word, deletion of word).

    ``full`` holds the XOR of each segment's words, from ``first`` on for each row.
    Signatures are salted with part, band, segment and kind.
    """
    import numpy as np

    ms = np.array([m for _, _, m in table], np.int64)
    m = ms[bands_of]
    first = np.concatenate(([0], np.cumsum(m)))[:-1]
    row = np.repeat(np.arange(len(m)), counts)
    at = first[row] + ((hashes >> np.uint64(7)).astype(np.int64) & 0x7FFFFFFFFFFF) % m[row]
    full = np.zeros(int(m.sum()), np.uint64)
    np.bitwise_xor.at(full, at, hashes)
    of = np.repeat(np.arange(len(m)), m)
    with np.errstate(over="ignore"):
        salt = _mixed(parts[of] + bands_of[of].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (np.arange(len(of)) - first[of]).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return first, m, of, full, salt, row, at, full[at] ^ hashes


def _signed(salt, kind: int, value):
    import numpy as np

    with np.errstate(over="ignore"):
        return _mixed(salt + np.uint64(kind) + _mixed(value)).view(np.int64)


def _batch(batch):
    """(sizes, parts, counts, hashes) of a batch with columns n, ph and hashes."""
    import numpy as np

    lists = batch.column(batch.schema.get_field_index("hashes"))
    counts = np.diff(lists.offsets.to_numpy())
    return (
        batch.column(batch.schema.get_field_index("n")).to_numpy(zero_copy_only=False).astype(np.int64),
        batch.column(batch.schema.get_field_index("ph")).to_numpy(zero_copy_only=False).view(np.uint64),
        counts,
        lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64),
    )


def _index(table):
    """(set_id, sig) of each segment subset and of its one-deletions, in the band of the set's size."""
    los = [lo for lo, _, _ in table]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n, parts, counts, hashes = _batch(batch)
            own = np.searchsorted(los, n, "right") - 1
            _, _, of, full, salt, row, at, dels = _segments(parts, own, counts, hashes, table)
            rows = np.concatenate((of, row))
            sigs = np.concatenate((_signed(salt, 0, full), _signed(salt[at], 1, dels)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in range(4)), pa.array(sigs)], ["i", "ni", "x0", "x1", "sig"])

    return run


def _probed(n, table, t: Fraction):
    """(row, band) of every scheme that sets of sizes ``n`` ask."""
    import numpy as np

    los = np.array([lo for lo, _, _ in table])
    low = np.searchsorted(los, -(-n * t.numerator // t.denominator), "right") - 1
    high = np.searchsorted(los, n, "right") - 1
    many = high - low + 1
    row = np.repeat(np.arange(len(n)), many)
    return row, low[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def _asked_segments(n, parts, counts, hashes, table, t):
    """The probes' (row, band) and their segments, with the words of a row repeated for each of its bands."""
    import numpy as np

    row, k = _probed(n, table, t)
    begin = np.cumsum(counts) - counts
    many = counts[row]
    word = np.repeat(begin[row] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    return row, k, _segments(parts[row], k, many, hashes[word], table)


def _prices(table, t):
    """(set_id, k, seg, kind, sig): the two signatures whose lists each probed segment may meet."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n, parts, counts, hashes = _batch(batch)
            row, k, (first, _, of, full, salt, _, _, _) = _asked_segments(n, parts, counts, hashes, table, t)
            seg = (np.arange(len(of)) - first[of]).astype(np.int32)
            ids = batch.column(0).take(pa.array(np.tile(row[of], 2)))
            kinds = np.repeat(np.array([0, 1], np.int32), len(of))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(k[of].astype(np.int32), 2)), pa.array(np.tile(seg, 2)), pa.array(kinds), pa.array(np.concatenate((_signed(salt, 0, full), _signed(salt, 1, full))))],
                ["p", "k", "seg", "kind", "sig"],
            )

    return run


def _asks(table, t: Fraction):
    """(p, np, x0, x1, sig) of every list that a probe has to meet after its budgets are allocated."""
    his = [hi for _, hi, _ in table]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n, parts, counts, hashes = _batch(batch)
            row, k, (first, m, of, full, salt, wrow, at, dels) = _asked_segments(n, parts, counts, hashes, table, t)
            cost = np.zeros((2, len(full)))
            lists = batch.column(batch.schema.get_field_index("costs"))
            place = {(int(r), int(b)): int(f) for r, b, f in zip(row, k, first)}
            for r, known in enumerate(lists.to_pylist()):
                for x in known or ():
                    cost[x["kind"], place[r, x["k"]] + x["seg"]] = x["c"]
            both = np.minimum(np.array(his)[k], n[row]) + n[row]
            free = np.maximum(0, 2 * m - 1 - both * (t.denominator - t.numerator) // (t.denominator + t.numerator))
            # all segments start at one deletion; ``free`` units are taken off where they cost most:
            # the one-deletion unit first, then the equal unit of the same segment
            gain = np.stack((cost[0] + cost[1] + 1e-3, cost[0]))
            order = np.lexsort((np.tile(np.arange(len(full)), 2), np.repeat([0, 1], len(full)), -gain.reshape(-1), np.tile(of, 2)))
            rank = np.arange(2 * len(full)) - 2 * np.repeat(first, 2 * m)
            taken = np.zeros(2 * len(full), bool)
            taken[order] = rank < np.repeat(free, 2 * m)
            budget = 1 - taken.reshape(2, -1).sum(0)
            on, near = budget >= 0, budget == 1
            deleted = near[at]
            rows = np.concatenate((row[of[on]], row[of[near]], row[wrow[deleted]]))
            sigs = np.concatenate((_signed(salt[on], 0, full[on]), _signed(salt[near], 1, full[near]), _signed(salt[at[deleted]], 0, dels[deleted])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in range(4)), pa.array(sigs)], ["p", "np", "y0", "y1", "sig"])

    return run


def _rare_words(sets: DataFrame, least_shared: Column) -> DataFrame:
    """(set_id, w): the rarest words of each set, one more than a partner may lack."""
    spread = sets.select("part", "set_id", "n", F.explode("hashes").alias("w"))
    counts = spread.groupBy("part", "w").agg(F.count("*").alias("c"))
    placed = spread.join(counts, ["part", "w"]).groupBy("set_id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("ws"))
    return placed.select("set_id", F.explode(F.slice("ws", F.lit(1), F.col("n") - least_shared + 1)).alias("x")).select("set_id", F.col("x.w").alias("w"))


def candidates(sets: DataFrame, threshold: float, growth: float = 1.35, spare: int = 2, hot: int = HOT) -> DataFrame:
    """(a, b): pairs of set ids among which are all of similarity ``threshold`` or more."""
    t = Fraction(str(threshold))
    largest = sets.agg(F.max("n")).first()[0] or 1
    table = bands(t, largest, Fraction(str(growth)), spare)
    half = lambda b: F.expr(f"aggregate(filter(hashes, x -> (x & 64L) = {b}L), 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63L as int)))")
    hashed = sets.select("set_id", "n", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.xxhash64("part").alias("ph"), "part")
    hashed = materialise(hashed.select("set_id", "n", half(0).alias("x0"), half(64).alias("x1"), "ph", "hashes", "part"), "near-hashed")
    shape = hashed.select("set_id", "n", "x0", "x1", "ph", "hashes")

    lists = materialise(shape.mapInArrow(_index(table), "i binary, ni int, x0 bigint, x1 bigint, sig bigint"), "near-index")
    counts = materialise(lists.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1"), "near-counts")
    priced = shape.mapInArrow(_prices(table, t), "p binary, k int, seg int, kind int, sig bigint").join(counts, "sig")
    costs = priced.groupBy("p").agg(F.collect_list(F.struct("k", "seg", "kind", "c")).alias("costs"))
    asked = shape.join(costs.withColumnRenamed("p", "set_id"), "set_id", "left").mapInArrow(_asks(table, t), "p binary, np int, y0 bigint, y1 bigint, sig bigint")

    apart = F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))) + F.bit_count(F.col("x1").bitwiseXOR(F.col("y1")))
    fits = (F.col("p") != F.col("i")) & (F.col("ni") <= F.col("np")) & (F.col("ni") * t.denominator >= F.col("np") * t.numerator)
    fits &= apart * (t.denominator + t.numerator) <= (F.col("ni") + F.col("np")) * (t.denominator - t.numerator)
    crowded = counts.where(F.col("c") > hot).select("sig")
    if not crowded.limit(1).count():
        met = asked.join(lists, "sig").where(fits)
    else:
        asked = materialise(asked, "near-asked")
        met = asked.join(crowded, "sig", "left_anti").join(lists, "sig").where(fits).select("p", "i")
        # a partner of a set of n words shares t * n of them at least
        rare = materialise(_rare_words(hashed, F.ceil(F.col("n") * t.numerator / t.denominator).cast("int")), "near-rare")
        side = lambda rows, k: rows.join(crowded, "sig", "left_semi").join(rare.withColumnRenamed("set_id", k), k)
        met = met.union(side(asked, "p").join(side(lists, "i"), ["sig", "w"]).where(fits).select("p", "i"))
    return met.select(F.least("p", "i").alias("a"), F.greatest("p", "i").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(part, a, b, similarity) of the candidate pairs that reach the threshold exactly."""
    t = Fraction(str(threshold))
    side = lambda k, *more: sets.select(*more, F.col("set_id").alias(k), F.col("words").alias("w" + k), F.col("n").alias("n" + k))
    both = pairs.join(side("a", "part"), "a").join(side("b"), "b")
    shared = both.withColumn("shared", F.size(F.array_intersect("wa", "wb"))).withColumn("all", F.col("na") + F.col("nb") - F.col("shared"))
    return shared.where(F.col("shared") * t.denominator >= F.col("all") * t.numerator).select("part", "a", "b", (F.col("shared") / F.col("all")).alias("similarity"))


def near_duplicates(records: DataFrame, threshold: float = 0.8, part_col: str = "part", id_col: str = "id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, texts, pairs): exact-copy classes, word-set classes, and linked pairs of sets."""
    members, texts, sets = classes(records, part_col, id_col, text_col)
    pairs = verified(materialise(candidates(sets, threshold), "near-candidates"), sets, threshold)
    return members, texts, materialise(pairs, "near-pairs")


def id_pairs(members: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(part, id_a, id_b): the links carried to ids of different texts, the smaller id first."""
    full = texts.join(members, ["part", "text_id"])
    left, right = (full.select("part", F.col("set_id").alias(s), F.col("text_id").alias("t" + s), F.col("id").alias("id_" + s)) for s in "ab")
    across = pairs.select("part", "a", "b").join(left, ["part", "a"]).join(right, ["part", "b"])
    several = texts.groupBy("part", "set_id").count().where("count > 1").select("part", F.col("set_id").alias("a"))
    within = several.join(left, ["part", "a"]).join(right.withColumnRenamed("b", "a"), ["part", "a"]).where("ta <> tb")
    rows = across.select("part", "id_a", "id_b").union(within.select("part", "id_a", "id_b")).where("id_a <> id_b")
    a, b = F.col("id_a").cast("string"), F.col("id_b").cast("string")
    return rows.select("part", F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")).distinct()
