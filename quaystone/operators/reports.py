"""Reports over labelled, retrieved and gated rows: summaries, audits, agreement, rankings and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaystone.functions.numeric import ratio


def _share(cond: Column, of: Column | None = None) -> Column:
    """Share of the rows (of those where ``of``) for which ``cond`` holds; null where there are none."""
    return F.try_divide(F.count_if(cond if of is None else cond & of).cast("double"), (F.count("*") if of is None else F.count_if(of)).cast("double"))


def classification_summary(report: DataFrame) -> DataFrame:
    """One row from a class report (label, support, predicted, precision, recall, f1): accuracy, macro and weighted means.

    Undefined precision or recall counts as 0, as do labels without support in the weighted means.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    total = F.sum("support").cast("double")
    names = ("precision", "recall", "f1")
    return report.agg(
        F.sum("support").alias("n"), F.try_divide(F.sum(zero("recall") * F.col("support")), total).alias("accuracy"),
        *[F.avg(zero(c)).alias(f"macro_{c}") for c in names], *[F.try_divide(F.sum(zero(c) * F.col("support")), total).alias(f"weighted_{c}") for c in names],
    )


def inclusion_summary(rows: DataFrame, expected: str, predicted: str, positive: str) -> DataFrame:
    """One row: accuracy over all classes, included or not, and over negatives only, with the share of negatives let in."""
    e, p = F.col(expected), F.col(predicted)
    known = rows.where(e.isNotNull() & p.isNotNull())
    yes, said = e == positive, p == positive
    return known.agg(
        F.count("*").alias("n"), _share(e == p).alias("accuracy"), _share(yes == said).alias("binary_accuracy"), _share(e == p, ~yes).alias("negative_accuracy"),
        _share(said, ~yes).alias("false_include_rate"), _share(~said, yes).alias("false_exclude_rate"), _share(~yes, ~said).alias("not_included_precision"), _share(~said, ~yes).alias("not_included_recall"),
    )


def operating_point(sweep: DataFrame, precision: float, recall: float) -> DataFrame:
    """One row of a threshold sweep: both bounds met, else the precision bound, else anything; then best f1, recall and smallest threshold."""
    tier = F.when((F.col("precision") >= precision) & (F.col("recall") >= recall), 0).when(F.col("precision") >= precision, 1).otherwise(2)
    return sweep.withColumn("tier", tier).orderBy("tier", F.desc("f1"), F.desc("recall"), "threshold").limit(1)


def retrieval_rows(hits: DataFrame, by: str, key: str, score: str = "score", rank: str = "rank") -> DataFrame:
    """One row a query: its keys and scores in order of rank, with their number, largest and mean score."""
    ordered = F.array_sort(F.collect_list(F.struct(rank, key, score)))
    out = hits.groupBy(by).agg(ordered.alias("_x"), F.count("*").alias("n"), F.max(score).alias("max_score"), F.avg(score).alias("mean_score"))
    return out.select(by, F.transform("_x", lambda x: x[key]).alias("keys"), F.transform("_x", lambda x: x[score]).alias("scores"), "n", "max_score", "mean_score")


def retrieval_stats(queries: DataFrame, hits: DataFrame, by: str, score: str = "score") -> DataFrame:
    """(by, max_score, mean_score, n) for every query; 0 where nothing was found."""
    found = hits.groupBy(by).agg(F.max(score).alias("max_score"), F.avg(score).alias("mean_score"), F.count("*").alias("n"))
    return queries.select(by).distinct().join(found, by, "left").fillna(0.0, ["max_score", "mean_score"]).fillna(0, ["n"])


def retrieval_audit(hits: DataFrame, by: str, key: str, parts: list[str]) -> DataFrame:
    """One row a query: hits, distinct keys and distinct values of each of ``parts``."""
    return hits.groupBy(by).agg(F.count("*").alias("hits"), F.countDistinct(key).alias("keys"), *[F.countDistinct(p).alias(f"n_{p}") for p in parts])


def agreement(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, n, agreed, rate) of two decisions, rows without either left out."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("agreed"), _share(F.col(a) == F.col(b)).alias("rate"))


def flag_summary(rows: DataFrame, by: str, flags: dict[str, Column], example: str, most: int = 5) -> DataFrame:
    """(by, flag, n, flagged, rate, examples): how often each flag is set in each group, with the first few ids."""
    spread = F.explode(F.array(*[F.struct(F.lit(k).alias("flag"), F.coalesce(v, F.lit(False)).alias("set")) for k, v in flags.items()]))
    flat = rows.select(by, F.col(example).alias("_id"), spread.alias("x")).select(by, "_id", "x.flag", "x.set")
    counts = flat.groupBy(by, "flag").agg(F.count("*").alias("n"), F.count_if("set").alias("flagged"), _share(F.col("set")).alias("rate"))
    ranked = flat.where("set").withColumn("_n", F.row_number().over(Window.partitionBy(by, "flag").orderBy("_id"))).where(F.col("_n") <= most)
    first = ranked.groupBy(F.col(by).alias("_by"), F.col("flag").alias("_flag")).agg(F.array_join(F.array_sort(F.collect_list("_id")), " ").alias("examples"))
    return counts.join(first, F.col(by).eqNullSafe(F.col("_by")) & (F.col("flag") == F.col("_flag")), "left").drop("_by", "_flag")


def cube_counts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(fields, n) of every subset of the fields; a null field is summed over, a missing value is ``unknown``."""
    return rows.select(*[F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias(f) for f in fields]).cube(*fields).agg(F.count("*").alias("n"))


def confidence_rows(rows: DataFrame, scores: dict[str, str], expected: str) -> DataFrame:
    """Adds predicted (the first of the largest), confidence, margin to the second, gap to the expected one, and error."""
    ordered = F.sort_array(F.array(*scores.values()), asc=False)
    predicted, own = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, col in reversed(scores.items()):
        predicted = F.when(F.col(col) == ordered[0], name).otherwise(predicted)
        own = F.when(F.col(expected) == name, F.col(col)).otherwise(own)
    out = rows.withColumns({"predicted": predicted, "confidence": ordered[0], "margin": ordered[0] - ordered[1], "gap": ordered[0] - own})
    return out.withColumn("error", F.col("predicted") != F.col(expected))


def error_summary(rows: DataFrame, expected: str) -> DataFrame:
    """(error_type, n, mean_margin, mean_gap) of the errors of ``confidence_rows``."""
    kind = F.concat_ws("_as_", F.col(expected), F.col("predicted"))
    return rows.where("error").groupBy(kind.alias("error_type")).agg(F.count("*").alias("n"), F.avg("margin").alias("mean_margin"), F.avg("gap").alias("mean_gap"))


def subset_summary(rows: DataFrame, by: str, decision: str, values: list[str]) -> DataFrame:
    """One row a group: decisions that differ from the most frequent one, and the mean of the values' spreads."""
    known = rows.where(F.col(decision).isNotNull())
    most = known.groupBy(by, decision).agg(F.count("*").alias("c")).groupBy(by).agg(F.max("c").alias("_most"), F.sum("c").alias("_n"))
    spreads = known.groupBy(by).agg(*[F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias(f"_{i}") for i, v in enumerate(values)])
    spread = sum((F.col(f"_{i}") for i in range(len(values))), F.lit(0.0)) / len(values)
    return most.join(spreads, by).select(by, F.col("_n").alias("n"), (1 - F.col("_most") / F.col("_n")).alias("instability"), spread.alias("vector_instability"))


def text_matches(rows: DataFrame, a: str, b: str) -> Column:
    """Either text holds the other, blanks squeezed and case ignored; empty texts match nothing."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r\x0B\f]+", " "))
    x, y = norm(F.col(a)), norm(F.col(b))
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), F.lit(False))


def ownership(claimed: DataFrame, known: DataFrame, key: str, owner: str) -> DataFrame:
    """(issue, n): keys that nobody knows, and keys claimed for another owner than theirs."""
    own = known.groupBy(key).agg(F.min(owner).alias("_own"))
    issue = F.when(F.col("_own").isNull(), "unknown").when(~F.col("_own").eqNullSafe(F.col(owner)), "foreign").otherwise("ok")
    return claimed.join(own, key, "left").groupBy(issue.alias("issue")).agg(F.count("*").alias("n"))


def split_leaks(rows: DataFrame, key: str, split: str) -> DataFrame:
    """(key, splits) of keys that are in more than one split."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.countDistinct(split).alias("_n")).where("_n > 1").drop("_n")


def evidence_grid(hits: DataFrame, by: str, rank: str, subsets: dict[str, list[int]]) -> DataFrame:
    """The hits of each query once for every subset of ranks that holds them."""
    held = F.array(*[F.struct(F.lit(name).alias("subset"), F.array(*[F.lit(r) for r in ranks]).alias("ranks")) for name, ranks in subsets.items()])
    return hits.withColumn("_s", F.explode(held)).where(F.array_contains(F.col("_s.ranks"), F.col(rank))).withColumn("subset", F.col("_s.subset")).drop("_s")


def expanded(queries: DataFrame, text: str, rules: list[tuple[str, str]], fallback: list[str], most: int) -> DataFrame:
    """One row a variant (variant_no from 1): the text, the texts of the rules that match it, else the fallback terms; no variant twice."""
    low = F.lower(text)
    found = F.filter(F.array(*[F.when(low.rlike(p), F.lit(add)) for p, add in rules]), lambda x: x.isNotNull())
    extra = F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(x) for x in fallback]))
    every = F.concat(F.array(F.col(text)), F.transform(extra, lambda x: F.concat_ws(" ", F.col(text), x)))
    own = F.filter(every, lambda x, i: ~F.exists(F.slice(every, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    kept = queries.where(F.col(text).isNotNull()).select("*", F.posexplode(F.slice(own, 1, most)).alias("_p", "variant"))
    return kept.withColumn("variant_no", F.col("_p") + 1).drop("_p")


def pinned_first(pinned: DataFrame, hits: DataFrame, by: str, key: str, rank: str, limit: int) -> DataFrame:
    """Pinned keys of a query before its hits, each key once, ``limit`` in all."""
    both = pinned.select(by, key, F.col(rank).alias("_r"), F.lit(0).alias("_tier")).union(hits.select(by, key, F.col(rank), F.lit(1)))
    first = both.groupBy(by, key).agg(F.min(F.struct("_tier", "_r")).alias("_x"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_x", key))
    return first.withColumn("place", place).where(F.col("place") <= limit).select(by, key, "place", (F.col("_x._tier") == 0).alias("pinned"))


def none_aware(rows: DataFrame, by: list[str], keys: list[tuple[str, bool]], last: str) -> DataFrame:
    """Rank within ``by`` on several keys (column, descending); a missing value comes last on its key."""
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order, last)))


def keep_last_at_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the values of its last insert at the place of its first one."""
    w = Window.partitionBy(key)
    return rows.withColumn("first_place", F.min(order).over(w)).withColumn("_l", F.row_number().over(w.orderBy(F.desc(order)))).where("_l = 1").drop("_l", order)


def interval_lookup(points: DataFrame, markers: DataFrame, by: str, pos: str, value: str) -> DataFrame:
    """Adds ``value`` of the last marker at or before each point of the same ``by``; null before the first.

    Both sides share one sort within ``by``: no range join, no pair is made.
    """
    names = [c for c in points.columns if c not in (by, pos)]
    both = points.select(by, pos, F.struct(*names).alias("_p"), F.lit(None).cast(markers.schema[value].dataType).alias(value), F.lit(1).alias("_k"))
    both = both.union(markers.select(by, pos, F.lit(None).cast(both.schema["_p"].dataType), value, F.lit(0)))
    held = F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(pos, "_k").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_v", held).where("_k = 1").select(by, pos, "_p.*", F.col("_v").alias(value))


def lexical_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the tokens of ``b``; 0 if ``b`` has none."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(b)))


def code_point_sum(c, modulo: int) -> Column:
    """Sum of the code points of a text, modulo: a stable offset without a hash."""
    return F.pmod(F.aggregate(F.transform(F.split(c, ""), lambda x: F.coalesce(F.ascii(x), F.lit(0))), F.lit(0).cast("bigint"), lambda s, x: s + x), F.lit(modulo))


def normalised_predictions(rows: DataFrame, label: str, score: str, names: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good, failures): labels mapped to their canonical name with a score in [0, 1], and the rest with the reason."""
    mapped = F.lit(None).cast("string")
    for alias, name in names.items():
        mapped = F.when(F.lower(F.trim(F.col(label))) == alias, name).otherwise(mapped)
    reason = F.when(F.col(label).isNull(), "no label").when(mapped.isNull(), "unknown label").when(F.col(score).isNull(), "no score").when(~F.col(score).between(0, 1), "score out of range")
    judged = rows.withColumns({"canonical": mapped, "reason": reason})
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").drop("canonical")
