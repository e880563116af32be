"""Joins with the contracts evaluation data needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: matched, missing (only left) and extra (only right) distinct keys."""
    sides = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full_outer")
    return sides.agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"), F.count_if(F.col("_r").isNull()).alias("missing"), F.count_if(F.col("_l").isNull()).alias("extra"))


def strict(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that raises unless both sides have the same keys."""
    c = coverage(left, right, key).first()
    if c["missing"] or c["extra"]:
        raise ValueError(f"{c['missing']} keys without a partner, {c['extra']} unexpected ones")
    return left.join(right, key)


def with_fallback(rows: DataFrame, by_id: DataFrame, by_text: DataFrame, id_col: str, text_col: str, value: str) -> DataFrame:
    """Left lookup by id, and by text where the id finds nothing."""
    a = by_id.select(id_col, F.col(value).alias("_a"))
    b = by_text.select(text_col, F.col(value).alias("_b"))
    return rows.join(a, id_col, "left").join(b, text_col, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def update_from(target: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Target rows with every non-empty field of the source's row of the same key."""
    new = source.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    out = target.join(new, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.when(F.trim(F.col(f"_{f}").cast("string")) != "", F.col(f"_{f}")), F.col(f)))
    return out.drop(*[f"_{f}" for f in fields])


def insert_absent(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Target rows and those of the source whose key is new."""
    return target.unionByName(source.join(target, key, "left_anti"))


def related_pairs(rows: DataFrame, id_col: str, tags: str, different: str, per_pair: int | None = None) -> DataFrame:
    """(id_a, id_b, shared): unordered pairs of different ``different`` that share a tag; equal tags meet by equi-join only.

    With ``per_pair``, only that many pairs of each two values of ``different``: those that share most, then by id.
    """
    spread = rows.select(F.col(id_col).alias("id"), F.col(different).alias("d"), F.explode(F.array_distinct(tags)).alias("tag"))
    left, right = (spread.select("tag", F.col("id").alias(f"id_{s}"), F.col("d").alias(f"d_{s}")) for s in "ab")
    pairs = left.join(right, "tag").where((F.col("id_a") < F.col("id_b")) & (F.col("d_a") != F.col("d_b")))
    counted = pairs.groupBy("id_a", "id_b", "d_a", "d_b").agg(F.count("*").alias("shared"))
    if per_pair is not None:
        w = Window.partitionBy(F.least("d_a", "d_b"), F.greatest("d_a", "d_b")).orderBy(F.desc("shared"), "id_a", "id_b")
        counted = counted.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_pair)
    return counted.select("id_a", "id_b", "shared")


def paired(rows: DataFrame, keys: list[str], variant: str, a: str, b: str, values: list[str]) -> DataFrame:
    """One row for each ``keys`` that has both variants, with both values and their delta."""
    picked = rows.where(F.col(variant).isin(a, b)).groupBy(*keys).agg(*[F.max(F.when(F.col(variant) == v, F.col(c))).alias(f"{c}_{n}") for c in values for n, v in (("a", a), ("b", b))], F.countDistinct(variant).alias("_n"))
    return picked.where("_n = 2").drop("_n").withColumns({f"{c}_delta": F.col(f"{c}_b") - F.col(f"{c}_a") for c in values})


def ensemble(rows: DataFrame, key: str, source: str, scores: list[str], weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the scores of all sources; keys that miss a source are left out."""
    w: Column = F.lit(None).cast("double")
    for s, x in weights.items():
        w = F.when(F.col(source) == s, F.lit(x)).otherwise(w)
    kept = rows.withColumn("_w", w).where("_w is not null")
    total = sum(weights.values())
    return kept.groupBy(key).agg(F.countDistinct(source).alias("_n"), *[(F.sum(F.col(c) * F.col("_w")) / total).alias(c) for c in scores]).where(F.col("_n") == len(weights)).drop("_n")


def keep_last(rows: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """The row of each key with the largest ``order``; partial aggregation, no sort of a whole key."""
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("x"))
    return picked.select(key, "x.*")


def _ranged(rows: DataFrame, order: str, ranges: int) -> DataFrame:
    """Adds ``_r``: one of ``ranges`` equal ranges of a numeric ``order``, so that a hot group is split among tasks."""
    edges = rows.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))  # one row
    part = (F.col(order) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)) * (ranges - 1)
    return rows.crossJoin(F.broadcast(edges)).withColumn("_r", F.coalesce(F.floor(part), F.lit(0))).drop("_lo", "_hi")


def neighbours(rows: DataFrame, by: str, order: str, value: str, out: str, sep: str = " ", ranges: int = 64) -> DataFrame:
    """Adds ``out``: previous, own and next value of a row in its group, joined; values that are null are left out.

    Windows run within ranges of ``order``; the ends of a range look up the nearest
    range of their group that has rows.
    """
    placed = _ranged(rows, order, ranges)
    own, group = Window.partitionBy(by, "_r").orderBy(order), Window.partitionBy("_by").orderBy("_range")
    ends = placed.groupBy(F.col(by).alias("_by"), F.col("_r").alias("_range")).agg(F.min_by(F.struct(value), order).alias("_f"), F.max_by(F.struct(value), order).alias("_l"))
    ends = ends.select("_by", "_range", F.lag("_l").over(group)[value].alias("_before"), F.lead("_f").over(group)[value].alias("_after"))
    near = placed.withColumns({"_p": F.lag(F.struct(value)).over(own), "_n": F.lead(F.struct(value)).over(own)})
    near = near.join(ends, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_r") == F.col("_range")))
    side = lambda inside, outside: F.when(F.col(inside).isNotNull(), F.col(inside)[value]).otherwise(F.col(outside))
    return near.withColumn(out, F.concat_ws(sep, side("_p", "_before"), value, side("_n", "_after"))).select(*rows.columns, out)


def running_before(rows: DataFrame, by: str, order: str, value: str, out: str, ranges: int = 64) -> DataFrame:
    """Adds ``out``: the sum of the values before a row in its group, 0 for the first; sums within ranges plus those of the ranges before."""
    placed = _ranged(rows, order, ranges)
    own, group = Window.partitionBy(by, "_r").orderBy(order), Window.partitionBy("_by").orderBy("_range")
    sums = placed.groupBy(F.col(by).alias("_by"), F.col("_r").alias("_range")).agg(F.sum(value).alias("_s"))
    sums = sums.select("_by", "_range", F.coalesce(F.sum("_s").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_i", inner).join(sums, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_r") == F.col("_range"))).withColumn(out, F.col("_i") + F.col("_before")).select(*rows.columns, out)
