"""Deterministic sampling, splitting and balancing by hashed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def key(seed: int, id_col: str) -> Column:
    """The hash that orders rows: sha256 of ``seed:id``."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")), 256)


def sample(rows: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """The ``n`` rows that come first in hashed order; Spark keeps ``n`` a partition."""
    return rows.withColumn("_k", key(seed, id_col)).orderBy("_k", id_col).limit(n).drop("_k")


def stratified(rows: DataFrame, by: str, n: int | dict[str, int], id_col: str, seed: int = 42) -> DataFrame:
    """``n`` rows of each stratum, or as many as a dict says."""
    w = Window.partitionBy(by).orderBy(key(seed, id_col), id_col)
    if isinstance(n, int):
        most: Column = F.lit(n)
    else:
        most = F.lit(0)
        for value, k in n.items():
            most = F.when(F.col(by) == value, k).otherwise(most)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def ranked(rows: DataFrame, by: str, id_col: str, seed: int = 42, rank: str = "_n", size: str | None = None) -> DataFrame:
    """Adds the rank from 1 in hashed order within each ``by`` (and its ``size``), exactly, without sorting a whole group in one task.

    The first two digits of the hash make 256 ranges; ranks are taken within a
    range and moved by the counts of the ranges before, which are 256 rows a group.
    """
    keyed = rows.withColumn("_k", key(seed, id_col)).withColumn("_r", F.substring("_k", 1, 2))
    counts = keyed.groupBy(F.col(by).alias("_by"), F.col("_r").alias("_range")).agg(F.count("*").alias("_c"))
    within = Window.partitionBy("_by")
    upto = F.sum("_c").over(within.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_by", "_range", F.coalesce(upto, F.lit(0)).alias("_before"), F.sum("_c").over(within).alias("_all"))
    own = F.row_number().over(Window.partitionBy(by, "_r").orderBy("_k", id_col))
    out = keyed.withColumn("_own", own).join(offsets, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_r") == F.col("_range")))
    out = out.withColumn(rank, F.col("_own") + F.col("_before"))
    if size:
        out = out.withColumn(size, F.col("_all"))
    return out.drop("_k", "_r", "_own", "_by", "_range", "_before", "_all")


def split(rows: DataFrame, by: str, ratios: tuple[float, float], id_col: str, seed: int = 42) -> DataFrame:
    """Adds ``split``: train, validation and test, cut at int(n * ratio) in hashed order within each stratum."""
    placed = ranked(rows, by, id_col, seed, size="_size")
    at, n = F.col("_n") - 1, F.col("_size")
    first, second = F.floor(n * F.lit(ratios[0])), F.floor(n * F.lit(ratios[0])) + F.floor(n * F.lit(ratios[1]))
    return placed.withColumn("split", F.when(at < first, "train").when(at < second, "validation").otherwise("test")).drop("_n", "_size")


def balance(rows: DataFrame, by: str, id_col: str, how: str = "under", seed: int = 42) -> DataFrame:
    """Equal strata: cut to the smallest, or repeated up to the largest (copies numbered in ``copy_index``)."""
    edge = rows.groupBy(by).agg(F.count("*").alias("_c")).agg((F.min if how == "under" else F.max)("_c").alias("_e"))  # one row
    placed = ranked(rows, by, id_col, seed, size="_c").crossJoin(F.broadcast(edge))
    if how == "under":
        return placed.where(F.col("_n") <= F.col("_e")).drop("_n", "_c", "_e")
    copies = F.floor(F.col("_e") / F.col("_c")) + F.when(F.col("_n") <= F.col("_e") % F.col("_c"), 1).otherwise(0)
    return placed.withColumn("copy_index", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_n", "_c", "_e")


def replicate(rows: DataFrame, copies: int) -> DataFrame:
    """Every row ``copies`` times, numbered in ``copy_index``."""
    return rows.withColumn("copy_index", F.explode(F.sequence(F.lit(1), F.lit(copies))))


def round_robin(rows: DataFrame, by: str, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """``n`` rows taken in turn from each group; no group gives more than ``n``, so Spark keeps that many a task."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(key(seed, id_col), id_col))
    return rows.withColumn("_n", at).where(F.col("_n") <= n).orderBy("_n", by).limit(n).drop("_n")


def fill(rows: DataFrame, by: str, targets: dict[str, int], n: int, id_col: str, seed: int = 42) -> DataFrame:
    """Each bucket's target first, then any rows up to ``n``, in hashed order; no bucket needs more than ``n`` of its rows."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(key(seed, id_col), id_col))
    target: Column = F.lit(0)
    for value, k in targets.items():
        target = F.when(F.col(by) == value, k).otherwise(target)
    ranked_rows = rows.withColumn("_n", at).where(F.col("_n") <= n).withColumn("_tier", F.when(F.col("_n") <= target, 0).otherwise(1)).withColumn("_k", key(seed, id_col))
    return ranked_rows.orderBy("_tier", "_k", id_col).limit(n).drop("_k", "_tier", "_n")


def class_weights(rows: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """(label, n, weight): total / (number of labels * n), 1 for an empty label."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(x,) for x in labels], f"{label} string")
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = rows.where(F.col(label).isin(*labels)).agg(F.count("*").alias("total"))  # one row
    full = F.broadcast(names).join(counts, label, "left").fillna(0, ["n"]).crossJoin(F.broadcast(total))
    return full.select(label, "n", F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.col("total") / (len(labels) * F.col("n"))).alias("weight"))
