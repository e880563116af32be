"""Reshaping: label aliases, nested fields, packed contexts, validation reports, paired settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaystone.operators.sampling import key

#: Spellings of the three labels.
ALIASES = {
    "entailment": ("entailment", "entail", "supported", "support", "included", "0"),
    "neutral": ("neutral", "unsupported", "not_enough_info", "nei", "partial", "1"),
    "contradiction": ("contradiction", "contradict", "contradicted", "refuted", "not_included", "2"),
}


def canonical_label(c, aliases: dict[str, tuple[str, ...]] = ALIASES) -> Column:
    """The label that a spelling means, case and outer blanks ignored; null if none."""
    low = F.regexp_replace(F.lower(F.trim(c)), "[ -]+", "_")
    out = None
    for name, spellings in aliases.items():
        out = F.when(low.isin(*spellings), name) if out is None else out.when(low.isin(*spellings), name)
    return out


def with_nested(rows: DataFrame, path: str, value: Column) -> DataFrame:
    """The rows with the field at a dotted path set."""
    top, _, rest = path.partition(".")
    return rows.withColumn(top, F.col(top).withField(rest, value) if rest else value)


def scores(c) -> Column:
    """Map of a "E=0.1 | N=0.2" text."""
    return F.transform_values(F.str_to_map(F.regexp_replace(c, " ", ""), F.lit("\\|"), F.lit("=")), lambda k, v: v.cast("double"))


def packed_contexts(hits: DataFrame, by: str, rank: str, text: str, each: int = 650, total: int = 2600) -> DataFrame:
    """(by, packed, n): contexts in order, each cut to ``each`` characters, while their sum stays within ``total``."""
    w = Window.partitionBy(by).orderBy(rank)
    piece = F.substring(text, 1, each)
    before = F.coalesce(F.sum(F.length(piece)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = hits.select(by, rank, piece.alias("_p"), before.alias("_b")).where(F.col("_b") < total)
    kept = kept.withColumn("_p", F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), F.substring(F.col("_p"), F.lit(1), (F.lit(total) - F.col("_b")).cast("int"))))
    return kept.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(rank, "_p"))).alias("_ps"), F.count("*").alias("n")).select(by, F.array_join(F.transform("_ps", lambda x: x["_p"]), "\n").alias("packed"), "n")


def report(rows: DataFrame, id_col: str, checks: dict[str, Column]) -> DataFrame:
    """One row: counts, repeated ids, and for each check the rows that fail and whether all hold."""
    repeated = rows.groupBy(id_col).agg(F.count("*").alias("_c")).agg(F.coalesce(F.sum(F.when(F.col("_c") > 1, F.col("_c") - 1).otherwise(0)), F.lit(0)).alias("repeated_ids"))
    failed = [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"failed_{n}") for n, c in checks.items()]
    out = rows.agg(F.count("*").alias("n"), *failed).crossJoin(repeated)  # one row each
    return out.withColumn("valid", (F.col("repeated_ids") == 0) & (sum((F.col(f"failed_{n}") for n in checks), F.lit(0)) == 0))


def unordered_pairs(rows: DataFrame, by: str, item: str) -> DataFrame:
    """(by, a, b): pairs of different items of a group, each once; for groups of a few items, such as sources of one topic."""
    spread = rows.select(by, item).distinct()
    return spread.select(by, F.col(item).alias("a")).join(spread.select(by, F.col(item).alias("b")), by).where("a < b")


def sensitivity(paired: DataFrame, a: str, b: str, threshold: float, near: float = 0.05) -> DataFrame:
    """Adds delta, whether the decision at a threshold flips, and whether either value lies near it."""
    x, y = F.col(a), F.col(b)
    return paired.withColumns({
        "delta": y - x,
        "flipped": (x >= threshold) != (y >= threshold),
        "near": F.least(F.abs(x - threshold), F.abs(y - threshold)) <= F.greatest(F.lit(near), F.lit(near * threshold)),
    })


def weighted_sample(rows: DataFrame, weight: str, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, with chances that follow the weights: the largest u^(1/w) of hashed u."""
    u = (F.conv(F.substring(key(seed, id_col), 1, 13), 16, 10).cast("double") + 1) / float(16**13 + 1)
    chance = F.when(F.col(weight) > 0, F.ln(u) / F.col(weight))
    return rows.withColumn("_u", chance).where("_u is not null").orderBy(F.desc("_u"), id_col).limit(n).drop("_u")


def by_file_name(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Adds columns from the groups of a pattern on the name of the file a row came from; files that don't match are left out."""
    path = F.col("_metadata.file_name")
    out = df.select("*", *[F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)], F.rlike(path, F.lit(pattern)).alias("_ok"))
    return out.where("_ok").drop("_ok")


def numbered(rows: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """Adds the position from 0 in ``order``: positions within 256 approximate ranges plus the counts before, so no task orders all rows."""
    cuts = rows.agg(F.percentile_approx(order, [i / 256 for i in range(1, 256)], 4000)).first()[0] or []  # 255 values
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    placed = rows.withColumn("_r", F.size(F.filter(bounds, lambda c: c < F.col(order))) if cuts else F.lit(0))
    counts = placed.groupBy("_r").agg(F.count("*").alias("_c"))
    before = counts.select("_r", F.coalesce(F.sum("_c").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy("_r").orderBy(order)) - 1
    return placed.withColumn("_o", own).join(before, "_r").withColumn(name, F.col("_o") + F.col("_b")).drop("_r", "_o", "_b")


def zipped(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """Rows of two tables side by side by position in ``order``; different lengths are an error."""
    if a.count() != b.count():
        raise ValueError("the tables differ in length")
    right = numbered(b, order).select("ordinal", *[F.col(c).alias(f"{c}_b") for c in b.columns])
    return numbered(a, order).join(right, "ordinal")
