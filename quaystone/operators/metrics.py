"""Ranking, classification, calibration and distribution metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaystone.functions.numeric import bin_of, ratio


def ranking(ranked: DataFrame, labels: DataFrame, query: str, key: str, ks: tuple[int, ...] = (1, 3, 5, 10), threshold: float = 0.0) -> DataFrame:
    """One row a query of ``labels`` or ``ranked``: ndcg, recall, precision, hit rate at each k, and mrr.

    Gain is 2^rel - 1, discount log2(rank + 1), the ideal order is over all labels;
    relevant means above ``threshold``. Queries without labels score 0.
    """
    ks = tuple(sorted({k for k in ks if k > 0}))
    gain = lambda rel: F.pow(F.lit(2.0), rel) - 1
    ideal = labels.withColumn("_i", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("rel"), key))).groupBy(query).agg(
        F.sum(F.when(F.col("rel") > threshold, 1).otherwise(0)).alias("n_rel"),
        *[F.sum(F.when(F.col("_i") <= k, gain(F.col("rel")) / F.log2(F.col("_i") + 1.0)).otherwise(0.0)).alias(f"idcg_{k}") for k in ks],
    )
    joined = ranked.select(query, key, "rank").join(labels.select(query, key, "rel"), [query, key], "left").fillna(0.0, ["rel"])
    hit = F.col("rel") > threshold
    got = joined.groupBy(query).agg(
        F.count("*").alias("n_ranked"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        *[F.sum(F.when(F.col("rank") <= k, gain(F.col("rel")) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}") for k in ks],
        *[F.sum(F.when((F.col("rank") <= k) & hit, 1).otherwise(0)).alias(f"hits_{k}") for k in ks],
    )
    both = got.join(ideal, query, "full_outer").fillna(0)
    out = [F.col(query)]
    for k in ks:
        out += [
            ratio(F.col(f"dcg_{k}"), F.col(f"idcg_{k}")).alias(f"ndcg_{k}"),
            ratio(F.col(f"hits_{k}"), F.col("n_rel")).alias(f"recall_{k}"),
            ratio(F.col(f"hits_{k}"), F.least(F.lit(k), F.col("n_ranked"))).alias(f"precision_{k}"),
            (F.col(f"hits_{k}") > 0).cast("double").alias(f"hit_{k}"),
        ]
    return both.select(*out, F.when(F.col("first") > 0, 1.0 / F.col("first")).otherwise(0.0).alias("mrr"))


def confusion(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """(expected, predicted, n) of rows with both."""
    return rows.where(F.col(expected).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(cells: DataFrame) -> DataFrame:
    """(label, support, predicted, precision, recall, f1) of each label of a confusion; undefined ones are null."""
    flat = cells.select(F.explode(F.array(
        F.struct(F.col("expected").alias("label"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("tp")),
    )).alias("x")).select("x.*")
    sums = flat.groupBy("label").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    p, r = F.try_divide(F.col("tp").cast("double"), F.col("predicted").cast("double")), F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double"))
    return sums.select("label", "support", "predicted", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def reliability(rows: DataFrame, probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate, gap): half-open bins, empty ones kept."""
    spark = rows.sparkSession
    full = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    known = rows.where(F.col(probability).isNotNull() & F.col(outcome).isNotNull())
    found = known.groupBy(bin_of(F.col(probability), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("mean_p"), F.avg(F.col(outcome).cast("double")).alias("rate"))
    return full.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "rate", F.abs(F.col("mean_p") - F.col("rate")).alias("gap"))


def calibration_error(table: DataFrame) -> DataFrame:
    """One row: expected calibration error of a reliability table."""
    return table.agg((F.sum(F.col("n") * F.coalesce("gap", F.lit(0.0))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def threshold_sweep(rows: DataFrame, score: str, outcome: str, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, f1): one pass, each row meets the grid inside its task."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    hit, yes = F.col("s") >= F.col("threshold"), F.col("y") == 1
    spread = rows.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).select(F.col(score).alias("s"), F.col(outcome).cast("int").alias("y"), grid)
    cells = spread.groupBy("threshold").agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))
    tp = F.col("tp")
    return cells.select("*", ratio(tp, tp + F.col("fp")).alias("precision"), ratio(tp, tp + F.col("fn")).alias("recall"), ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"))


def best_f1(rows: DataFrame, score: str, outcome: str) -> DataFrame:
    """One row: the observed score that is the best threshold; ties by recall, then fewer false positives.

    Scores are counted first; the running sums go over distinct scores only,
    bucket by bucket (64 ranges of the counted scores), so no task gets all rows.
    """
    per = rows.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(outcome).cast("bigint")).alias("pos"), F.count("*").alias("n"))
    bounds = per.agg(F.percentile_approx("threshold", [i / 64 for i in range(1, 64)], 1000)).first()[0] or []  # 63 values at most
    cuts = F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<double>")
    per = per.withColumn("_b", F.size(F.filter(cuts, lambda c: c < F.col("threshold"))))
    own = Window.partitionBy("_b").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = per.groupBy("_b").agg(F.sum("pos").alias("bp"), F.sum("n").alias("bn"))  # 64 rows at most
    before = buckets.select("_b", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n0"))
    total = per.agg(F.sum("pos").alias("all_pos"))
    run = per.withColumn("tp", F.sum("pos").over(own)).withColumn("k", F.sum("n").over(own)).join(before, "_b").crossJoin(F.broadcast(total))
    run = run.withColumn("tp", F.col("tp") + F.col("p0")).withColumn("fp", F.col("k") + F.col("n0") - F.col("tp"))
    f1 = ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_pos"))
    return run.select("threshold", "tp", "fp", f1.alias("f1"), ratio(F.col("tp"), F.col("all_pos")).alias("recall")).orderBy(F.desc("f1"), F.desc("recall"), "fp", "threshold").limit(1)


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, n) over [0, 1], values clamped, empty bins kept."""
    full = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    found = rows.where(F.col(value).isNotNull()).groupBy(bin_of(F.col(value), bins).alias("bin")).agg(F.count("*").alias("n"))
    return full.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def counted_upto(rows: DataFrame, by: str, value: str, ranges: int = 256) -> DataFrame:
    """(by, v, upto, n): how many of a group's ``n`` values are at most each of its distinct values.

    Values are counted before anything is ordered; running counts go over the
    distinct values of one of ``ranges`` equal ranges of a group, plus the counts
    of the ranges before, so no task orders a whole group.
    """
    per = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    edges = per.groupBy(F.col(by).alias("_by")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    own_group = F.col(by).eqNullSafe(F.col("_by"))
    placed = per.join(edges, own_group).withColumn("_r", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (ranges - 1))).otherwise(0)).drop("_by", "lo", "hi")
    sums = placed.groupBy(F.col(by).alias("_by"), F.col("_r").alias("_range")).agg(F.sum("c").alias("s"))
    group = Window.partitionBy("_by")
    before = sums.select("_by", "_range", F.coalesce(F.sum("s").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("s").over(group).alias("n"))
    upto = F.sum("c").over(Window.partitionBy(by, "_r").orderBy("v"))
    return placed.withColumn("upto", upto).join(before, own_group & (F.col("_r") == F.col("_range"))).select(by, "v", (F.col("upto") + F.col("_before")).alias("upto"), "n")


def quantiles(rows: DataFrame, by: str, value: str, qs: dict[str, float]) -> DataFrame:
    """(by, ...): linearly interpolated quantiles under their names, from running counts of distinct values."""
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    place = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in qs.items()}
    found = counted_upto(rows, by, value).groupBy(by).agg(F.max("n").alias("_n"), *[c for name, x in place.items() for c in (at(F.floor(x)).alias(f"_lo_{name}"), at(F.ceil(x)).alias(f"_hi_{name}"))])
    part = lambda q: (F.col("_n") - 1) * F.lit(float(q)) - F.floor((F.col("_n") - 1) * F.lit(float(q)))
    return found.select(by, *[(F.col(f"_lo_{name}") + part(q) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name) for name, q in qs.items()])


def distribution(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, min, p25, p50, p75, max, mean, pstdev): linearly interpolated quantiles."""
    plain = rows.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("pstdev"))
    cuts = quantiles(rows, by, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).withColumnRenamed(by, "_group")
    return plain.join(cuts, F.col(by).eqNullSafe(F.col("_group"))).select(by, "n", "min", "p25", "p50", "p75", "max", "mean", "pstdev")


def nearest_rank_quantiles(rows: DataFrame, by: str, value: str, qs: tuple[float, ...] = (0.1, 0.5, 0.9), ranges: int = 256) -> DataFrame:
    """(by, n, q..): values at round((n - 1) q), half to even."""
    ordered = counted_upto(rows, by, value, ranges)
    return ordered.groupBy(by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * F.lit(q)), F.col("v"))).alias(f"q{int(q * 100)}") for q in qs])


def slices(rows: DataFrame, fields: list[str], aggregates: list[Column]) -> DataFrame:
    """(field, value, ...): the same aggregates by each of several fields, in one pass; missing values are 'unknown'."""
    spread = rows.withColumn("_f", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias("value")) for f in fields])))
    return spread.groupBy(F.col("_f.field").alias("field"), F.col("_f.value").alias("value")).agg(*aggregates)


def stat_means(rows: DataFrame, by: str, stats: list[str]) -> DataFrame:
    """(by, stat, n, mean): means of many columns in long form, nulls and NaN left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s.split(".")[-1]).alias("stat"), F.col(s).cast("double").alias("x")) for s in stats]))
    long = rows.select(by, pairs.alias("p")).select(by, "p.*").where(F.col("x").isNotNull() & ~F.isnan("x"))
    return long.groupBy(by, "stat").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))


def mean_pairwise_cosine(vectors: DataFrame, by: str, vec: str) -> DataFrame:
    """(by, n, consistency): mean cosine over all pairs of a group, by its closed form.

    (|sum of unit vectors|^2 - sum of their squares) / (n (n - 1)): one pass and
    partial sums of each dimension instead of all pairs. One vector gives 1.
    """
    from quaystone.functions.vectors import norm

    sized = vectors.where(F.col(vec).isNotNull()).withColumn("_n", norm(F.col(vec)))
    unit = F.transform(F.col(vec), lambda x: F.when(F.col("_n") > 0, x.cast("double") / F.col("_n")).otherwise(F.lit(0.0)))
    spread = sized.select(by, F.posexplode(unit).alias("i", "x"))
    dims = spread.groupBy(by, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("sq"), F.count("*").alias("n"))
    total = dims.groupBy(by).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("a"), F.sum("sq").alias("b"))
    return total.select(by, "n", F.when(F.col("n") < 2, F.lit(1.0)).otherwise((F.col("a") - F.col("b")) / (F.col("n") * (F.col("n") - 1))).alias("consistency"))


