"""Lexical support scores of a candidate against its evidence, and statistics over contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaystone.functions import text as T
from quaystone.functions.numeric import argmax, clamp01, entropy, softmax

#: Words that point to invented content if the evidence lacks them.
INVENTED = ("email", "address", "xml", "template", "vendor", "private", "provider", "watermark", "printed", "print", "14", "point", "font", "notices", "approved", "named")
#: Words of obligation and denial.
CONTRADICTING = ("must", "mustn't", "shall", "should", "cannot", "required", "requires", "prohibited", "unless", "except", "only", "all", "never", "no", "not")


def support(rows: DataFrame, query: str, candidate: str, evidence: str) -> DataFrame:
    """Adds containment, overlap, supported, unsupported, contradicted (summing to 1) and support_status.

    Null texts count as empty. Tokens are made once and shared by all rules.
    """
    empty = F.lit("")
    out = rows.withColumns({"_c": T.plain(F.coalesce(F.col(candidate), empty)), "_e": T.plain(F.coalesce(F.col(evidence), empty)), "_q": T.plain(F.coalesce(F.col(query), empty))})
    out = out.withColumns({"_ct": T.tokens(F.col("_c")), "_et": T.tokens(F.col("_e")), "_qt": T.tokens(F.col("_q")), "_cn": T.numbers(F.col("_c")), "_en": T.numbers(F.col("_e"))})
    negations = lambda c: T.count_in(T.tokens(F.col(c), ()), T.NEGATIONS)
    out = out.withColumns({"containment": T.containment(F.col("_ct"), F.col("_et")), "overlap": T.jaccard(F.col("_ct"), F.col("_et")), "_qo": T.jaccard(F.col("_qt"), F.col("_et"))})
    k, j = F.col("containment"), F.col("overlap")
    exact = (F.col("_c") != "") & F.contains(F.col("_e"), F.col("_c"))
    mismatch = (F.size("_cn") > 0) & (F.size("_en") > 0) & (F.size(F.array_except("_cn", "_en")) > 0)
    near = k >= 0.35
    rules: list[tuple[Column, float, float, float]] = [
        (exact, 0.65, -0.25, -0.10),
        (mismatch & near, -0.25, -0.05, 0.45),
        ((negations("_c") != negations("_e")) & near, -0.20, -0.05, 0.35),
        ((T.count_in(F.array_except("_ct", "_et"), INVENTED) > 0) & (k < 0.55), -0.25, 0.35, -0.05),
        ((T.count_in(F.col("_ct"), CONTRADICTING) > 0) & (k >= 0.30) & ~exact, 0.0, 0.0, 0.18),
        ((k >= 0.55) & ~exact, -0.22, 0.0, 0.18),
        (k < 0.45, -0.20, 0.25, 0.0),
    ]
    scores = [0.15 + 0.65 * k + 0.20 * j, 0.55 - 0.35 * k + 0.10 * (1 - F.col("_qo")), 0.12 + 0.15 * j]
    for when, *changes in rules:
        scores = [s + F.when(when, F.lit(x)).otherwise(F.lit(0.0)) if x else s for s, x in zip(scores, changes)]
    names = ["supported", "unsupported", "contradicted"]
    out = out.withColumns({f"_s{i}": clamp01(s) for i, s in enumerate(scores)})
    out = out.withColumns(dict(zip(names, softmax([F.col(f"_s{i}") for i in range(3)]))))
    out = out.withColumn("support_status", argmax(names, [F.col(n) for n in names]))
    return out.drop("_c", "_e", "_q", "_ct", "_et", "_qt", "_cn", "_en", "_qo", "_s0", "_s1", "_s2")


def context_statistics(rows: DataFrame, by: str, e: str, n: str, c: str) -> DataFrame:
    """One row a group: means, spread, top-half mean, margins, label entropy and disagreement over its contexts."""
    names = ["entailment", "neutral", "contradiction"]
    label = argmax(names, [F.col(e), F.col(n), F.col(c)])
    ordered = F.sort_array(F.array(e, n, c), asc=False)
    rows = rows.withColumns({"_l": label, "_m": F.least(e, c), "_t": ordered[0] - ordered[1], "_u": 1 - ordered[0], "_s": F.greatest(F.lit(0.0), F.col(c) - F.col(n))})
    out = rows.groupBy(by).agg(
        F.count("*").alias("contexts"), *[F.avg(x).alias(f"{k}_mean") for k, x in zip(names, (e, n, c))], F.stddev_pop(c).alias("contradiction_std"), F.max(e).alias("support_max"),
        F.avg("_m").alias("conflict_mass"), F.avg("_t").alias("top2_margin"), F.avg("_u").alias("uncertainty"), F.avg("_s").alias("support"),
        *[F.avg((F.col("_l") == x).cast("double")).alias(f"share_{x}") for x in names],
    )
    # the larger half by counted values and running counts: no group is gathered in one row
    w = Window.partitionBy(by)
    counted = rows.groupBy(by, F.col(c).alias("_v")).agg(F.count("*").alias("_k"))
    counted = counted.withColumn("_before", F.coalesce(F.sum("_k").over(w.orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_half", F.ceil(F.sum("_k").over(w) / 2))
    taken = F.greatest(F.lit(0), F.least(F.col("_k"), F.col("_half") - F.col("_before")))
    top = counted.groupBy(F.col(by).alias("_by")).agg((F.sum(F.col("_v") * taken) / F.max("_half")).alias("contradiction_top_half"))
    shares = [F.col(f"share_{x}") for x in names]
    out = out.withColumns({"label_entropy": entropy(shares), "disagreement": 1 - F.greatest(*shares)})
    return out.join(top, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def repetition(rows: DataFrame, text: str, n: int = 3) -> DataFrame:
    """Adds words, top_share (most frequent word longer than 3) and top_gram (largest count of an n-gram), all without a shuffle."""
    most = lambda a: F.coalesce(F.array_max(F.transform(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y == x)))), F.lit(0))
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[ \t\n\r\x0B\f]+"), lambda w: w != "")
    out = rows.withColumn("_w", words)
    size = F.size("_w")
    return out.withColumns({
        "words": size,
        "top_share": F.when(size > 0, most(F.filter("_w", lambda w: F.length(w) > 3)) / size).otherwise(F.lit(0.0)),
        "top_gram": most(T.ngrams(F.col("_w"), n)),
    }).drop("_w")
