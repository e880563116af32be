"""Curation of texts and rows: claims, sentences, families, formats and artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quaystone.operators.reports import lexical_overlap


def tokens(c, least: int = 3) -> Column:
    """Distinct lower-case ASCII words of ``least`` letters or more; none for null."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= least))


def claim_support(rows: DataFrame, by: str, text: str, evidence: str, least: float = 0.35) -> DataFrame:
    """One row a text: its claims, mean and least support by the evidence, and how many lie below ``least``.

    Claims are what stands between semicolons, full stops and blanks, with a word.
    """
    claims = F.filter(F.split(F.coalesce(text, F.lit("")), r"[;.] +"), lambda c: F.size(tokens(c)) > 0)
    support = F.transform(claims, lambda c: lexical_overlap(tokens(F.col(evidence)), tokens(c)))
    out = rows.select(by, support.alias("_s"))
    total = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x)
    return out.select(by, F.size("_s").alias("claims"), F.try_divide(total, F.size("_s").cast("double")).alias("mean_support"), F.array_min("_s").alias("least_support"), F.size(F.filter("_s", lambda x: x < least)).alias("unsupported"))


def top_sentences(sents: DataFrame, by: str, sentence: str, keywords: list[str], n: int) -> DataFrame:
    """``n`` sentences a document: the best 3n by (keywords held, length), of which the first by hash."""
    score = sum((F.lower(sentence).contains(k).cast("int") for k in keywords), F.lit(0))
    scored = sents.withColumn("score", score)
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.desc(F.length(sentence)), sentence))).where(F.col("_n") <= 3 * n)
    return best.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.md5(sentence), sentence))).where(F.col("_n") <= n).drop("_n")


def best_claim(rows: DataFrame, by: str, claim: str, score: str) -> DataFrame:
    """The claim of each passage with the largest (score, length, text)."""
    best = F.max(F.struct(F.col(score).alias("score"), F.length(claim).alias("length"), F.col(claim).alias("claim")))
    return rows.groupBy(by).agg(best.alias("x")).select(by, "x.claim", "x.score")


def last_wins(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value): the value of the last row in ``order``."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, value)).alias("x")).select(key, F.col("x")[value].alias(value))


def family(fields: list, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """The name of the first rule that matches the first field any rule matches."""
    out = F.lit(None).cast("string")
    for c in reversed(fields):
        own = F.lit(None).cast("string")
        for pattern, name in reversed(rules):
            own = F.when(F.lower(c).rlike(pattern), name).otherwise(own)
        out = F.coalesce(own, out)
    return F.coalesce(out, F.lit(default))


def header(**parts) -> Column:
    """``name: value`` pairs joined by semicolons, those without a value left out."""
    return F.concat_ws("; ", *[F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in parts.items()])


def short_circuit(first, confidence, least: float, second) -> Column:
    """The first verdict where it is sure enough, else the second."""
    return F.when(confidence >= least, first).otherwise(second)


def holds_phrase(text, phrase: str) -> Column:
    """Whether the phrase stands in the text as whole words, case ignored."""
    import re

    return F.coalesce(F.lower(text).rlike(r"(^|[^a-z0-9])" + re.escape(phrase.lower()) + r"($|[^a-z0-9])"), F.lit(False))


def load_each(spark: SparkSession, paths: list[str], loader) -> tuple[DataFrame | None, dict[str, str]]:
    """Documents of every path that can be read, and the error of each that can't; one bad path stops no other."""
    out, failed = None, {}
    for path in paths:
        try:
            df = loader(spark, path)
            df.limit(1).collect()
        except Exception as e:  # the reader's own error is the result
            failed[path] = type(e).__name__
            continue
        out = df if out is None else out.unionByName(df)
    return out, failed


def artefacts(docs: DataFrame, path: str, family_col: str, id_col: str, text_col: str, meta: list[str]) -> DataFrame:
    """Writes texts and metadata under one folder a family and returns the manifest (family, files, rows)."""
    kept = docs.withColumn("_family", F.coalesce(F.col(family_col), F.lit("unknown")))
    kept.select("_family", id_col, text_col).write.mode("overwrite").partitionBy("_family").parquet(f"{path}/text")
    kept.select("_family", id_col, *meta).write.mode("overwrite").partitionBy("_family").json(f"{path}/metadata")
    back = docs.sparkSession.read.parquet(f"{path}/text").select(F.col("_family").cast("string").alias("family"), F.col("_metadata.file_path").alias("file"))
    return back.groupBy("family").agg(F.count("*").alias("rows"), F.countDistinct("file").alias("files"))


def markdown(rows: DataFrame, columns: list[str], order: list[str], title: str) -> DataFrame:
    """One row: a small aggregate as a Markdown table. Its rows meet in one task, as a report's do."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    head = "\n".join([f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n")
    return rows.agg(F.concat(F.lit(head + "\n"), body).alias("markdown"))


def double_encoded(lines: DataFrame, col: str, schema: str) -> DataFrame:
    """Objects of lines that hold a JSON text of a JSON text; a line that is none gives no row."""
    inner = F.get_json_object(F.concat(F.lit('{"v":'), F.col(col), F.lit("}")), "$.v")
    return lines.select(F.from_json(inner, schema).alias("x")).where("x is not null").select("x.*")
