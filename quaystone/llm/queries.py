"""The pN_ queries over the test tables; each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quaystone.llm import boilerplate, langid, latent, leakage, nearjoin, ocr, packing, pairs, sentences, splits, splitting, sql, tokenize
from quaystone.session import materialise
from quaystone.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = splits.record_groups(table(spark, sf_dir, "detector_eval_finreg_v1"), table(spark, sf_dir, "source_orgs"))
    return groups.where("group is not null").select("id", "group_org_id").distinct()


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.splits(table(spark, sf_dir, "detector_eval_finreg_v1"), table(spark, sf_dir, "source_orgs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no").distinct()


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return boilerplate.without_lines(docs, boilerplate.repeated_lines(docs))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"detector_eval_finreg_v1": "premise", "controlled_candidate_cases": "query"}
    rows = [table(spark, sf_dir, t).select(F.lit(t).alias("part"), "id", F.col(c).alias("text")) for t, c in texts.items()]
    members, classes, pairs = nearjoin.near_duplicates(rows[0].union(rows[1]), threshold=0.7)
    return nearjoin.id_pairs(members, classes, pairs).withColumnRenamed("part", "table_name")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = langid.fit(table(spark, sf_dir, "documents"))
    return pairs.defects(table(spark, sf_dir, "controlled_candidate_cases"), langs).select("id", "defect")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.kinds(table(spark, sf_dir, "documents")).distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = ocr.repaired(table(spark, sf_dir, "documents"))
    return fixed.select("doc_id", F.explode("lines").alias("x")).select("doc_id", "x.line_no", "x.kind").distinct()


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.repaired(table(spark, sf_dir, "documents")).select("doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "detector_eval_finreg_v1"))


def p7_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated query set: every record whose number is divisible by 20, against all documents."""
    records = table(spark, sf_dir, "detector_eval_finreg_v1").where(F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint") % 20 == 0)
    queries = records.select("id", F.explode(F.array("premise", "hypothesis")).alias("text"))
    return latent.similar_passages(table(spark, sf_dir, "documents"), queries)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.token_ids(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialise(tokenize.token_counts(table(spark, sf_dir, "documents")), "sizes")
    return packing.containers(sized)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fitted = sentences.models(docs, "doc_id", "text")
    checked = table(spark, sf_dir, "sentence_check").select("doc_id").distinct()
    return sentences.sentences(docs.join(checked, "doc_id", "left_semi"), fitted=fitted).distinct()


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
