"""Queries that reshape records and compare settings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quaystone.operators import reshape
from quaystone.plans.evaluation import NEWEST, newest, r6
from quaystone.plans.registry import query
from quaystone.plans.retrieval import _BM25, _bm25
from quaystone.session import checkpoint_dir
from quaystone.sources.tables import table


@query("""SELECT id, CASE WHEN l IN ('entailment', 'entail', 'supported', 'support', 'included', '0') THEN 'entailment' WHEN l IN ('neutral', 'unsupported', 'not_enough_info', 'nei', 'partial', '1') THEN 'neutral'
WHEN l IN ('contradiction', 'contradict', 'contradicted', 'refuted', 'not_included', '2') THEN 'contradiction' END AS label FROM (SELECT DISTINCT id, regexp_replace(lower(trim(label)), '[ -]+', '_', 'g') AS l FROM detector_eval_finreg_v1)""")
def canonical_labels(spark, d):
    rows = table(spark, d, "detector_eval_finreg_v1").select("id", F.regexp_replace(F.lower(F.trim("label")), "[ -]+", "_").alias("l")).distinct()
    return rows.select("id", reshape.canonical_label(F.col("l")).alias("label"))


@query("SELECT DISTINCT id, coalesce(metadata.theme, 'none') AS theme, metadata.pair_type AS pair_type FROM detector_eval_finreg_v1")
def nested_update(spark, d):
    rows = reshape.with_nested(table(spark, d, "detector_eval_finreg_v1"), "metadata.theme", F.coalesce("metadata.theme", F.lit("none")))
    return rows.select("id", F.col("metadata.theme").alias("theme"), F.col("metadata.pair_type").alias("pair_type")).distinct()


@query(f"WITH {NEWEST} SELECT detail_no, CAST(floor(u_epi * 1000) AS DOUBLE) AS e, CAST(floor(u_ale * 1000) AS DOUBLE) AS n FROM newest WHERE u_epi IS NOT NULL AND u_ale IS NOT NULL")
def score_text_parse(spark, d):
    rows = newest(spark, d, "u_epi", "u_ale").where("u_epi is not null and u_ale is not null")
    made = rows.select("detail_no", F.format_string("E=%d | N=%d", F.floor(F.col("u_epi") * 1000), F.floor(F.col("u_ale") * 1000)).alias("t"))
    return made.select("detail_no", reshape.scores(F.col("t")).alias("m")).select("detail_no", F.col("m")["E"].alias("e"), F.col("m")["N"].alias("n"))


@query(f"""WITH {_BM25}, j AS (SELECT br.id, rank, substring(text, 1, 650) AS p FROM br JOIN documents USING (doc_id) WHERE rank <= 4), b AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM j)
SELECT id, md5(string_agg('[' || CAST(rank AS VARCHAR) || '] ' || substring(p, 1, CAST(2600 - b AS BIGINT)), chr(10) ORDER BY rank)) AS digest, count(*) AS n FROM b WHERE b < 2600 GROUP BY 1""")
def packed_contexts(spark, d):
    hits = _bm25(spark, d).where("rank <= 4").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return reshape.packed_contexts(hits, "id", "rank", "text").select("id", F.md5("packed").alias("digest"), "n")


@query("""WITH c AS (SELECT id, count(*) AS c FROM controlled_candidate_cases GROUP BY 1) SELECT count(*) AS n, (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM c) AS repeated_ids, count(*) FILTER (NOT coalesce(length(candidate_answer) > 0, false)) AS failed_answer,
count(*) FILTER (NOT coalesce(expected IN ('included', 'not_included'), false)) AS failed_expected FROM controlled_candidate_cases""")
def validation_report(spark, d):
    rows = table(spark, d, "controlled_candidate_cases").select("id", "candidate_answer", "expected")
    checks = {"answer": F.length("candidate_answer") > 0, "expected": F.col("expected").isin("included", "not_included")}
    return reshape.report(rows, "id", checks).drop("valid")


@query("""WITH t AS (SELECT DISTINCT jurisdiction, source_org FROM source_orgs) SELECT a.jurisdiction, a.source_org AS a, b.source_org AS b FROM t a JOIN t b ON a.jurisdiction = b.jurisdiction AND a.source_org < b.source_org""")
def source_pairs(spark, d):
    return reshape.unordered_pairs(table(spark, d, "source_orgs"), "jurisdiction", "source_org")


@query(f"""WITH {NEWEST}, p AS (SELECT id, avg(u_epi) FILTER (attempts = 1) AS a, avg(u_epi) FILTER (attempts > 1) AS b FROM newest GROUP BY 1)
SELECT id, round(b - a, 6) AS delta, (a >= 0.3) <> (b >= 0.3) AS flipped, least(abs(a - 0.3), abs(b - 0.3)) <= 0.05 AS near FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def setting_sensitivity(spark, d):
    rows = newest(spark, d, "id", "attempts", "u_epi").groupBy("id").agg(F.avg(F.when(F.col("attempts") == 1, F.col("u_epi"))).alias("a"), F.avg(F.when(F.col("attempts") > 1, F.col("u_epi"))).alias("b"))
    out = reshape.sensitivity(rows.where("a is not null and b is not null"), "a", "b", 0.3)
    return out.select("id", r6("delta", "delta"), "flipped", "near")


@query()
def weighted_sample(spark, d):
    return reshape.weighted_sample(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 100, "c_custkey")


@query("SELECT run_name AS run, count(*) AS n FROM gate_details WHERE run_name IS NOT NULL GROUP BY 1")
def scan_runs_by_file_name(spark, d):
    """Run files named after their run, read back with the run taken from the file name."""
    root = f"{checkpoint_dir(spark)}/quaystone-runs-{uuid.uuid4().hex}"
    rows = table(spark, d, "gate_details").where("run_name is not null").select("run_name", "detail_no")
    rows.withColumn("run", F.col("run_name")).write.partitionBy("run").parquet(root)
    back = spark.read.schema("run_name string, detail_no bigint").option("recursiveFileLookup", "true").parquet(root)
    named = back.select("detail_no", F.regexp_extract(F.col("_metadata.file_path"), r"/run=([^/]+)/", 1).alias("run"))
    return named.groupBy("run").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders")
def ordinal_positions(spark, d):
    return reshape.numbered(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "ordinal")
