"""Queries that curate texts and rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.operators import chunking, curation
from quaystone.plans import evaluation, texts
from quaystone.plans.datasets import _write_lines
from quaystone.plans.evaluation import NEWEST, newest, r6
from quaystone.plans.files import _folder
from quaystone.plans.registry import query
from quaystone.sources import files as sources
from quaystone.sources.tables import table

_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+', 0), lambda t: length(t) >= 3))"


@query(f"""WITH c AS (SELECT DISTINCT id, candidate_answer, {_TOKENS.format("coalesce(query, '')")} AS e FROM controlled_candidate_cases), s AS (SELECT id, e, list_filter(regexp_split_to_array(coalesce(candidate_answer, ''), '[;.] +'), lambda x: len({_TOKENS.format('x')}) > 0) AS cs FROM c),
v AS (SELECT id, list_transform(cs, lambda x: len(list_intersect(e, {_TOKENS.format('x')})) / len({_TOKENS.format('x')})) AS s FROM s)
SELECT id, len(s) AS claims, round(list_avg(s), 6) AS mean_support, round(list_min(s), 6) AS least_support, len(list_filter(s, lambda x: x < 0.35)) AS unsupported FROM v""")
def claim_support(spark, d):
    rows = table(spark, d, "controlled_candidate_cases").select("id", "candidate_answer", "query").distinct()
    return curation.claim_support(rows, "id", "candidate_answer", "query").select("id", "claims", r6("mean_support", "mean_support"), r6("least_support", "least_support"), "unsupported")


_KEYWORDS = ["must", "limit", "review", "risk"]
_SCORE = " + ".join(f"CASE WHEN contains(lower(s), '{k}') THEN 1 ELSE 0 END" for k in _KEYWORDS)


@query(f"""WITH {texts._SENTENCES}, c AS (SELECT doc_id, s, {_SCORE} AS score FROM sents WHERE length(s) BETWEEN 40 AND 400), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(s) DESC, s) AS n FROM c), h AS (SELECT doc_id, s, score, row_number() OVER (PARTITION BY doc_id ORDER BY md5(s), s) AS m FROM b WHERE n <= 6)
SELECT doc_id, md5(s) AS digest, score FROM h WHERE m <= 2""")
def top_sentences(spark, d):
    sents = chunking.sentences(texts.docs(spark, d)).where(F.length("sentence").between(40, 400))
    return curation.top_sentences(sents, "doc_id", "sentence", _KEYWORDS, 2).select("doc_id", F.md5("sentence").alias("digest"), "score")


@query(f"""WITH {texts._SENTENCES}, c AS (SELECT doc_id, s, {_SCORE} AS score FROM sents WHERE s <> ''), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(s) DESC, s DESC) AS n FROM c) SELECT doc_id, md5(s) AS digest, score FROM b WHERE n = 1""")
def best_claims(spark, d):
    score = sum((F.lower("sentence").contains(k).cast("int") for k in _KEYWORDS), F.lit(0))
    return curation.best_claim(chunking.sentences(texts.docs(spark, d)).withColumn("score", score), "doc_id", "sentence", "score").select("doc_id", F.md5("claim").alias("digest"), "score")


@query("WITH o AS (SELECT id, query, row_number() OVER (PARTITION BY id ORDER BY received_at DESC, detail_no DESC, query DESC NULLS LAST) AS n FROM gate_details WHERE id IS NOT NULL) SELECT id, query FROM o WHERE n = 1")
def last_query_of_id(spark, d):
    return curation.last_wins(table(spark, d, "gate_details"), "id", "query", ["received_at", "detail_no"])


_RULES = [("guideline|handbook", "guidance"), ("consult", "consultation"), ("scan|archive", "archive"), ("html|web", "web")]
_CASE = lambda c: "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{p}') THEN '{n}'" for p, n in _RULES) + " END"


@query(f"SELECT coalesce({_CASE('document_type')}, {_CASE('title')}, {_CASE('source_type')}, 'other') AS family, count(*) AS n FROM documents GROUP BY 1")
def source_families(spark, d):
    rows = table(spark, d, "documents").select("document_type", "title", "source_type")
    return rows.groupBy(curation.family([F.col("document_type"), F.col("title"), F.col("source_type")], _RULES).alias("family")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, concat_ws('; ', CASE WHEN title <> '' THEN 'title: ' || title END, CASE WHEN year IS NOT NULL THEN 'year: ' || year END, CASE WHEN jurisdiction <> '' THEN 'jurisdiction: ' || jurisdiction END) AS header FROM documents""")
def context_headers(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "title", "year", "jurisdiction")
    return rows.select("doc_id", curation.header(title=F.col("title"), year=F.col("year"), jurisdiction=F.col("jurisdiction")).alias("header"))


@query(f"""WITH {NEWEST} SELECT detail_no, CASE WHEN low_confidence >= 0.5 THEN action ELSE evidence_sampling_gate.policy_action END AS verdict FROM newest""")
def short_circuit(spark, d):
    rows = newest(spark, d, "low_confidence", "action", "evidence_sampling_gate")
    return rows.select("detail_no", curation.short_circuit(F.col("action"), F.col("low_confidence"), 0.5, F.col("evidence_sampling_gate.policy_action")).alias("verdict"))


_PHRASES = ("management body", "second line", "credit institution", "at")


@query("SELECT phrase, count(*) FILTER (hit) AS documents FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS phrase, coalesce(regexp_matches(lower(text), '(^|[^a-z0-9]){p}($|[^a-z0-9])'), false) AS hit FROM documents" for p in _PHRASES) + ") GROUP BY 1")
def whole_word_phrases(spark, d):
    hits = F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), curation.holds_phrase(F.col("text"), p).alias("hit")) for p in _PHRASES])).alias("x")
    return table(spark, d, "documents").select(hits).groupBy("x.phrase").agg(F.count_if("x.hit").alias("documents"))


@query("SELECT count(*) AS documents, 1 AS failed FROM source_orgs")
def failure_isolation(spark, d):
    """Three paths, one of which is not there: the others are read all the same."""
    good = _write_lines(spark, d, "isolated", F.col("org_name"))
    docs, failed = curation.load_each(spark, [good, good + "-missing"], lambda s, p: sources.text(s, p, "line"))
    return docs.agg(F.count("*").alias("documents")).select("documents", F.lit(len(failed)).alias("failed"))


@query("SELECT coalesce(document_type, 'unknown') AS family, count(*) AS rows FROM documents GROUP BY 1")
def document_artefacts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "document_type", "title", "year")
    return curation.artefacts(docs, _folder(spark, "artefacts"), "document_type", "doc_id", "text", ["title", "year"]).select("family", "rows")


@query(f"""WITH {NEWEST}, a AS (SELECT coalesce(action, 'unknown') AS action, count(*) AS n FROM newest GROUP BY 1) SELECT '# Gate runs' || chr(10) || chr(10) || '| action | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || action || ' | ' || n || ' |', chr(10) ORDER BY action) AS markdown FROM a""")
def markdown_report(spark, d):
    rows = newest(spark, d, "action").groupBy(F.coalesce("action", F.lit("unknown")).alias("action")).agg(F.count("*").alias("n"))
    return curation.markdown(rows, ["action", "n"], ["action"], "Gate runs")


@query("SELECT source_org AS code, org_name AS name FROM source_orgs WHERE org_id % 5 <> 0")
def double_encoded_scan(spark, d):
    line = F.to_json(F.struct(F.to_json(F.struct(F.col("source_org").alias("code"), F.col("org_name").alias("name"))).alias("v")))
    line = F.regexp_extract(line, r'^\{"v":(.*)\}$', 1)
    path = _write_lines(spark, d, "double", F.when(F.col("org_id") % 5 == 0, "no json").otherwise(line))
    return curation.double_encoded(spark.read.text(path), "value", "code string, name string")


@query("""WITH d AS (SELECT DISTINCT id, premise, hypothesis, lower(label) AS label, metadata.theme AS theme FROM detector_eval_finreg_v1) SELECT id, 'Question: ' || coalesce(theme, '') || ' Answer: ' || coalesce(hypothesis, '') AS hypothesis, CASE label WHEN 'entailment' THEN 0 WHEN 'neutral' THEN 1 WHEN 'contradiction' THEN 2 END AS label FROM d""")
def detector_rows(spark, d):
    rows = table(spark, d, "detector_eval_finreg_v1").select("id", "premise", "hypothesis", F.lower("label").alias("label"), F.col("metadata.theme").alias("theme")).distinct()
    number = F.when(F.col("label") == "entailment", 0).when(F.col("label") == "neutral", 1).when(F.col("label") == "contradiction", 2)
    text = F.concat(F.lit("Question: "), F.coalesce("theme", F.lit("")), F.lit(" Answer: "), F.coalesce("hypothesis", F.lit("")))
    return rows.select("id", text.alias("hypothesis"), number.alias("label"))


@query(f"""WITH {NEWEST} SELECT coalesce(run_name, 'unknown') AS run_name, count(*) AS n, round(avg((1 - stats.answer_include_risk) - stats.hard_contradiction_rate), 6) AS margin, round(avg(abs(u_epi - u_ale)), 6) AS gap FROM newest GROUP BY 1""")
def derived_margins(spark, d):
    rows = newest(spark, d, "run_name", "stats", "u_epi", "u_ale")
    margin = (1 - F.col("stats.answer_include_risk")) - F.col("stats.hard_contradiction_rate")
    return rows.groupBy(F.coalesce("run_name", F.lit("unknown")).alias("run_name")).agg(F.count("*").alias("n"), r6(F.avg(margin), "margin"), r6(F.avg(F.abs(F.col("u_epi") - F.col("u_ale"))), "gap"))


@query("""WITH r AS (SELECT DISTINCT id, lower(coalesce(label, 'unknown')) AS label, metadata.pair_type AS pair_type, coalesce(length(hypothesis), 0) AS n FROM detector_eval_finreg_v1) SELECT label, coalesce(pair_type, 'unknown') AS pair_type, CASE WHEN n < 80 THEN 'short' WHEN n < 160 THEN 'middle' ELSE 'long' END AS size, count(*) AS rows, count(DISTINCT id) AS ids FROM r GROUP BY 1, 2, 3""")
def mixed_statistics(spark, d):
    rows = table(spark, d, "detector_eval_finreg_v1").select("id", F.lower(F.coalesce("label", F.lit("unknown"))).alias("label"), F.col("metadata.pair_type").alias("pair_type"), F.coalesce(F.length("hypothesis"), F.lit(0)).alias("n")).distinct()
    size = F.when(F.col("n") < 80, "short").when(F.col("n") < 160, "middle").otherwise("long")
    return rows.groupBy("label", F.coalesce("pair_type", F.lit("unknown")).alias("pair_type"), size.alias("size")).agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"))


_MARK = "^(Page|Seite) [0-9]+$"


@query(texts.section_blocks_sql(_MARK))
def section_blocks_with_pages(spark, d):
    blocks = chunking.sections(texts.docs(spark, d), page=_MARK)
    return blocks.select("doc_id", "block_no", "page", "heading", F.md5("block").alias("digest"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(range(0, length(text), 350), lambda i: substring(text, CAST(i + 1 AS BIGINT), 400)), lambda c: """ + texts._STRIP.format("c") + """ <> '') AS cs FROM documents WHERE length(text) > 0)
SELECT doc_id, i - 1 AS chunk_index, md5(cs[i]) AS digest FROM s, unnest(range(1, len(cs) + 1)) u(i)""")
def small_chunks(spark, d):
    return chunking.by_strategy(texts.docs(spark, d), "fixed_small", 512, 50).select("doc_id", "chunk_index", F.md5("chunk").alias("digest"))
