"""Queries for phrases, concepts, citations, claims and comparisons of texts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quaystone.operators import joins, lexical, retrieval
from quaystone.plans.evaluation import NEWEST, newest, r6
from quaystone.plans.registry import query
from quaystone.sources.tables import table

#: Patterns of the concepts that are looked for.
CONCEPTS = {"deadline": r"\bdeadlines?\b", "liquidity": r"\bliquidity\b", "model": r"\bmodel", "limit": r"\blimits?\b", "committee": r"\bcommittees?\b|\bpanel\b", "audit": r"\baudit", "number": r"[0-9]+%"}

_CASES = "c AS (SELECT DISTINCT id, query, candidate_answer, report_note FROM controlled_candidate_cases)"
_W = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+', 0))"


def cases(spark, d):
    return table(spark, d, "controlled_candidate_cases").select("id", "query", "candidate_answer", "report_note").distinct()


@query(f"""WITH {_CASES}, w AS (SELECT *, {_W.format('query')} AS pw, {_W.format('candidate_answer')} AS tw FROM c), n AS (SELECT *, len(pw) AS n, len(list_intersect(pw, tw)) AS h FROM w)
SELECT id, candidate_answer, coalesce(n > 0 AND (contains(lower(candidate_answer), lower(query)) OR h >= CASE WHEN n >= 12 THEN greatest(4, least(8, CAST(round_even(n * 0.35, 0) AS INT))) ELSE greatest(1, CAST(round_even(n * 0.6, 0) AS INT)) END), false) AS hit FROM n""")
def phrase_hits(spark, d):
    return cases(spark, d).select("id", "candidate_answer", lexical.phrase_hit(F.col("candidate_answer"), F.col("query")).alias("hit"))


@query(f"WITH {_CASES} SELECT id, candidate_answer, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(candidate_answer, '')), '{p}') THEN '{n}' END" for n, p in CONCEPTS.items()) + "], lambda x: x IS NOT NULL) AS concepts FROM c")
def concept_matches(spark, d):
    return lexical.concepts(cases(spark, d), "candidate_answer", CONCEPTS).select("id", "candidate_answer", "concepts")


def _concept_sql(col: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce({col}, '')), '{p}') THEN '{n}' END" for n, p in CONCEPTS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {_CASES}, k AS (SELECT id, {_concept_sql('query')} AS q, {_concept_sql('candidate_answer')} AS a FROM c) SELECT id, len(q) AS required, round(CASE WHEN len(q) = 0 THEN 1.0 ELSE len(list_intersect(q, a)) / len(q) END, 6) AS coverage FROM k")
def concept_coverage(spark, d):
    rows = lexical.concepts(cases(spark, d), "query", CONCEPTS).withColumnRenamed("concepts", "q")
    rows = lexical.concepts(rows, "candidate_answer", CONCEPTS)
    return rows.select("id", F.size("q").alias("required"), r6(lexical.coverage(F.col("q"), F.col("concepts")), "coverage"))


@query(f"WITH {_CASES}, k AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(coalesce(query, '')), '\\b(?:section|paragraph|item|article) [0-9]+(?:\\.[0-9]+)?', 0))) AS citation FROM c) SELECT DISTINCT id, citation FROM k")
def citation_scan(spark, d):
    return cases(spark, d).select("id", F.explode(lexical.citations(F.col("query"))).alias("citation")).distinct()


@query(f"""WITH {_CASES}, k AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(coalesce(query, '')), '\\b(?:section|paragraph|item|article) [0-9]+(?:\\.[0-9]+)?', 0)) AS citation FROM c),
p AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(coalesce(premise, '')), '\\b(?:section|paragraph|item|article) [0-9]+(?:\\.[0-9]+)?', 0)) AS citation FROM detector_eval_finreg_v1)
SELECT k.id AS case_id, p.id AS record_id, citation FROM k JOIN p USING (citation)""")
def citation_join(spark, d):
    spread = lambda df, c, n: df.select(F.col("id").alias(n), F.explode(lexical.citations(F.col(c))).alias("citation")).distinct()
    return spread(cases(spark, d), "query", "case_id").join(spread(table(spark, d, "detector_eval_finreg_v1"), "premise", "record_id"), "citation").select("case_id", "record_id", "citation")


_SQUEEZE = "trim(regexp_replace({0}, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g'), ' ')"


@query(f"""WITH {_CASES}, p AS (SELECT id, string_split(regexp_replace(regexp_replace({_SQUEEZE.format('candidate_answer')}, '([.!?]) +([A-Z])', '\\1' || chr(1) || '\\2', 'g'), '; | and ', chr(1), 'g'), chr(1)) AS ps FROM (SELECT DISTINCT id, candidate_answer FROM c) WHERE candidate_answer IS NOT NULL),
t AS (SELECT id, list_filter(list_transform(ps, lambda x: regexp_replace(trim(x, ' '), '[.!?;]+$', '') || '.'), lambda x: len(string_split(x, ' ')) >= 5)[1:6] AS cs FROM p)
SELECT id, i AS claim_no, cs[i] AS claim FROM t, unnest(range(1, len(cs) + 1)) u(i)""")
def claim_split(spark, d):
    return lexical.claims(cases(spark, d).select("id", "candidate_answer").distinct(), "id", "candidate_answer")


#: Rewrites that turn a statement against itself, tried in this order.
REWRITES = [(r"\bmust\b", "need not"), (r"\bshall\b", "need not"), (r"\bmay\b", "may not"), (r"\bcannot\b", "can"), (r"\bat least\b", "at most"), (r"\bafter\b", "before")]


@query("WITH r AS (SELECT DISTINCT id, premise FROM detector_eval_finreg_v1 WHERE premise IS NOT NULL) SELECT id, coalesce(" + ", ".join(f"CASE WHEN regexp_matches(premise, '{p}') THEN regexp_replace(premise, '{p}', '{t}') END" for p, t in REWRITES) + ") AS rewritten FROM r")
def first_rewrite(spark, d):
    rows = table(spark, d, "detector_eval_finreg_v1").where("premise is not null").select("id", "premise").distinct()
    return rows.select("id", lexical.first_rewrite(F.col("premise"), REWRITES).alias("rewritten"))


@query(f"""WITH {_CASES}, w AS (SELECT id, {_W.format('query')} AS a, {_W.format('candidate_answer')} AS b FROM c), f AS (SELECT id, CASE WHEN len(list_intersect(a, b)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END AS f1 FROM w)
SELECT CASE WHEN f1 = 0 THEN 'none' WHEN f1 < 0.2 THEN 'low' WHEN f1 < 0.5 THEN 'middle' ELSE 'high' END AS bucket, count(*) AS n, round(avg(f1), 6) AS f1 FROM f GROUP BY 1""")
def token_f1_buckets(spark, d):
    f1 = lexical.token_f1(F.col("query"), F.col("candidate_answer"))
    rows = cases(spark, d).select(f1.alias("f1"))
    bucket = F.when(F.col("f1") == 0, "none").when(F.col("f1") < 0.2, "low").when(F.col("f1") < 0.5, "middle").otherwise("high")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), r6(F.avg("f1"), "f1"))


@query(f"""WITH q AS (SELECT id, {_W.format('query')} AS ws FROM questions_finreg WHERE query IS NOT NULL), o AS (SELECT DISTINCT query AS old_id, {_W.format('query')} AS ws FROM controlled_candidate_cases WHERE query IS NOT NULL),
s AS (SELECT q.id, o.old_id, len(list_intersect(q.ws, o.ws)) / len(list_distinct(list_concat(q.ws, o.ws))) AS s FROM q, o WHERE len(list_intersect(q.ws, o.ws)) > 0)
SELECT id, old_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, old_id) AS n FROM s) WHERE n = 1""")
def most_similar_question(spark, d):
    old = table(spark, d, "controlled_candidate_cases").where("query is not null").select(F.col("query").alias("old_id"), "query").distinct()
    out = lexical.most_similar(table(spark, d, "questions_finreg").select("id", "query"), old, "id", "query", "old_id", "query")
    return out.select("id", "old_id", r6("similarity", "similarity"))


@query()
def unrelated_partners(spark, d):
    rows = table(spark, d, "detector_eval_finreg_v1").groupBy("id").agg(F.min("metadata.source_file").alias("file"), F.min("metadata.source_org").alias("org"), F.min("metadata.theme").alias("theme"))
    return lexical.ring_partners(rows.where("file is not null and org is not null and theme is not null"), "id", ["file", "org", "theme"])


@query(f"""WITH {NEWEST}, r AS (SELECT id, stats.answer_include_risk AS p FROM newest WHERE stats.answer_include_risk IS NOT NULL)
SELECT id, CAST(max(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS INT) AS any, CAST(avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) > 0.5 AS INT) AS majority, CAST(min(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS INT) AS all, round(avg(p), 6) AS mean,
round(list_avg(list_sort(list(p), 'DESC')[1:CAST(ceil(count(*) / 2) AS BIGINT)]), 6) AS top_half FROM r GROUP BY id""".replace(" AS all,", ' AS "all",').replace(" AS any,", ' AS "any",'))
def aggregation_modes(spark, d):
    rows = newest(spark, d, "id", "stats").select("id", F.col("stats.answer_include_risk").alias("p"))
    return lexical.decided(rows, "id", "p").select("id", "any", "majority", "all", r6("mean", "mean"), r6("top_half", "top_half"))


@query("""WITH o AS (SELECT source, title, year, doc_id, coalesce(year, CAST(page_count AS INT), -1) AS score FROM documents WHERE source IS NOT NULL)
SELECT source, doc_id, title, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS n FROM o) WHERE n = 1""")
def best_per_source(spark, d):
    score = F.coalesce("year", F.col("page_count").cast("int"), F.lit(-1))
    rows = table(spark, d, "documents").where("source is not null").select("source", "doc_id", "title", score.alias("score"))
    return rows.groupBy("source").agg(F.max_by(F.struct("doc_id", "title", "score"), F.struct("score", -F.col("doc_id"))).alias("x")).select("source", "x.*")


@query("""SELECT coalesce(jurisdiction, 'unknown') AS label, array_to_string(list_sort(list_distinct(list(CAST(year AS VARCHAR)) FILTER (year IS NOT NULL)))[1:3], ', ') || CASE WHEN count(DISTINCT year) > 3 THEN ' +' || CAST(count(DISTINCT year) - 3 AS VARCHAR) || ' more' ELSE '' END AS years, count(*) AS n FROM documents GROUP BY 1""")
def grouped_source_labels(spark, d):
    years = F.sort_array(F.collect_set(F.col("year").cast("string")))
    rows = table(spark, d, "documents").groupBy(F.coalesce("jurisdiction", F.lit("unknown")).alias("label")).agg(years.alias("ys"), F.count("*").alias("n"))
    more = F.when(F.size("ys") > 3, F.concat(F.lit(" +"), (F.size("ys") - 3).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return rows.select("label", F.concat(F.array_join(F.slice("ys", 1, 3), ", "), more).alias("years"), "n")


@query("""WITH o AS (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY id) AS pos FROM questions_finreg WHERE type IS NOT NULL) SELECT id, type, row_number() OVER (ORDER BY pos, type) AS number FROM o""")
def interleaved_groups(spark, d):
    """A question set is small by definition; one ordered numbering of it is one task's work."""
    rows = table(spark, d, "questions_finreg").where("type is not null").select("id", "type")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("type").orderBy("id")))
    return rows.select("id", "type", F.row_number().over(Window.orderBy("pos", "type")).alias("number"))


@query("""WITH s AS (SELECT doc_id, i, p[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL), unnest(range(1, len(p) + 1)) u(i)),
k AS (SELECT *, TRY_CAST(nullif(regexp_extract(line, '^ *Page ([0-9]+)', 1), '') AS INT) AS mark FROM s)
SELECT doc_id, page, count(*) AS lines FROM (SELECT doc_id, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS page FROM k) WHERE page IS NOT NULL GROUP BY 1, 2""")
def carried_page_numbers(spark, d):
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    mark = F.nullif(F.regexp_extract("line", "^ *Page ([0-9]+)", 1), F.lit("")).cast("int")
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("page", F.last(mark, ignorenulls=True).over(so_far)).where("page is not null").groupBy("doc_id", "page").agg(F.count("*").alias("lines"))


@query(f"""WITH {NEWEST}, o AS (SELECT id, started_at, detail_no, action FROM newest WHERE id IS NOT NULL)
SELECT detail_no, concat_ws(' ', lag(action) OVER w, action, lead(action) OVER w) AS actions FROM o WINDOW w AS (PARTITION BY id ORDER BY detail_no)""")
def neighbour_context(spark, d):
    rows = newest(spark, d, "id", "action").where("id is not null")
    return joins.neighbours(rows, "id", "detail_no", "action", "actions").select("detail_no", "actions")


@query(f"""WITH {NEWEST}, b AS (SELECT id, action, detail_no, sum(k_used) OVER (PARTITION BY id ORDER BY detail_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM newest WHERE id IS NOT NULL)
SELECT id, count(*) AS kept FROM b WHERE coalesce(before, 0) < 40 GROUP BY 1""")
def running_budget(spark, d):
    rows = newest(spark, d, "id", "k_used").where("id is not null")
    return joins.running_before(rows, "id", "detail_no", "k_used", "before").where("before < 40").groupBy("id").agg(F.count("*").alias("kept"))


@query("""WITH b AS (SELECT unnest(['entailment', 'neutral', 'contradiction', 'absent']) AS bucket), s AS (SELECT bucket, i AS slot FROM b, range(1, 5 + 1) r(i)),
o AS (SELECT lower(label) AS bucket, id, row_number() OVER (PARTITION BY lower(label) ORDER BY id) AS slot FROM (SELECT id, min(label) AS label FROM detector_eval_finreg_v1 GROUP BY id))
SELECT s.bucket, s.slot, coalesce(o.id, 'placeholder') AS id FROM s LEFT JOIN o USING (bucket, slot)""")
def buckets_with_placeholders(spark, d):
    names = spark.createDataFrame([(b,) for b in ("entailment", "neutral", "contradiction", "absent")], "bucket string")
    slots = names.select("bucket", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("slot"))
    rows = table(spark, d, "detector_eval_finreg_v1").groupBy("id").agg(F.lower(F.min("label")).alias("bucket"))
    ranked = retrieval.top_k(rows.where("bucket is not null"), "bucket", ["id"], 5, "slot")
    return slots.join(ranked, ["bucket", "slot"], "left").select("bucket", "slot", F.coalesce("id", F.lit("placeholder")).alias("id"))
