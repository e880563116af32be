"""Queries for reports, audits, rankings and lookups."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quaystone.operators import metrics, reports, sampling
from quaystone.plans import evaluation, retrieval as found
from quaystone.plans.evaluation import GRID, NEWEST, newest, r6
from quaystone.plans.registry import query
from quaystone.sources.tables import table

_BLANK = "[ \\t\\n\\r\\x0B\\f]"


@query(evaluation._JUDGED + """, l AS (SELECT unnest(['entailment', 'neutral', 'contradiction']) AS label), v AS (SELECT * FROM w WHERE expected IS NOT NULL),
c AS (SELECT label, count(*) FILTER (expected = label) AS s, count(*) FILTER (predicted = label) AS p, count(*) FILTER (expected = label AND predicted = label) AS tp FROM l, v GROUP BY 1),
r AS (SELECT s, coalesce(tp / nullif(p, 0), 0) AS pr, coalesce(tp / nullif(s, 0), 0) AS re, coalesce(2 * tp / nullif(p + s, 0), 0) AS f1 FROM c WHERE s + p > 0)
SELECT CAST(sum(s) AS BIGINT) AS n, round(sum(re * s) / sum(s), 6) AS accuracy, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
round(sum(pr * s) / sum(s), 6) AS weighted_precision, round(sum(re * s) / sum(s), 6) AS weighted_recall, round(sum(f1 * s) / sum(s), 6) AS weighted_f1 FROM r""")
def classification_summary(spark, d):
    out = reports.classification_summary(metrics.class_report(metrics.confusion(evaluation._judged(spark, d), "expected", "predicted")))
    return out.select("n", *[r6(c, c) for c in out.columns if c != "n"])


@query(evaluation._JUDGED + """, v AS (SELECT expected = predicted AS same, expected = 'entailment' AS yes, predicted = 'entailment' AS said FROM w WHERE expected IS NOT NULL)
SELECT count(*) AS n, round(count(*) FILTER (same) / count(*), 6) AS accuracy, round(count(*) FILTER (yes = said) / count(*), 6) AS binary_accuracy, round(count(*) FILTER (same AND NOT yes) / nullif(count(*) FILTER (NOT yes), 0), 6) AS negative_accuracy,
round(count(*) FILTER (said AND NOT yes) / nullif(count(*) FILTER (NOT yes), 0), 6) AS false_include_rate, round(count(*) FILTER (NOT said AND yes) / nullif(count(*) FILTER (yes), 0), 6) AS false_exclude_rate,
round(count(*) FILTER (NOT yes AND NOT said) / nullif(count(*) FILTER (NOT said), 0), 6) AS not_included_precision, round(count(*) FILTER (NOT said AND NOT yes) / nullif(count(*) FILTER (NOT yes), 0), 6) AS not_included_recall FROM v""")
def inclusion_summary(spark, d):
    out = reports.inclusion_summary(evaluation._judged(spark, d), "expected", "predicted", "entailment")
    return out.select("n", *[r6(c, c) for c in out.columns if c != "n"])


@query(f"""WITH {NEWEST}, k AS (SELECT u_epi AS s, CASE WHEN action <> 'answer' THEN 1 ELSE 0 END AS y FROM newest WHERE u_epi IS NOT NULL AND action IS NOT NULL),
g AS (SELECT unnest([{', '.join(f'CAST({t} AS DOUBLE)' for t in GRID)}]) AS threshold), c AS (SELECT threshold, count(*) FILTER (s >= threshold AND y = 1) AS tp, count(*) FILTER (s >= threshold AND y = 0) AS fp, count(*) FILTER (s < threshold AND y = 1) AS fn FROM k, g GROUP BY 1),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM c),
t AS (SELECT *, CASE WHEN p >= 0.6 AND r >= 0.6 THEN 0 WHEN p >= 0.6 THEN 1 ELSE 2 END AS tier FROM m) SELECT threshold, tier, tp, fp, round(f, 6) AS f1 FROM t ORDER BY tier, f DESC, r DESC, threshold LIMIT 1""")
def operating_point(spark, d):
    rows = newest(spark, d, "u_epi", "action").withColumn("y", (F.col("action") != "answer").cast("int"))
    return reports.operating_point(metrics.threshold_sweep(rows, "u_epi", "y", GRID), 0.6, 0.6).select("threshold", "tier", "tp", "fp", r6("f1", "f1"))


@query(f"WITH {found._BM25} SELECT id, list(doc_id ORDER BY rank) AS keys, count(*) AS n, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score FROM br GROUP BY 1")
def retrieval_rows(spark, d):
    return reports.retrieval_rows(found._bm25(spark, d), "id", "doc_id").select("id", "keys", "n", r6("max_score", "max_score"), r6("mean_score", "mean_score"))


@query(f"WITH {found._BM25}, q AS (SELECT DISTINCT id FROM questions_finreg), s AS (SELECT id, max(score) AS m, avg(score) AS a, count(*) AS n FROM br WHERE rank <= 5 GROUP BY 1) SELECT q.id, round(coalesce(m, 0), 6) AS max_score, round(coalesce(a, 0), 6) AS mean_score, coalesce(n, 0) AS n FROM q LEFT JOIN s USING (id)")
def retrieval_stats(spark, d):
    out = reports.retrieval_stats(table(spark, d, "questions_finreg"), found._bm25(spark, d).where("rank <= 5"), "id")
    return out.select("id", r6("max_score", "max_score"), r6("mean_score", "mean_score"), "n")


@query(f"WITH {found._BM25} SELECT id, count(*) AS hits, count(DISTINCT doc_id) AS keys, count(DISTINCT source) AS n_source, count(DISTINCT jurisdiction) AS n_jurisdiction FROM br JOIN documents USING (doc_id) GROUP BY 1")
def retrieval_audit(spark, d):
    hits = found._bm25(spark, d).join(table(spark, d, "documents").select("doc_id", "source", "jurisdiction"), "doc_id")
    return reports.retrieval_audit(hits, "id", "doc_id", ["source", "jurisdiction"])


@query(f"""WITH {NEWEST}, k AS (SELECT coalesce(type, 'unknown') AS type, action AS a, evidence_sampling_gate.policy_action AS b FROM newest) SELECT type, count(*) AS n, count(*) FILTER (a = b) AS agreed, round(count(*) FILTER (a = b) / count(*), 6) AS rate FROM k WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def action_agreement(spark, d):
    rows = newest(spark, d, "type", "action", "evidence_sampling_gate").select(F.coalesce("type", F.lit("unknown")).alias("type"), "action", F.col("evidence_sampling_gate.policy_action").alias("other"))
    return reports.agreement(rows, "type", "action", "other").select("type", "n", "agreed", r6("rate", "rate"))


_FLAGS = {"short": "length(hypothesis) < 90", "figures": "regexp_matches(hypothesis, '[0-9]')", "negated": "regexp_matches(lower(hypothesis), '(^|[^a-z])not([^a-z]|$)')"}


def _flags():
    h = F.col("hypothesis")
    return {"short": F.length(h) < 90, "figures": h.rlike("[0-9]"), "negated": F.lower(h).rlike("(^|[^a-z])not([^a-z]|$)")}


_UNPIVOTED = "r AS (SELECT DISTINCT id, lower(coalesce(label, 'unknown')) AS label, hypothesis FROM detector_eval_finreg_v1), f AS (" + " UNION ALL ".join(f"SELECT id, label, '{k}' AS flag, coalesce({v}, false) AS s FROM r" for k, v in _FLAGS.items()) + ")"


def _hypotheses(spark, d):
    return table(spark, d, "detector_eval_finreg_v1").select("id", F.lower(F.coalesce("label", F.lit("unknown"))).alias("label"), "hypothesis").distinct()


@query(f"""WITH {_UNPIVOTED}, e AS (SELECT label, flag, string_agg(id, ' ' ORDER BY id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY label, flag ORDER BY id) AS n FROM f WHERE s) WHERE n <= 5 GROUP BY 1, 2)
SELECT f.label, f.flag, count(*) AS n, count(*) FILTER (s) AS flagged, round(count(*) FILTER (s) / count(*), 6) AS rate, any_value(e.examples) AS examples FROM f LEFT JOIN e ON e.label = f.label AND e.flag = f.flag GROUP BY 1, 2""")
def flag_summary(spark, d):
    return reports.flag_summary(_hypotheses(spark, d), "label", _flags(), "id").select("label", "flag", "n", "flagged", r6("rate", "rate"), "examples")


@query(f"""WITH {NEWEST}, k AS (SELECT coalesce(type, 'unknown') AS type, coalesce(action, 'unknown') AS action, coalesce(run_name, 'unknown') AS run_name FROM newest) SELECT type, action, run_name, count(*) AS n FROM k GROUP BY CUBE (type, action, run_name)""")
def cube_counts(spark, d):
    return reports.cube_counts(newest(spark, d, "type", "action", "run_name"), ["type", "action", "run_name"])


_VECTOR = """v AS (SELECT detail_no, 1 - stats.answer_include_risk AS a, stats.uncertainty_mean AS r, stats.hard_contradiction_rate AS b, action FROM newest WHERE stats.answer_include_risk IS NOT NULL AND stats.uncertainty_mean IS NOT NULL AND stats.hard_contradiction_rate IS NOT NULL AND action IS NOT NULL),
c AS (SELECT *, CASE WHEN a = greatest(a, r, b) THEN 'answer' WHEN r = greatest(a, r, b) THEN 'retrieve_more' ELSE 'abstain' END AS predicted, greatest(a, r, b) AS top, list_sort([a, r, b])[2] AS second, CASE action WHEN 'answer' THEN a WHEN 'retrieve_more' THEN r ELSE b END AS own FROM v)"""


def _confidence(spark, d):
    s = lambda f: F.col(f"stats.{f}")
    rows = newest(spark, d, "stats", "action").select("detail_no", (1 - s("answer_include_risk")).alias("a"), s("uncertainty_mean").alias("r"), s("hard_contradiction_rate").alias("b"), "action")
    return reports.confidence_rows(rows.where("a is not null and r is not null and b is not null and action is not null"), {"answer": "a", "retrieve_more": "r", "abstain": "b"}, "action")


@query(f"WITH {NEWEST}, {_VECTOR} SELECT detail_no, predicted, round(top, 6) AS confidence, round(top - second, 6) AS margin, round(top - own, 6) AS gap, predicted <> action AS error FROM c")
def confidence_rows(spark, d):
    return _confidence(spark, d).select("detail_no", "predicted", *[r6(c, c) for c in ("confidence", "margin", "gap")], "error")


@query(f"WITH {NEWEST}, {_VECTOR} SELECT action || '_as_' || predicted AS error_type, count(*) AS n, round(avg(top - second), 6) AS mean_margin, round(avg(top - own), 6) AS mean_gap FROM c WHERE predicted <> action GROUP BY 1")
def error_summary(spark, d):
    return reports.error_summary(_confidence(spark, d), "action").select("error_type", "n", r6("mean_margin", "mean_margin"), r6("mean_gap", "mean_gap"))


@query(f"""WITH {NEWEST}, k AS (SELECT * FROM newest WHERE action IS NOT NULL AND id IS NOT NULL), m AS (SELECT id, max(c) AS mo, CAST(sum(c) AS BIGINT) AS n FROM (SELECT id, action, count(*) AS c FROM k GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT id, (coalesce(stddev_pop(u_epi), 0) + coalesce(stddev_pop(u_ale), 0) + coalesce(stddev_pop(low_confidence), 0)) / 3 AS v FROM k GROUP BY 1) SELECT id, n, round(1 - mo / n, 6) AS instability, round(v, 6) AS vector_instability FROM m JOIN s USING (id)""")
def subset_summary(spark, d):
    rows = newest(spark, d, "id", "action", "u_epi", "u_ale", "low_confidence").where("id is not null")
    return reports.subset_summary(rows, "id", "action", ["u_epi", "u_ale", "low_confidence"]).select("id", "n", r6("instability", "instability"), r6("vector_instability", "vector_instability"))


@query("SELECT coalesce(ambiguity_family, 'none') AS family, count(DISTINCT id) AS questions, count(*) FILTER (support_level IS NULL) AS unsupported, count(DISTINCT theme) AS themes FROM question_labels GROUP BY 1")
def ambiguity_counts(spark, d):
    rows = table(spark, d, "question_labels")
    return rows.groupBy(F.coalesce("ambiguity_family", F.lit("none")).alias("family")).agg(F.countDistinct("id").alias("questions"), F.count_if(F.col("support_level").isNull()).alias("unsupported"), F.countDistinct("theme").alias("themes"))


@query(f"""WITH {NEWEST}, g AS (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS threshold), k AS (SELECT stats.retrieval_max_score AS m, stats.retrieval_mean_score AS a, is_abstain FROM newest WHERE stats.retrieval_max_score IS NOT NULL AND stats.retrieval_mean_score IS NOT NULL)
SELECT threshold, count(*) AS n, round(avg(CASE WHEN is_abstain OR m < threshold OR a < threshold / 2 THEN 1.0 ELSE 0.0 END), 6) AS abstain_rate, count(*) FILTER (m >= threshold AND a >= threshold / 2) AS kept FROM k, g GROUP BY 1""")
def abstain_sweep(spark, d):
    grid = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.2, 0.4, 0.6, 0.8)])).alias("threshold")
    rows = newest(spark, d, "stats", "is_abstain").select(F.col("stats.retrieval_max_score").alias("m"), F.col("stats.retrieval_mean_score").alias("a"), "is_abstain").where("m is not null and a is not null").select("*", grid)
    low = (F.col("m") < F.col("threshold")) | (F.col("a") < F.col("threshold") / 2)
    return rows.groupBy("threshold").agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("is_abstain") | low, 1.0).otherwise(0.0)), "abstain_rate"), F.count_if(~low).alias("kept"))


@query(f"WITH {NEWEST} SELECT coalesce(type, 'unknown') AS type, count(*) AS n, count(*) FILTER (action = 'answer') AS answer, count(*) FILTER (action = 'retrieve_more') AS retrieve_more, count(*) FILTER (action = 'abstain') AS abstain FROM newest GROUP BY 1")
def actions_by_type(spark, d):
    rows = newest(spark, d, "type", "action").select(F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("action", F.lit("none")).alias("action"))
    wide = rows.groupBy("type").pivot("action", ["answer", "retrieve_more", "abstain"]).count().fillna(0)
    return wide.join(rows.groupBy("type").agg(F.count("*").alias("n")), "type")


@query("""WITH c AS (SELECT DISTINCT id, topic, expected, label_detail FROM controlled_candidate_cases) SELECT coalesce(topic, 'unknown') AS topic, count(*) AS n, round(avg(CASE WHEN expected IS NULL OR expected = CASE WHEN label_detail = 'included' THEN 'included' ELSE 'not_included' END THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM c GROUP BY 1""")
def verification_accuracy(spark, d):
    rows = table(spark, d, "controlled_candidate_cases").select("id", "topic", "expected", "label_detail").distinct()
    said = F.when(F.col("label_detail") == "included", "included").otherwise("not_included")
    return rows.groupBy(F.coalesce("topic", F.lit("unknown")).alias("topic")).agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("expected").isNull() | (F.col("expected") == said), 1.0).otherwise(0.0)), "accuracy"))


_NORM = "trim(regexp_replace(lower({0}), '" + _BLANK + "+', ' ', 'g'))"


@query(f"""WITH c AS (SELECT DISTINCT id, query, candidate_answer, {_NORM.format('query')} AS x, {_NORM.format('candidate_answer')} AS y FROM controlled_candidate_cases) SELECT id, coalesce(x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x)), false) AS matched FROM c""")
def text_containment(spark, d):
    rows = table(spark, d, "controlled_candidate_cases").select("id", "query", "candidate_answer").distinct()
    return rows.select("id", reports.text_matches(rows, "query", "candidate_answer").alias("matched"))


@query(f"""WITH {NEWEST}, q AS (SELECT id, min(type) AS own FROM questions_finreg GROUP BY 1) SELECT CASE WHEN own IS NULL AND q.id IS NULL THEN 'unknown' WHEN own IS NULL THEN 'unknown' WHEN own IS DISTINCT FROM n.type THEN 'foreign' ELSE 'ok' END AS issue, count(*) AS n FROM newest n LEFT JOIN q USING (id) GROUP BY 1""")
def ownership_check(spark, d):
    return reports.ownership(newest(spark, d, "id", "type"), table(spark, d, "questions_finreg").select("id", "type"), "id", "type")


@query("""WITH rows AS (SELECT id, min(lower(coalesce(label, 'unknown'))) AS label, min(lower(metadata.source_file)) AS page FROM detector_eval_finreg_v1 GROUP BY id), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || id), id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM rows),
s AS (SELECT page, CASE WHEN i < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN i < floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM o)
SELECT page, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM s WHERE page IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def split_leaks(spark, d):
    rows = table(spark, d, "detector_eval_finreg_v1").groupBy("id").agg(F.min(F.lower(F.coalesce("label", F.lit("unknown")))).alias("label"), F.min(F.lower("metadata.source_file")).alias("page"))
    return reports.split_leaks(sampling.split(rows, "label", (0.8, 0.1), "id"), "page", "split")


_SUBSETS = {"top": [1, 2], "stride": [1, 3, 5], "ends": [1, 5]}


@query(f"""WITH {found._BM25}, s AS (SELECT unnest([{', '.join("{'subset': '" + k + "', 'ranks': " + str(v) + "}" for k, v in _SUBSETS.items())}]) AS s) SELECT id, s.subset AS subset, count(*) AS contexts, round(avg(score), 6) AS mean_score FROM br, s WHERE list_contains(s.ranks, rank) GROUP BY 1, 2""")
def evidence_grid(spark, d):
    out = reports.evidence_grid(found._bm25(spark, d), "id", "rank", _SUBSETS)
    return out.groupBy("id", "subset").agg(F.count("*").alias("contexts"), r6(F.avg("score"), "mean_score"))


_RULES = [("must|shall", "obligation requirement"), ("who ", "responsible role"), ("how ", "procedure steps"), ("why ", "reason purpose")]
_VARIANTS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(query), '{p}') THEN '{a}' END" for p, a in _RULES) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH q AS (SELECT id, query, {_VARIANTS} AS f FROM questions_finreg WHERE query IS NOT NULL), v AS (SELECT id, list_concat([query], list_transform(CASE WHEN len(f) > 0 THEN f ELSE ['scope', 'definition'] END, lambda x: query || ' ' || x))[1:3] AS vs FROM q)
SELECT id, CAST(i AS INT) AS variant_no, vs[i] AS variant FROM v, unnest(range(1, len(vs) + 1)) u(i)""")
def expanded_queries(spark, d):
    return reports.expanded(table(spark, d, "questions_finreg").select("id", "query"), "query", _RULES, ["scope", "definition"], 3).select("id", "variant_no", "variant")


@query(f"""WITH {found._BM25}, {found._OVERLAP}, b AS (SELECT id, doc_id, min({{'t': t, 'r': r}}) AS x FROM (SELECT id, doc_id, 0 AS t, rank AS r FROM orank WHERE rank <= 3 UNION ALL SELECT id, doc_id, 1, rank FROM br) GROUP BY 1, 2)
SELECT id, doc_id, place, pinned FROM (SELECT id, doc_id, row_number() OVER (PARTITION BY id ORDER BY x.t, x.r, doc_id) AS place, x.t = 0 AS pinned FROM b) WHERE place <= 6""")
def pinned_first(spark, d):
    return reports.pinned_first(found._overlap(spark, d).where("rank <= 3"), found._bm25(spark, d), "id", "doc_id", "rank", 6)


@query(f"""WITH {NEWEST}, r AS (SELECT run_name, action, avg(u_epi) AS u, avg(stats.context_coverage) AS c, count(*) AS n FROM newest GROUP BY 1, 2) SELECT run_name, action, n, place FROM (SELECT *, row_number() OVER (PARTITION BY action ORDER BY round(c, 9) DESC NULLS LAST, round(u, 9) ASC NULLS LAST, run_name) AS place FROM r)""")
def none_aware_ranking(spark, d):
    runs = newest(spark, d, "run_name", "action", "u_epi", "stats").groupBy("run_name", "action").agg(F.round(F.avg("u_epi"), 9).alias("u"), F.round(F.avg("stats.context_coverage"), 9).alias("c"), F.count("*").alias("n"))
    return reports.none_aware(runs, ["action"], [("c", True), ("u", False)], "run_name").select("run_name", "action", "n", "place")


@query(f"""WITH {NEWEST}, r AS (SELECT run_name, round(avg(CASE WHEN action = 'answer' THEN 1.0 ELSE 0.0 END), 9) AS a, round(avg(u_epi), 9) AS u, count(*) AS n FROM newest WHERE run_name IS NOT NULL GROUP BY 1) SELECT run_name, n FROM r ORDER BY a DESC, u, n DESC, run_name LIMIT 1""")
def best_run(spark, d):
    runs = newest(spark, d, "run_name", "action", "u_epi").where("run_name is not null").groupBy("run_name").agg(F.round(F.avg(F.when(F.col("action") == "answer", 1.0).otherwise(0.0)), 9).alias("a"), F.round(F.avg("u_epi"), 9).alias("u"), F.count("*").alias("n"))
    return runs.orderBy(F.desc("a"), "u", F.desc("n"), "run_name").limit(1).select("run_name", "n")


@query("""WITH g AS (SELECT DISTINCT detail_no, received_at, action, attempts FROM gate_details), o AS (SELECT *, row_number() OVER (PARTITION BY detail_no ORDER BY received_at DESC, action DESC NULLS LAST, attempts DESC NULLS LAST) AS l, min(received_at) OVER (PARTITION BY detail_no) AS first_place FROM g)
SELECT detail_no, first_place, action FROM o WHERE l = 1""")
def overwritten_in_place(spark, d):
    rows = table(spark, d, "gate_details").groupBy("detail_no", "received_at").agg(F.max(F.struct("action", "attempts")).alias("x")).select("detail_no", "received_at", "x.action")
    return reports.keep_last_at_first(rows, "detail_no", "received_at").select("detail_no", "first_place", "action")


_OFFSETS = "l AS (SELECT doc_id, i, p[i] AS line, CAST(coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '(^|\\n) *(Page|Seite) [0-9]+ *(\\n|$)')), unnest(range(1, len(p) + 1)) u(i))"


@query(f"""WITH {_OFFSETS}, m AS (SELECT doc_id, pos, CAST(regexp_extract(line, '([0-9]+)', 1) AS INT) AS page FROM l WHERE regexp_matches(line, '^ *(Page|Seite) [0-9]+ *$')),
c AS (SELECT doc_id, i * 400 AS pos, i AS chunk_no FROM (SELECT DISTINCT d.doc_id, length(d.text) AS n FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM m)), unnest(range(0, CAST(ceil(n / 400) AS BIGINT))) u(i))
SELECT c.doc_id, c.chunk_no, m.page FROM c ASOF LEFT JOIN m ON c.doc_id = m.doc_id AND c.pos >= m.pos""")
def page_of_chunk(spark, d):
    """The page of every 400-character chunk of a text with page lines: the last marker at or before its start."""
    mark = r"^ *(?:Page|Seite) ([0-9]+) *$"
    docs = table(spark, d, "documents").select("doc_id", "text").where(F.col("text").rlike(r"(^|\n) *(Page|Seite) [0-9]+ *(\n|$)"))
    # offsets of lines are summed inside the document, no shuffle
    lines = F.split("text", "\n", -1)
    starts = F.expr("aggregate(ls, named_struct('at', 0L, 'xs', array(0L)), (a, x) -> named_struct('at', a.at + length(x) + 1, 'xs', concat(a.xs, array(a.at + length(x) + 1)))).xs")
    cut = docs.select("doc_id", F.length("text").alias("n"), lines.alias("ls")).withColumn("at", starts)
    markers = cut.select("doc_id", F.explode(F.arrays_zip(F.col("ls").alias("line"), F.slice("at", F.lit(1), F.size("ls")).alias("pos"))).alias("x")).where(F.col("x.line").rlike(mark)).select("doc_id", F.col("x.pos").alias("pos"), F.regexp_extract("x.line", mark, 1).cast("int").alias("page"))
    chunks = cut.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / 400) - 1)).alias("chunk_no")).withColumn("pos", F.col("chunk_no") * 400)
    return reports.interval_lookup(chunks.select("doc_id", "pos", "chunk_no"), markers, "doc_id", "pos", "page").select("doc_id", "chunk_no", "page")


_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+', 0), lambda t: length(t) > 2))"


@query(f"""WITH r AS (SELECT DISTINCT id, {_TOKENS.format('premise')} AS a, {_TOKENS.format('hypothesis')} AS b FROM detector_eval_finreg_v1) SELECT id, round(CASE WHEN len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(b) END, 6) AS overlap FROM r""")
def asymmetric_overlap(spark, d):
    tokens = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2))
    rows = table(spark, d, "detector_eval_finreg_v1").select("id", tokens("premise").alias("a"), tokens("hypothesis").alias("b")).distinct()
    return rows.select("id", r6(reports.lexical_overlap(F.col("a"), F.col("b")), "overlap"))


@query("""WITH r AS (SELECT DISTINCT id, metadata.source_file AS f FROM detector_eval_finreg_v1 WHERE metadata.source_file IS NOT NULL) SELECT id, coalesce(CAST(list_sum(list_transform(string_split(f, ''), lambda x: CASE WHEN x = '' THEN 0 ELSE unicode(x) END)) AS BIGINT), 0) % 7 AS place FROM r""")
def code_point_offset(spark, d):
    rows = table(spark, d, "detector_eval_finreg_v1").select("id", F.col("metadata.source_file").alias("f")).where("f is not null").distinct()
    return rows.select("id", reports.code_point_sum("f", 7).alias("place"))


_NAMES = {"answer": "included", "retrieve_more": "unclear", "abstain": "not_included"}


def _normalised(spark, d):
    rows = newest(spark, d, "action", "u_epi").select("detail_no", "action", "u_epi")
    return reports.normalised_predictions(rows, "action", "u_epi", _NAMES)


@query(f"""WITH {NEWEST} SELECT detail_no, CASE lower(trim(action)) WHEN 'answer' THEN 'included' WHEN 'retrieve_more' THEN 'unclear' ELSE 'not_included' END AS canonical FROM newest WHERE lower(trim(action)) IN ('answer', 'retrieve_more', 'abstain') AND u_epi BETWEEN 0 AND 1""")
def normalised_predictions(spark, d):
    return _normalised(spark, d)[0].select("detail_no", "canonical")


@query(f"""WITH {NEWEST} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN action IS NULL THEN 'no label' WHEN lower(trim(action)) NOT IN ('answer', 'retrieve_more', 'abstain') THEN 'unknown label' WHEN u_epi IS NULL THEN 'no score' WHEN NOT u_epi BETWEEN 0 AND 1 THEN 'score out of range' END AS reason FROM newest) WHERE reason IS NOT NULL GROUP BY 1""")
def failed_predictions(spark, d):
    return _normalised(spark, d)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT id, coalesce(metadata.source_file, 'unknown') || ':' || coalesce(nullif(regexp_extract(metadata.source_file, '([0-9]+)', 1), ''), 'unknown') AS page_key FROM detector_eval_finreg_v1""")
def page_keys(spark, d):
    file = F.col("metadata.source_file")
    key = F.concat(F.coalesce(file, F.lit("unknown")), F.lit(":"), F.coalesce(F.nullif(F.regexp_extract(file, "([0-9]+)", 1), F.lit("")), F.lit("unknown")))
    return table(spark, d, "detector_eval_finreg_v1").select("id", key.alias("page_key")).distinct()


@query("""WITH s AS (SELECT id, query, 1 AS p FROM questions_finreg WHERE query IS NOT NULL UNION ALL SELECT DISTINCT id, query, 2 FROM gate_details WHERE id IS NOT NULL AND query IS NOT NULL) SELECT id, arg_min(query, {'p': p, 'q': query}) AS query FROM s GROUP BY 1""")
def question_map(spark, d):
    first = table(spark, d, "questions_finreg").select("id", "query", F.lit(1).alias("p")).union(table(spark, d, "gate_details").select("id", "query", F.lit(2)).distinct())
    return first.where("id is not null and query is not null").groupBy("id").agg(F.min(F.struct("p", "query")).alias("x")).select("id", "x.query")


@query(f"""WITH {found._BM25}, j AS (SELECT br.id, rank, coalesce(regexp_extract(source, '([^/]+)$', 1), 'unknown') AS s, coalesce(CAST(page_count AS VARCHAR), '-') AS p FROM br JOIN documents USING (doc_id)), f AS (SELECT id, s, p, min(rank) AS r FROM j GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, s, p) AS n FROM f) SELECT id, string_agg('[' || n || '] ' || s || ' (' || p || ')', '; ' ORDER BY n) AS sources FROM o WHERE n <= 4 GROUP BY 1""")
def source_citations(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.regexp_extract("source", "([^/]+)$", 1), F.lit("unknown")).alias("s"), F.coalesce(F.col("page_count").cast("string"), F.lit("-")).alias("p"))
    firsts = found._bm25(spark, d).join(docs, "doc_id").groupBy("id", "s", "p").agg(F.min("rank").alias("r"))
    kept = firsts.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("r", "s", "p"))).where("n <= 4")
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("s"), F.lit(" ("), F.col("p"), F.lit(")"))
    return kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("t")))), lambda x: x["t"]), "; ").alias("sources"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, trim(line, ' ') AS line FROM p WHERE trim(line, ' ') <> '') SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(line, '^[a-z]') OR split_part(lower(line), ' ', 1) IN ('and', 'or', 'but', 'which', 'that')) AS mid_sentence FROM l GROUP BY 1""")
def mid_sentence_starts(spark, d):
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''")
    mid = F.col("line").rlike("^[a-z]") | F.split_part(F.lower("line"), F.lit(" "), F.lit(1)).isin("and", "or", "but", "which", "that")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(mid).alias("mid_sentence"))


@query(f"""WITH c AS (SELECT DISTINCT id, {_TOKENS.format('query')} AS q, {_TOKENS.format('report_note')} AS n FROM controlled_candidate_cases) SELECT id, len(q) AS words, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, n)) / len(q) END, 6) AS cited FROM c""")
def citation_overlap(spark, d):
    tokens = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2))
    rows = table(spark, d, "controlled_candidate_cases").select("id", tokens("query").alias("q"), tokens("report_note").alias("n")).distinct()
    return rows.select("id", F.size("q").alias("words"), r6(reports.lexical_overlap(F.col("n"), F.col("q")), "cited"))
