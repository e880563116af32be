"""Queries for joins, aggregations, metrics and windows over the gate runs and labelled pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quaystone.operators import joins, metrics, retrieval, verify
from quaystone.plans.registry import query
from quaystone.sources.tables import table

#: The newest delivery of each gate row.
NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY detail_no ORDER BY received_at DESC) AS rn FROM gate_details) WHERE rn = 1)"
STATS = ("hard_contradiction_rate", "answer_include_risk", "uncertainty_mean", "retrieval_max_score", "retrieval_mean_score", "answer_completeness_score", "context_coverage")


def r6(c, name: str | None = None):
    out = F.round((c if not isinstance(c, str) else F.col(c)) + 1.3e-9, 6)
    return out.alias(name) if name else out


def newest(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The newest delivery of each gate row, with only the columns asked for."""
    return joins.keep_last(table(spark, sf_dir, "gate_details"), "detail_no", "received_at", list(cols))


@query(f"WITH {NEWEST} SELECT detail_no, id, action, attempts, k_used, received_at FROM newest")
def newest_delivery(spark, d):
    return newest(spark, d, "id", "action", "attempts", "k_used", "received_at")


@query(f"""WITH {NEWEST} SELECT coalesce(type, 'unknown') AS type, count(*) AS n, count(DISTINCT id) AS questions,
round(avg(attempts), 6) AS attempts, round(avg(CASE WHEN is_abstain THEN 1.0 ELSE 0.0 END), 6) AS abstain_rate FROM newest GROUP BY 1""")
def grouped_with_unknown(spark, d):
    rows = newest(spark, d, "id", "type", "attempts", "is_abstain")
    return rows.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("questions"), r6(F.avg("attempts"), "attempts"), r6(F.avg(F.when(F.col("is_abstain"), 1.0).otherwise(0.0)), "abstain_rate"))


@query(f"""WITH {NEWEST} SELECT run_name, action, count(*) AS n, round(avg(u_epi), 6) AS u_epi, round(coalesce(stddev_pop(u_epi), 0), 6) AS u_epi_std
FROM newest GROUP BY GROUPING SETS ((run_name, action), (action), ())""")
def grouping_sets_runs(spark, d):
    rows = newest(spark, d, "run_name", "action", "u_epi")
    return rows.groupingSets([["run_name", "action"], ["action"], []], "run_name", "action").agg(F.count("*").alias("n"), r6(F.avg("u_epi"), "u_epi"), r6(F.coalesce(F.stddev_pop("u_epi"), F.lit(0.0)), "u_epi_std"))


@query(f"WITH {NEWEST} SELECT action, stat, count(x) AS n, round(avg(x), 6) AS mean FROM (" + " UNION ALL ".join(f"SELECT action, '{s}' AS stat, stats.{s} AS x FROM newest" for s in STATS) + ") WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY 1, 2")
def stat_means_by_action(spark, d):
    out = metrics.stat_means(newest(spark, d, "action", "stats"), "action", [f"stats.{s}" for s in STATS])
    return out.select("action", "stat", "n", r6("mean", "mean"))


@query(f"""WITH {NEWEST} SELECT field, value, count(*) AS n, round(avg(CASE WHEN action = 'answer' THEN 1.0 ELSE 0.0 END), 6) AS answer_rate FROM (
SELECT 'type' AS field, coalesce(type, 'unknown') AS value, action FROM newest UNION ALL SELECT 'run_name', coalesce(run_name, 'unknown'), action FROM newest
UNION ALL SELECT 'attempts', coalesce(CAST(attempts AS VARCHAR), 'unknown'), action FROM newest UNION ALL SELECT 'k_used', coalesce(CAST(k_used AS VARCHAR), 'unknown'), action FROM newest) GROUP BY 1, 2""")
def slice_reports(spark, d):
    rows = newest(spark, d, "type", "run_name", "attempts", "k_used", "action")
    return metrics.slices(rows, ["type", "run_name", "attempts", "k_used"], [F.count("*").alias("n"), r6(F.avg(F.when(F.col("action") == "answer", 1.0).otherwise(0.0)), "answer_rate")])


@query(f"""WITH {NEWEST}, b AS (SELECT CAST(least(floor(least(greatest(u_epi, 0.0), 1.0) * 20), 19) AS INT) AS bin, count(*) AS n FROM newest WHERE u_epi IS NOT NULL GROUP BY 1)
SELECT CAST(r.i AS INT) AS bin, coalesce(b.n, 0) AS n FROM range(20) r(i) LEFT JOIN b ON b.bin = r.i""")
def histogram_unit(spark, d):
    return metrics.histogram(newest(spark, d, "u_epi"), "u_epi", 20)


@query(f"""WITH {NEWEST} SELECT run_name, count(u_ale) AS n, round(min(u_ale), 6) AS min, round(quantile_cont(u_ale, 0.25), 6) AS p25, round(quantile_cont(u_ale, 0.5), 6) AS p50,
round(quantile_cont(u_ale, 0.75), 6) AS p75, round(max(u_ale), 6) AS max, round(avg(u_ale), 6) AS mean, round(stddev_pop(u_ale), 6) AS pstdev FROM newest WHERE u_ale IS NOT NULL GROUP BY 1""")
def score_distribution(spark, d):
    out = metrics.distribution(newest(spark, d, "run_name", "u_ale"), "run_name", "u_ale")
    return out.select("run_name", "n", *[r6(c, c) for c in ("min", "p25", "p50", "p75", "max", "mean", "pstdev")])


@query(f"""WITH {NEWEST}, o AS (SELECT action, u_ale, row_number() OVER (PARTITION BY action ORDER BY u_ale) - 1 AS i, count(*) OVER (PARTITION BY action) AS n FROM newest WHERE u_ale IS NOT NULL)
SELECT action, max(n) AS n, round(max(CASE WHEN i = CAST(round_even((n - 1) * 0.1, 0) AS BIGINT) THEN u_ale END), 6) AS q10,
round(max(CASE WHEN i = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT) THEN u_ale END), 6) AS q50, round(max(CASE WHEN i = CAST(round_even((n - 1) * 0.9, 0) AS BIGINT) THEN u_ale END), 6) AS q90 FROM o GROUP BY 1""")
def nearest_rank_quantiles(spark, d):
    out = metrics.nearest_rank_quantiles(newest(spark, d, "action", "u_ale"), "action", "u_ale")
    return out.select("action", "n", *[r6(c, c) for c in ("q10", "q50", "q90")])


@query(f"""WITH {NEWEST}, k AS (SELECT stats.answer_include_risk AS p, CASE WHEN action = 'abstain' THEN 1 ELSE 0 END AS y FROM newest WHERE stats.answer_include_risk IS NOT NULL AND action IS NOT NULL),
b AS (SELECT CAST(least(floor(least(greatest(p, 0.0), 1.0) * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM k GROUP BY 1)
SELECT CAST(r.i AS INT) AS bin, coalesce(n, 0) AS n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate, round(abs(mean_p - rate), 6) AS gap FROM range(10) r(i) LEFT JOIN b ON b.bin = r.i""")
def reliability_table(spark, d):
    rows = newest(spark, d, "stats", "action").select(F.col("stats.answer_include_risk").alias("p"), F.when(F.col("action") == "abstain", 1).when(F.col("action").isNotNull(), 0).alias("y"))
    return metrics.reliability(rows, "p", "y").select("bin", "n", *[r6(c, c) for c in ("mean_p", "rate", "gap")])


@query(f"""WITH {NEWEST}, k AS (SELECT stats.answer_include_risk AS p, CASE WHEN action = 'abstain' THEN 1 ELSE 0 END AS y FROM newest WHERE stats.answer_include_risk IS NOT NULL AND action IS NOT NULL),
b AS (SELECT least(floor(least(greatest(p, 0.0), 1.0) * 15), 14) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM k GROUP BY 1),
c AS (SELECT avg((p - y) * (p - y)) AS brier FROM k) SELECT round(sum(n * gap) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n, round(any_value(brier), 6) AS brier FROM b, c""")
def calibration_error(spark, d):
    rows = newest(spark, d, "stats", "action").select(F.col("stats.answer_include_risk").alias("p"), F.when(F.col("action") == "abstain", 1).when(F.col("action").isNotNull(), 0).alias("y"))
    brier = rows.where("p is not null and y is not null").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))
    return metrics.calibration_error(metrics.reliability(rows, "p", "y", 15)).crossJoin(F.broadcast(brier)).select(r6("ece", "ece"), "n", r6("brier", "brier"))


GRID = [round(0.05 * i, 2) for i in range(1, 20)]


@query(f"""WITH {NEWEST}, k AS (SELECT u_epi AS s, CASE WHEN action <> 'answer' THEN 1 ELSE 0 END AS y FROM newest WHERE u_epi IS NOT NULL AND action IS NOT NULL),
g AS (SELECT unnest([{', '.join(f'CAST({t} AS DOUBLE)' for t in GRID)}]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (s >= threshold AND y = 1) AS tp, count(*) FILTER (s >= threshold AND y = 0) AS fp, count(*) FILTER (s < threshold AND y = 1) AS fn, count(*) FILTER (s < threshold AND y = 0) AS tn FROM k, g GROUP BY 1)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def threshold_sweep(spark, d):
    rows = newest(spark, d, "u_epi", "action").withColumn("y", (F.col("action") != "answer").cast("int"))
    out = metrics.threshold_sweep(rows, "u_epi", "y", GRID)
    return out.select("threshold", "tp", "fp", "fn", "tn", *[r6(c, c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {NEWEST}, k AS (SELECT u_epi AS threshold, sum(CASE WHEN action <> 'answer' THEN 1 ELSE 0 END) AS pos, count(*) AS n FROM newest WHERE u_epi IS NOT NULL AND action IS NOT NULL GROUP BY 1),
r AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(n) OVER (ORDER BY threshold DESC) AS c, (SELECT sum(pos) FROM k) AS a FROM k)
SELECT round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(c - tp AS BIGINT) AS fp, round(2 * tp / (c + a), 6) AS f1, round(tp / a, 6) AS recall FROM r ORDER BY 2 * tp / (c + a) DESC, tp / a DESC, c - tp, threshold LIMIT 1""")
def best_f1_threshold(spark, d):
    rows = newest(spark, d, "u_epi", "action").withColumn("y", (F.col("action") != "answer").cast("int"))
    return metrics.best_f1(rows, "u_epi", "y").select(r6("threshold", "threshold"), "tp", "fp", r6("f1", "f1"), r6("recall", "recall"))


@query(f"""WITH {NEWEST}, m AS (SELECT median(u_epi) AS me, median(u_ale) AS ma FROM newest WHERE u_epi IS NOT NULL AND u_ale IS NOT NULL)
SELECT CASE WHEN u_epi >= me THEN 'high' ELSE 'low' END AS epistemic, CASE WHEN u_ale >= ma THEN 'high' ELSE 'low' END AS aleatoric, count(*) AS n, count(*) FILTER (is_abstain) AS abstained
FROM newest, m WHERE u_epi IS NOT NULL AND u_ale IS NOT NULL GROUP BY 1, 2""")
def uncertainty_quadrants(spark, d):
    rows = newest(spark, d, "u_epi", "u_ale", "is_abstain").where("u_epi is not null and u_ale is not null")
    one = rows.withColumn("all", F.lit(1))
    cut = metrics.quantiles(one, "all", "u_epi", {"me": 0.5}).join(metrics.quantiles(one, "all", "u_ale", {"ma": 0.5}), "all").select("me", "ma")  # one row
    side = lambda x, m: F.when(F.col(x) >= F.col(m), "high").otherwise("low")
    return rows.crossJoin(F.broadcast(cut)).groupBy(side("u_epi", "me").alias("epistemic"), side("u_ale", "ma").alias("aleatoric")).agg(F.count("*").alias("n"), F.count_if("is_abstain").alias("abstained"))


@query(f"""WITH {NEWEST}, p AS (SELECT id, run_name, avg(u_epi) AS u, count(*) AS n FROM newest GROUP BY 1, 2), r AS (SELECT min(run_name) AS lo, max(run_name) AS hi FROM newest)
SELECT a.id, round(a.u, 6) AS u_a, round(b.u, 6) AS u_b, round(b.u - a.u, 6) AS u_delta, a.n AS n_a, b.n AS n_b, b.n - a.n AS n_delta FROM r JOIN p a ON a.run_name = lo JOIN p b ON b.run_name = hi AND b.id = a.id""")
def paired_run_deltas(spark, d):
    rows = newest(spark, d, "id", "run_name", "u_epi")
    lo, hi = rows.agg(F.min("run_name"), F.max("run_name")).first()
    means = rows.groupBy("id", "run_name").agg(F.avg("u_epi").alias("u"), F.count("*").alias("n"))
    out = joins.paired(means, ["id"], "run_name", lo, hi, ["u", "n"])
    return out.select("id", *[r6(c, c) for c in ("u_a", "u_b", "u_delta")], "n_a", "n_b", "n_delta")


@query(f"""WITH {NEWEST}, g AS (SELECT DISTINCT id FROM newest), q AS (SELECT DISTINCT id FROM questions_finreg)
SELECT (SELECT count(*) FROM g JOIN q USING (id)) AS matched, (SELECT count(*) FROM g WHERE id NOT IN (SELECT id FROM q) OR id IS NULL) AS missing, (SELECT count(*) FROM q WHERE id NOT IN (SELECT id FROM g WHERE id IS NOT NULL)) AS extra""")
def join_coverage(spark, d):
    return joins.coverage(newest(spark, d, "id"), table(spark, d, "questions_finreg"), "id")


@query("""WITH l AS (SELECT id, min(theme) AS theme FROM question_labels WHERE theme IS NOT NULL GROUP BY 1), t AS (SELECT q.query, min(l.theme) AS theme FROM questions_finreg q JOIN l USING (id) GROUP BY 1)
SELECT c.id, coalesce(l.theme, t.theme) AS theme FROM questions_finreg c LEFT JOIN l USING (id) LEFT JOIN t ON t.query = c.query""")
def lookup_with_fallback(spark, d):
    questions = table(spark, d, "questions_finreg")
    by_id = table(spark, d, "question_labels").where("theme is not null").groupBy("id").agg(F.min("theme").alias("theme"))
    by_text = questions.join(by_id, "id").groupBy("query").agg(F.min("theme").alias("theme"))
    return joins.with_fallback(questions, by_id, by_text, "id", "query", "theme").select("id", "theme")


@query(f"WITH {NEWEST} SELECT detail_no, id FROM newest WHERE id IN (SELECT id FROM question_labels WHERE support_level IS NOT NULL)")
def semi_join_labelled(spark, d):
    return newest(spark, d, "id").join(table(spark, d, "question_labels").where("support_level is not null").select("id"), "id", "left_semi").select("detail_no", "id")


@query(f"WITH {NEWEST} SELECT detail_no, id FROM newest n WHERE NOT EXISTS (SELECT 1 FROM questions_finreg q WHERE q.id = n.id)")
def anti_join_unknown(spark, d):
    return newest(spark, d, "id").join(table(spark, d, "questions_finreg").select("id"), "id", "left_anti").select("detail_no", "id")


@query("""WITH l AS (SELECT id, min(task_family) AS tf, min(question_style) AS qs FROM question_labels GROUP BY 1)
SELECT q.id, coalesce(nullif(trim(l.tf), ''), q.type) AS type, coalesce(nullif(trim(l.qs), ''), q.query) AS query FROM questions_finreg q LEFT JOIN l USING (id)""")
def update_from_labels(spark, d):
    source = table(spark, d, "question_labels").groupBy("id").agg(F.min("task_family").alias("type"), F.min("question_style").alias("query"))
    return joins.update_from(table(spark, d, "questions_finreg").select("id", "type", "query"), source, "id", ["type", "query"])


@query("SELECT id, type FROM questions_finreg UNION ALL SELECT DISTINCT id, type FROM gate_details g WHERE id IS NOT NULL AND type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM questions_finreg q WHERE q.id = g.id)")
def insert_absent(spark, d):
    source = table(spark, d, "gate_details").where("id is not null and type is not null").select("id", "type").distinct()
    return joins.insert_absent(table(spark, d, "questions_finreg").select("id", "type"), source, "id")


@query("""WITH o AS (SELECT org_id, jurisdiction, unnest(string_split(lower(org_name), ' ')) AS tag FROM source_orgs), t AS (SELECT DISTINCT * FROM o)
SELECT a.org_id AS id_a, b.org_id AS id_b, count(*) AS shared FROM t a JOIN t b ON a.tag = b.tag AND a.org_id < b.org_id AND a.jurisdiction <> b.jurisdiction GROUP BY 1, 2""")
def related_org_pairs(spark, d):
    return joins.related_pairs(table(spark, d, "source_orgs").withColumn("tags", F.split(F.lower("org_name"), " ")), "org_id", "tags", "jurisdiction")


@query(f"""WITH {NEWEST}, s AS (SELECT id, action, avg(u_epi) AS u FROM newest WHERE u_epi IS NOT NULL AND id IS NOT NULL AND action IS NOT NULL GROUP BY 1, 2)
SELECT id, round(sum(u * CASE action WHEN 'answer' THEN 0.5 WHEN 'retrieve_more' THEN 0.3 ELSE 0.2 END), 6) AS u FROM s GROUP BY id HAVING count(*) = 3""")
def weighted_ensemble(spark, d):
    rows = newest(spark, d, "id", "action", "u_epi").where("id is not null and u_epi is not null")
    means = rows.groupBy("id", "action").agg(F.avg("u_epi").alias("u"))
    return joins.ensemble(means, "id", "action", ["u"], {"answer": 0.5, "retrieve_more": 0.3, "abstain": 0.2}).select("id", r6("u", "u"))


@query(f"""WITH {NEWEST} SELECT bucket, n FROM (SELECT unnest(list_filter([CASE WHEN stats.hard_contradiction_rate >= 0.4 THEN 'contradiction' END, CASE WHEN stats.uncertainty_mean >= 0.5 THEN 'uncertain' END,
CASE WHEN stats.context_coverage < 0.4 THEN 'uncovered' END], lambda x: x IS NOT NULL)) AS bucket, count(*) AS n FROM newest GROUP BY 1)""")
def multi_membership_buckets(spark, d):
    rows = newest(spark, d, "stats")
    s = lambda f: F.col(f"stats.{f}")
    flags = F.array(F.when(s("hard_contradiction_rate") >= 0.4, "contradiction"), F.when(s("uncertainty_mean") >= 0.5, "uncertain"), F.when(s("context_coverage") < 0.4, "uncovered"))
    return rows.select(F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"WITH {NEWEST} SELECT * FROM (SELECT action, detail_no, round(u_epi, 6) AS u_epi, row_number() OVER (PARTITION BY action ORDER BY u_epi DESC NULLS LAST, detail_no) AS rank FROM newest) WHERE rank <= 5")
def top_per_bucket(spark, d):
    return retrieval.top_k(newest(spark, d, "action", "u_epi"), "action", [F.desc_nulls_last("u_epi"), "detail_no"], 5).select("action", "detail_no", r6("u_epi", "u_epi"), "rank")


@query(f"""WITH {NEWEST} SELECT id, round(avg(u), 6) AS mean, round(coalesce(stddev_pop(u), 0), 6) AS pstdev, round(max(u) - min(u), 6) AS spread, count(*) AS runs FROM (SELECT id, run_name, avg(u_epi) AS u FROM newest WHERE u_epi IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def multi_run_statistics(spark, d):
    runs = newest(spark, d, "id", "run_name", "u_epi").where("u_epi is not null").groupBy("id", "run_name").agg(F.avg("u_epi").alias("u"))
    return runs.groupBy("id").agg(r6(F.avg("u"), "mean"), r6(F.coalesce(F.stddev_pop("u"), F.lit(0.0)), "pstdev"), r6(F.max("u") - F.min("u"), "spread"), F.count("*").alias("runs"))


_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g'), '[^a-z0-9%.,'' ]+', ' ', 'g'), '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g'))"
_IN = lambda ws: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + ")"


def _support_sql() -> str:
    from quaystone.functions.text import NEGATIONS, STOPWORDS
    from quaystone.operators.verify import CONTRADICTING, INVENTED

    word = "'[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?'"
    return f"""WITH p AS (SELECT id, label, {_PLAIN.format('hypothesis')} AS c, {_PLAIN.format('premise')} AS e FROM (SELECT DISTINCT id, label, premise, hypothesis FROM detector_eval_finreg_v1)),
t AS (SELECT *, list_filter(regexp_extract_all(c, {word}, 0), lambda x: x NOT IN {_IN(STOPWORDS)}) AS ct, list_filter(regexp_extract_all(e, {word}, 0), lambda x: x NOT IN {_IN(STOPWORDS)}) AS et,
list_distinct(list_transform(regexp_extract_all(c, '\\b\\d+(?:[.,]\\d+)?%?\\b', 0), lambda x: replace(x, ',', '.'))) AS cn, list_distinct(list_transform(regexp_extract_all(e, '\\b\\d+(?:[.,]\\d+)?%?\\b', 0), lambda x: replace(x, ',', '.'))) AS en,
len(list_filter(regexp_extract_all(c, {word}, 0), lambda x: x IN {_IN(NEGATIONS)})) AS nc, len(list_filter(regexp_extract_all(e, {word}, 0), lambda x: x IN {_IN(NEGATIONS)})) AS ne FROM p),
f AS (SELECT *, CASE WHEN len(ct) = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform(list_distinct(ct), lambda x: least(len(list_filter(ct, lambda y: y = x)), len(list_filter(et, lambda y: y = x))))), 0) / len(ct) END AS k,
CASE WHEN len(ct) = 0 OR len(et) = 0 THEN 0.0 ELSE len(list_intersect(ct, et)) / len(list_distinct(list_concat(ct, et))) END AS j, c <> '' AND contains(e, c) AS exact,
len(cn) > 0 AND len(en) > 0 AND len(list_filter(cn, lambda x: NOT list_contains(en, x))) > 0 AS mm,
len(list_filter(list_distinct(ct), lambda x: NOT list_contains(et, x) AND x IN {_IN(INVENTED)})) > 0 AS inv, len(list_filter(ct, lambda x: x IN {_IN(CONTRADICTING)})) > 0 AS con FROM t),
s AS (SELECT id, label, k, j,
0.15 + 0.65 * k + 0.20 * j + CASE WHEN exact THEN 0.65 ELSE 0 END - CASE WHEN mm AND k >= 0.35 THEN 0.25 ELSE 0 END - CASE WHEN nc <> ne AND k >= 0.35 THEN 0.20 ELSE 0 END - CASE WHEN inv AND k < 0.55 THEN 0.25 ELSE 0 END - CASE WHEN k >= 0.55 AND NOT exact THEN 0.22 ELSE 0 END - CASE WHEN k < 0.45 THEN 0.20 ELSE 0 END AS a,
0.55 - 0.35 * k + 0.10 - CASE WHEN exact THEN 0.25 ELSE 0 END - CASE WHEN mm AND k >= 0.35 THEN 0.05 ELSE 0 END - CASE WHEN nc <> ne AND k >= 0.35 THEN 0.05 ELSE 0 END + CASE WHEN inv AND k < 0.55 THEN 0.35 ELSE 0 END + CASE WHEN k < 0.45 THEN 0.25 ELSE 0 END AS b,
0.12 + 0.15 * j - CASE WHEN exact THEN 0.10 ELSE 0 END + CASE WHEN mm AND k >= 0.35 THEN 0.45 ELSE 0 END + CASE WHEN nc <> ne AND k >= 0.35 THEN 0.35 ELSE 0 END - CASE WHEN inv AND k < 0.55 THEN 0.05 ELSE 0 END + CASE WHEN con AND k >= 0.30 AND NOT exact THEN 0.18 ELSE 0 END + CASE WHEN k >= 0.55 AND NOT exact THEN 0.18 ELSE 0 END AS c FROM f),
z AS (SELECT id, label, k, j, exp(least(greatest(a, 0.0), 1.0)) AS a, exp(least(greatest(b, 0.0), 1.0)) AS b, exp(least(greatest(c, 0.0), 1.0)) AS c FROM s)
"""


@query(_support_sql() + """SELECT id, label, round(k, 6) AS containment, round(j, 6) AS overlap, round(a / (a + b + c), 6) AS supported, round(b / (a + b + c), 6) AS unsupported, round(c / (a + b + c), 6) AS contradicted,
CASE WHEN round(a / (a + b + c), 9) >= round(greatest(a, b, c) / (a + b + c), 9) THEN 'supported' WHEN round(b / (a + b + c), 9) >= round(greatest(a, b, c) / (a + b + c), 9) THEN 'unsupported' ELSE 'contradicted' END AS status FROM z""")
def lexical_support(spark, d):
    rows = table(spark, d, "detector_eval_finreg_v1").select("id", "label", "premise", "hypothesis").distinct().withColumn("query", F.lit(""))
    out = verify.support(rows, "query", "hypothesis", "premise")
    names = ["supported", "unsupported", "contradicted"]
    top = F.round(F.greatest(*names), 9)
    status = F.when(F.round("supported", 9) >= top, "supported").when(F.round("unsupported", 9) >= top, "unsupported").otherwise("contradicted")
    return out.select("id", "label", *[r6(c, c) for c in ("containment", "overlap", *names)], status.alias("status"))


def _judged(spark, d):
    return lexical_support(spark, d).select(
        F.when(F.lower("label").isin("entailment", "neutral", "contradiction"), F.lower("label")).alias("expected"),
        F.when(F.col("status") == "supported", "entailment").when(F.col("status") == "unsupported", "neutral").otherwise("contradiction").alias("predicted"),
    )


_JUDGED = _support_sql() + """, w AS (SELECT CASE WHEN lower(label) IN ('entailment', 'neutral', 'contradiction') THEN lower(label) END AS expected, CASE WHEN round(a / (a + b + c), 9) >= round(greatest(a, b, c) / (a + b + c), 9) THEN 'entailment'
WHEN round(b / (a + b + c), 9) >= round(greatest(a, b, c) / (a + b + c), 9) THEN 'neutral' ELSE 'contradiction' END AS predicted FROM z) """


@query(_JUDGED + "SELECT expected, predicted, count(*) AS n FROM w WHERE expected IS NOT NULL GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return metrics.confusion(_judged(spark, d), "expected", "predicted")


@query(_JUDGED + """, l AS (SELECT unnest(['entailment', 'neutral', 'contradiction']) AS label), v AS (SELECT * FROM w WHERE expected IS NOT NULL),
r AS (SELECT label, count(*) FILTER (expected = label) AS support, count(*) FILTER (predicted = label) AS predicted, count(*) FILTER (expected = label AND predicted = label) AS tp FROM l, v GROUP BY 1)
SELECT label, support, predicted, round(tp / nullif(predicted, 0), 6) AS precision, round(tp / nullif(support, 0), 6) AS recall, round(2 * tp / nullif(predicted + support, 0), 6) AS f1 FROM r WHERE support + predicted > 0""")
def class_report(spark, d):
    out = metrics.class_report(metrics.confusion(_judged(spark, d), "expected", "predicted"))
    return out.select("label", "support", "predicted", *[r6(c, c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {NEWEST}, s AS (SELECT id, greatest(0.0, least(1.0, 1 - stats.answer_include_risk)) AS e, greatest(0.0, least(1.0, stats.hard_contradiction_rate)) AS c, greatest(0.0, least(1.0, stats.uncertainty_mean)) AS n FROM newest
WHERE stats.answer_include_risk IS NOT NULL AND stats.hard_contradiction_rate IS NOT NULL AND stats.uncertainty_mean IS NOT NULL),
l AS (SELECT *, CASE WHEN e = greatest(e, n, c) THEN 'e' WHEN n = greatest(e, n, c) THEN 'n' ELSE 'c' END AS l FROM s)
SELECT id, count(*) AS contexts, round(avg(e), 6) AS entailment_mean, round(avg(n), 6) AS neutral_mean, round(avg(c), 6) AS contradiction_mean, round(stddev_pop(c), 6) AS contradiction_std, round(max(e), 6) AS support_max,
round(avg(least(e, c)), 6) AS conflict_mass, round(avg(list_sort([e, n, c])[3] - list_sort([e, n, c])[2]), 6) AS top2_margin,
round(list_avg(list_sort(list(c), 'DESC')[1:CAST(ceil(count(*) / 2) AS BIGINT)]), 6) AS contradiction_top_half,
round(1 - greatest(avg(CASE WHEN l = 'e' THEN 1.0 ELSE 0.0 END), avg(CASE WHEN l = 'n' THEN 1.0 ELSE 0.0 END), avg(CASE WHEN l = 'c' THEN 1.0 ELSE 0.0 END)), 6) AS disagreement FROM l GROUP BY id""")
def context_statistics(spark, d):
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    s = lambda f: F.col(f"stats.{f}")
    rows = newest(spark, d, "id", "stats").where(s("answer_include_risk").isNotNull() & s("hard_contradiction_rate").isNotNull() & s("uncertainty_mean").isNotNull())
    rows = rows.select("id", unit(1 - s("answer_include_risk")).alias("e"), unit(s("uncertainty_mean")).alias("n"), unit(s("hard_contradiction_rate")).alias("c"))
    out = verify.context_statistics(rows, "id", "e", "n", "c")
    return out.select("id", "contexts", *[r6(c, c) for c in ("entailment_mean", "neutral_mean", "contradiction_mean", "contradiction_std", "support_max", "conflict_mass", "top2_margin", "contradiction_top_half", "disagreement")])


@query("""WITH u AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings),
d AS (SELECT label, i, sum(v[i]) AS s, sum(v[i] * v[i]) AS q, count(*) AS n FROM u, range(1, 65) r(i) GROUP BY 1, 2)
SELECT label, max(n) AS n, round(CASE WHEN max(n) < 2 THEN 1.0 ELSE (sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)) END, 6) AS consistency FROM d GROUP BY 1""")
def source_consistency(spark, d):
    return metrics.mean_pairwise_cosine(table(spark, d, "embeddings"), "label", "embedding").select("label", "n", r6("consistency", "consistency"))


@query("""WITH k AS (SELECT CAST(l_discount * 10 AS DOUBLE) AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), g AS (SELECT unnest([0.1, 0.3, 0.5, 0.7]::DOUBLE[]) AS threshold)
SELECT threshold, count(*) FILTER (s >= threshold AND y = 1) AS tp, count(*) FILTER (s >= threshold AND y = 0) AS fp FROM k, g GROUP BY 1""")
def sweep_at_volume(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_discount") * 10).cast("double").alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return metrics.threshold_sweep(rows, "s", "y", [0.1, 0.3, 0.5, 0.7]).select("threshold", "tp", "fp")
