"""Queries for sampling, splitting, balancing and set operations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quaystone.operators import sampling
from quaystone.plans.evaluation import r6
from quaystone.plans.registry import query
from quaystone.sources.tables import table

_ROWS = "rows AS (SELECT id, min(lower(coalesce(label, 'unknown'))) AS label FROM detector_eval_finreg_v1 GROUP BY id), keyed AS (SELECT *, sha256('42:' || id) AS k FROM rows)"


def _rows(spark, d):
    return table(spark, d, "detector_eval_finreg_v1").groupBy("id").agg(F.min(F.lower(F.coalesce("label", F.lit("unknown")))).alias("label"))


@query(f"WITH {_ROWS} SELECT id, label FROM keyed ORDER BY k, id LIMIT 50")
def hash_sample(spark, d):
    return sampling.sample(_rows(spark, d), 50, "id")


@query(f"WITH {_ROWS} SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, id) AS n FROM keyed) WHERE n <= 20")
def stratified_sample(spark, d):
    return sampling.stratified(_rows(spark, d), "label", 20, "id").select("id", "label")


@query(f"""WITH {_ROWS}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM keyed)
SELECT id, label, CASE WHEN i < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN i < floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM o""")
def stratified_split(spark, d):
    return sampling.split(_rows(spark, d), "label", (0.8, 0.1), "id").select("id", "label", "split")


@query(f"WITH {_ROWS}, c AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM rows GROUP BY label)) SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, id) AS n FROM keyed), c WHERE n <= m")
def balance_under(spark, d):
    return sampling.balance(_rows(spark, d), "label", "id").select("id", "label")


@query(f"""WITH {_ROWS}, s AS (SELECT label, count(*) AS c FROM rows GROUP BY 1), m AS (SELECT max(c) AS m FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, id) AS n FROM keyed)
SELECT id, label, CAST(unnest(range(1, CAST(m // c + CASE WHEN n <= m % c THEN 1 ELSE 0 END AS BIGINT) + 1)) AS INT) AS copy_index FROM o JOIN s USING (label), m""")
def balance_over(spark, d):
    return sampling.balance(_rows(spark, d), "label", "id", "over").select("id", "label", "copy_index")


@query(f"WITH {_ROWS} SELECT id, label, CAST(r.i AS INT) AS copy_index FROM rows, range(1, 4) r(i)")
def replicate(spark, d):
    return sampling.replicate(_rows(spark, d), 3)


@query(f"WITH {_ROWS} SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, id) AS n FROM keyed) ORDER BY n, label LIMIT 40")
def round_robin_sample(spark, d):
    return sampling.round_robin(_rows(spark, d), "label", 40, "id")


@query(f"""WITH {_ROWS}, t AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY k, id) <= CASE label WHEN 'entailment' THEN 10 WHEN 'contradiction' THEN 15 ELSE 0 END THEN 0 ELSE 1 END AS tier FROM keyed)
SELECT id, label FROM t ORDER BY tier, k, id LIMIT 60""")
def bucket_fill(spark, d):
    return sampling.fill(_rows(spark, d), "label", {"entailment": 10, "contradiction": 15}, 60, "id")


@query(f"""WITH {_ROWS}, n AS (SELECT unnest(['entailment', 'neutral', 'contradiction', 'absent']) AS label), c AS (SELECT label, count(*) AS n FROM rows GROUP BY 1)
SELECT label, coalesce(c.n, 0) AS n, round(CASE WHEN c.n IS NULL THEN 1.0 ELSE (SELECT sum(c.n) FROM c JOIN n USING (label)) / (4 * c.n) END, 6) AS weight FROM n LEFT JOIN c USING (label)""")
def class_weights(spark, d):
    return sampling.class_weights(_rows(spark, d), "label", ["entailment", "neutral", "contradiction", "absent"]).select("label", "n", r6("weight", "weight"))


@query("""SELECT lower(coalesce(label, 'unknown')) AS label, count(*) AS n, count(DISTINCT id) AS ids, round(avg(len(list_filter(regexp_split_to_array(premise, '[ \\t\\n\\r\\x0B\\f]+'), lambda w: w <> ''))), 6) AS premise_words,
max(len(list_filter(regexp_split_to_array(hypothesis, '[ \\t\\n\\r\\x0B\\f]+'), lambda w: w <> ''))) AS longest_hypothesis FROM detector_eval_finreg_v1 GROUP BY 1""")
def dataset_statistics(spark, d):
    n_words = lambda c: F.size(F.filter(F.split(c, r"[ \t\n\r\x0B\f]+"), lambda w: w != ""))
    rows = table(spark, d, "detector_eval_finreg_v1")
    longest = F.max(F.when(F.col("hypothesis").isNotNull(), n_words("hypothesis"))).cast("bigint")
    return rows.groupBy(F.lower(F.coalesce("label", F.lit("unknown"))).alias("label")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), r6(F.avg(F.when(F.col("premise").isNotNull(), n_words("premise"))), "premise_words"), longest.alias("longest_hypothesis"))


@query("""WITH o AS (SELECT id, query, lower(regexp_replace(trim(query), '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g')) AS key FROM controlled_candidate_cases WHERE query IS NOT NULL)
SELECT id, query FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id, query) AS n FROM o) WHERE n = 1""")
def ordered_distinct(spark, d):
    key = F.lower(F.regexp_replace(F.trim("query"), r"[ \t\n\r\x0B\f]+", " "))
    rows = table(spark, d, "controlled_candidate_cases").where("query is not null").select("id", "query", key.alias("key"))
    return rows.groupBy("key").agg(F.min(F.struct("id", "query")).alias("x")).select("x.*")


@query(f"WITH {_ROWS} SELECT label, lpad(CAST(n AS VARCHAR), 4, '0') AS number, id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS n FROM rows)")
def numbered_per_label(spark, d):
    n = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    return _rows(spark, d).select("label", F.lpad(n.cast("string"), 4, "0").alias("number"), "id")


@query("SELECT DISTINCT id FROM gate_details WHERE id IS NOT NULL EXCEPT SELECT id FROM questions_finreg")
def id_difference(spark, d):
    return table(spark, d, "gate_details").where("id is not null").select("id").subtract(table(spark, d, "questions_finreg").select("id"))


@query("""SELECT id, kind || '_' || CAST(n AS VARCHAR) AS pair, kind, text FROM (SELECT id, unnest([{'kind': 'entailment', 'n': 1, 'text': candidate_answer}, {'kind': 'neutral', 'n': 2, 'text': report_note}, {'kind': 'question', 'n': 3, 'text': query}], recursive := true) FROM (SELECT DISTINCT id, candidate_answer, report_note, query FROM controlled_candidate_cases)) WHERE text IS NOT NULL AND regexp_matches(text, '[^ ]')""")
def explode_to_pairs(spark, d):
    rows = table(spark, d, "controlled_candidate_cases").select("id", "candidate_answer", "report_note", "query").distinct()
    pair = lambda kind, n, c: F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("n"), F.col(c).alias("text"))
    out = rows.select("id", F.explode(F.array(pair("entailment", 1, "candidate_answer"), pair("neutral", 2, "report_note"), pair("question", 3, "query"))).alias("x")).select("id", "x.*")
    return out.where(F.col("text").rlike("[^ ]")).select("id", F.concat_ws("_", "kind", "n").alias("pair"), "kind", "text")
