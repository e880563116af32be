"""Queries that scan files of every kind, keep collections and bundles, and convert raw datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.operators import converters
from quaystone.plans.evaluation import NEWEST, newest, r6
from quaystone.plans.files import _folder
from quaystone.plans.registry import query
from quaystone.sinks import files as sinks
from quaystone.sources import files as sources
from quaystone.sources.tables import table


def _write_lines(spark, d, name: str, line) -> str:
    """One text file with a line for each authority, in order of its number."""
    path = _folder(spark, name)
    table(spark, d, "source_orgs").select("org_id", line.alias("line")).coalesce(1).sortWithinPartitions("org_id").select("line").write.text(path)
    return path


@query("SELECT length(t) AS n_chars, md5(t) AS digest FROM (SELECT string_agg(org_name, chr(10) ORDER BY org_id) || chr(10) AS t FROM source_orgs)")
def text_file_scan(spark, d):
    path = _write_lines(spark, d, "text", F.col("org_name"))
    return sources.text(spark, path).select(F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


@query("SELECT row_number() OVER (ORDER BY org_id) AS line_no, org_name AS content FROM source_orgs")
def text_lines_scan(spark, d):
    path = _write_lines(spark, d, "lines", F.col("org_name"))
    return sources.text(spark, path, "line").select(F.col("metadata")["index"].cast("bigint").alias("line_no"), "content")


@query("SELECT line_no, org_name AS content, source_org FROM (SELECT *, row_number() OVER (ORDER BY org_id) AS line_no FROM source_orgs) WHERE org_id % 7 <> 0")
def jsonl_scan(spark, d):
    """Broken lines are skipped and keep their number."""
    good = F.to_json(F.struct(F.col("org_name").alias("content"), "source_org"))
    path = _write_lines(spark, d, "jsonl-scan", F.when(F.col("org_id") % 7 == 0, F.concat(F.lit("{broken "), "org_name")).otherwise(good))
    return sources.jsonl(spark, path).select(F.col("metadata")["index"].cast("bigint").alias("line_no"), "content", F.col("metadata")["source_org"].alias("source_org"))


def _write_json(spark, d, wrap: str) -> str:
    path = _folder(spark, "json-scan")
    items = F.transform(F.array_sort(F.collect_list(F.struct("org_id", "org_name", "source_org"))), lambda x: F.struct(x["org_name"].alias("content"), x["source_org"].alias("code")))
    table(spark, d, "source_orgs").agg(F.format_string(wrap, F.to_json(items)).alias("value")).coalesce(1).write.text(path)
    return path


@query("SELECT row_number() OVER (ORDER BY org_id) - 1 AS item_no, org_name AS content, source_org AS code FROM source_orgs")
def json_array_scan(spark, d):
    docs = sources.json(spark, _write_json(spark, d, "%s"))
    return docs.select(F.col("metadata")["index"].cast("bigint").alias("item_no"), "content", F.col("metadata")["code"].alias("code"))


@query("SELECT row_number() OVER (ORDER BY org_id) - 1 AS item_no, org_name AS content FROM source_orgs")
def json_documents_key_scan(spark, d):
    docs = sources.json(spark, _write_json(spark, d, '{"version": 1, "documents": %s}'))
    return docs.select(F.col("metadata")["index"].cast("bigint").alias("item_no"), "content")


@query("SELECT string_agg(org_name || ' & Co', ' ' ORDER BY org_id) AS content FROM source_orgs")
def html_scan(spark, d):
    page = F.concat(F.lit("<p class='x'>"), "org_name", F.lit(" &amp; Co</p><script>var a = 1;</script><!-- hidden -->"))
    return sources.html(spark, _write_lines(spark, d, "html", page)).select("content")


@query("SELECT 'json' AS loader, count(*) AS n FROM source_orgs UNION ALL SELECT 'text', 1")
def directory_scan(spark, d):
    """A folder with a text file and a file of JSON lines; files of unknown kinds are left alone."""
    root = _folder(spark, "folder")
    rows = table(spark, d, "source_orgs")
    rows.select(F.to_json(F.struct(F.col("org_name").alias("content"))).alias("value")).coalesce(1).write.text(f"{root}/a")
    rows.agg(F.max("org_name").alias("value")).coalesce(1).write.text(f"{root}/b")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for part, suffix in (("a", "jsonl"), ("b", "txt")):
        home = fs.Path(f"{root}/{part}")
        system = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for f in system.listStatus(home):
            if f.getPath().getName().endswith(".txt"):
                system.rename(f.getPath(), fs.Path(f"{root}/{part}.{suffix}"))
        system.delete(home, True)
    return sources.directory(spark, root).groupBy(F.col("metadata")["loader"].alias("loader")).agg(F.count("*").alias("n"))


_COSINE = "round(list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(c.embedding[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(c.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), CAST(6 AS INT))"


@query(f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS id FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.id, {_COSINE} AS score FROM n q JOIN n c ON q.vec_id % 20 = 0 AND c.label = 3)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5 AND score >= 0.1""")
def collection_search(spark, d):
    """Search of a rebuilt collection: a metadata filter before it, a threshold after it."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.col("vec_id").cast("string").alias("content"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    store = sinks.Collection(spark, _folder(spark, "searched"))
    store.add(rows.where("vec_id % 2 = 0"), "vec_id")
    store.ensure(rows, "vec_id")  # too few rows: dropped and built anew
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return store.search(asked, 5, F.col("metadata")["label"] == "3", 0.1).select("query_id", "id", "score", "rank")


@query(f"""WITH {NEWEST} SELECT 'overall' AS field, 'all' AS value, count(*) AS n, round(avg(u_epi), 6) AS u_epi FROM newest UNION ALL SELECT 'action', coalesce(action, 'unknown'), count(*), round(avg(u_epi), 6) FROM newest GROUP BY 2""")
def evaluation_bundle(spark, d):
    path = _folder(spark, "bundle")
    sinks.bundle(newest(spark, d, "action", "u_epi", "is_abstain"), path, ["action"], ["u_epi"], "is_abstain")
    overall = spark.read.json(f"{path}/overall").select(F.lit("overall").alias("field"), F.lit("all").alias("value"), "n", "u_epi")
    return overall.union(spark.read.json(f"{path}/by_field").select("field", "value", "n", "u_epi")).select("field", "value", "n", r6("u_epi", "u_epi"))


_CASES = "c AS (SELECT DISTINCT id, topic, label_detail, query, candidate_answer, report_note FROM controlled_candidate_cases)"


def _cases(spark, d):
    return table(spark, d, "controlled_candidate_cases").select("id", "topic", "label_detail", "query", "candidate_answer", "report_note").distinct()


def _shown(df):
    return df.select("id", "label", "kind", F.md5("premise").alias("premise"), F.md5("hypothesis").alias("hypothesis"))


_SHOWN = "SELECT id, CAST(label AS INT) AS label, kind, md5(premise) AS premise, md5(hypothesis) AS hypothesis FROM r WHERE trim(premise, ' ') <> '' AND trim(hypothesis, ' ') <> ''"


@query("""WITH d AS (SELECT DISTINCT id, lower(label) AS label, premise, hypothesis, metadata.theme AS theme FROM detector_eval_finreg_v1), r AS (SELECT id, hypothesis, CASE label WHEN 'entailment' THEN 0 WHEN 'contradiction' THEN 2 ELSE 1 END AS label, 'claim' AS kind, unnest(list_distinct([premise, theme])) AS premise FROM d)
""" + _SHOWN)
def converted_claims(spark, d):
    rows = table(spark, d, "detector_eval_finreg_v1").select("id", F.lower("label").alias("label"), "premise", "hypothesis", F.col("metadata.theme").alias("theme")).distinct()
    named = F.when(F.col("label") == "entailment", "Supports").when(F.col("label") == "contradiction", "REFUTED").otherwise("not enough info")
    return _shown(converters.claims(rows.select("id", F.col("hypothesis").alias("claim"), named.alias("label"), F.array("premise", "theme").alias("evidence"))))


@query(f"""WITH {_CASES}, s AS (SELECT id, unnest([{{'q': query, 'a': candidate_answer, 'o': report_note}}, {{'q': topic, 'a': report_note, 'o': candidate_answer}}], recursive := true) FROM c),
b AS (SELECT id, a, o, concat_ws(' ', q, a) AS premise FROM s), r AS (SELECT id, premise, 'The answer is ' || a || '.' AS hypothesis, 0 AS label, 'pair' AS kind FROM b UNION ALL SELECT id, premise, 'The answer is ' || o || '.', 1, 'mismatch' FROM b UNION ALL SELECT id, premise, 'The answer is not ' || a || '.', 2, 'denial' FROM b)
""" + _SHOWN)
def converted_question_pairs(spark, d):
    pair = lambda q, a: F.struct(F.col(q).alias("question"), F.col(a).alias("answer"))
    return _shown(converters.question_pairs(_cases(spark, d).select("id", F.col("query").alias("question"), F.array(pair("query", "candidate_answer"), pair("topic", "report_note")).alias("pairs"))))


@query(f"""WITH {_CASES}, s AS (SELECT id, candidate_answer AS premise, unnest([report_note, topic]) AS x FROM c), r AS (SELECT id, premise, x AS hypothesis, 0 AS label, 'claim' AS kind FROM s UNION ALL
SELECT id, premise, 'It may be that ' || lower(substring(x, 1, 1)) || substring(x, 2), 1, 'hedged' FROM s UNION ALL SELECT id, premise, 'It is not true that ' || lower(substring(x, 1, 1)) || substring(x, 2), 2, 'negated' FROM s)
""" + _SHOWN)
def converted_long_answers(spark, d):
    return _shown(converters.long_answers(_cases(spark, d).select("id", F.col("candidate_answer").alias("answer"), F.array("report_note", "topic").alias("claims"))))


@query(f"""WITH {_CASES}, r AS (SELECT id, query AS premise, 'The question has several readings.' AS hypothesis, CASE WHEN label_detail = 'partial' THEN 0 ELSE 2 END AS label, 'ambiguity' AS kind FROM c UNION ALL SELECT id, query, report_note, 1, 'clarification' FROM c) """ + _SHOWN)
def converted_clarifications(spark, d):
    # a case delivered under two readings is two rows
    rows = _cases(spark, d).groupBy("id", "query", "label_detail", "report_note").agg(F.count("*").alias("times"))
    keyed = rows.select(F.struct("id", "query", "label_detail", "report_note").alias("id"), F.col("query").alias("question"), (F.col("label_detail") == "partial").alias("ambiguous"), F.col("report_note").alias("clarification"), "times")
    out = converters.clarifications(keyed)
    again = out.join(keyed.select("id", "times"), "id").withColumn("_c", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    return again.select(F.col("id.id").alias("id"), "label", "kind", F.md5("premise").alias("premise"), F.md5("hypothesis").alias("hypothesis"))


@query(f"""WITH {_CASES}, r AS (SELECT id, concat_ws(' ', topic, query) AS premise, candidate_answer AS hypothesis, 0 AS label, 'condition' AS kind FROM c UNION ALL SELECT id, query, topic, 1, 'assumption' FROM c UNION ALL SELECT id, report_note, query, 1, 'context' FROM c) """ + _SHOWN)
def converted_conditions(spark, d):
    one = F.array(F.struct(F.col("topic").alias("condition"), F.col("candidate_answer").alias("answer")))
    return _shown(converters.conditions(_cases(spark, d).select("id", F.col("query").alias("question"), one.alias("properties"), F.col("report_note").alias("context"))))


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY org_id) AS n, * FROM source_orgs) SELECT n AS id, source_org AS premise, 'The word ''' || lower(source_org) || ''' means the same as in: ' || org_name AS hypothesis, org_id % 3 = 0 AS entailed FROM o""")
def converted_word_senses(spark, d):
    """Two files joined line by line; which of the other pairs are neutral is a matter of their hash."""
    data = _write_lines(spark, d, "senses", F.concat_ws("\t", F.lower("source_org"), F.lit("N"), F.lit("0-1"), "source_org", "org_name"))
    gold = _write_lines(spark, d, "gold", F.when(F.col("org_id") % 3 == 0, "T").otherwise("F"))
    numbered = lambda p: sources.text(spark, p, "line").select(F.col("metadata")["index"].cast("bigint").alias("line_no"), "content")
    rows = converters.word_senses(numbered(data).withColumnRenamed("content", "line"), numbered(gold).withColumnRenamed("content", "gold"))
    return rows.select("id", "premise", "hypothesis", (F.col("label") == 0).alias("entailed"))


@query("""WITH d AS (SELECT DISTINCT id, premise, hypothesis, CASE lower(label) WHEN 'entailment' THEN 0 WHEN 'neutral' THEN 1 WHEN 'contradiction' THEN 2 END AS label FROM detector_eval_finreg_v1), o AS (SELECT *, row_number() OVER (PARTITION BY premise, hypothesis ORDER BY id, label) AS n FROM d WHERE trim(premise, ' ') <> '' AND trim(hypothesis, ' ') <> '' AND label IS NOT NULL)
SELECT id, label, md5(premise) AS premise, md5(hypothesis) AS hypothesis FROM o WHERE n = 1""")
def validated_pairs(spark, d):
    number = F.when(F.lower("label") == "entailment", 0).when(F.lower("label") == "neutral", 1).when(F.lower("label") == "contradiction", 2)
    rows = table(spark, d, "detector_eval_finreg_v1").select("id", "premise", "hypothesis", number.alias("label")).distinct()
    return converters.valid(rows).select("id", "label", F.md5("premise").alias("premise"), F.md5("hypothesis").alias("hypothesis"))


@query("""WITH a AS (SELECT id, 'cases' AS dataset, 1.5 AS w FROM (SELECT DISTINCT id FROM controlled_candidate_cases)), b AS (SELECT id, 'records' AS dataset, 0.4 AS w FROM (SELECT DISTINCT id FROM detector_eval_finreg_v1)), u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
n AS (SELECT dataset, CAST(floor(count(*) * any_value(w)) AS BIGINT) AS want, CAST(ceil(floor(count(*) * any_value(w)) / count(*)) AS BIGINT) AS copies FROM u GROUP BY 1),
c AS (SELECT id, dataset, want, unnest(range(1, copies + 1)) AS copy_index FROM u JOIN n USING (dataset)) SELECT id, CAST(copy_index AS INT) AS copy_index, dataset FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY copy_index, sha256('42:' || id)) AS k FROM c) WHERE k <= want""")
def weighted_merge(spark, d):
    ids = lambda t: table(spark, d, t).select("id").distinct()
    return converters.merged({"cases": (ids("controlled_candidate_cases"), 1.5), "records": (ids("detector_eval_finreg_v1"), 0.4)}).select("id", "copy_index", "dataset")
