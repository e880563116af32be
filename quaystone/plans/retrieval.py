"""Queries for retrieval, fusion, merging and reranking of whole question sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.functions import text as T
from quaystone.operators import metrics, retrieval
from quaystone.plans.evaluation import r6
from quaystone.plans.registry import query
from quaystone.sources.tables import table

_VECTORS = """scores AS (SELECT q.vec_id AS query_id, c.vec_id AS id, q.label AS ql, c.label AS cl,
round(list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(c.embedding[i] AS DOUBLE))) / nullif(sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(c.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 0), CAST(6 AS INT)) AS score
FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id), hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scores) WHERE rank <= 10)"""


def _neighbours(spark, d, k=10):
    """Every row whose id is divisible by 20, against all rows."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.vector_top_k(rows.where("vec_id % 20 = 0"), rows, k)


@query(f"WITH {_VECTORS} SELECT query_id, id, score, rank FROM hits")
def vector_top_k(spark, d):
    return _neighbours(spark, d)


def _labelled(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    hits = _neighbours(spark, d)
    relevant = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(rows.select(F.col("vec_id").alias("id"), "label"), "label").where("query_id <> id").select("query_id", "id", F.lit(1.0).alias("rel"))
    return hits, relevant


_METRICS = _VECTORS + """, rel AS (SELECT q.vec_id AS query_id, count(*) - 1 AS n_rel FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 20 = 0 GROUP BY 1),
g AS (SELECT query_id, sum(CASE WHEN ql = cl THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (ql = cl) AS h10, count(*) FILTER (ql = cl AND rank <= 3) AS h3, min(CASE WHEN ql = cl THEN rank END) AS first FROM hits GROUP BY 1),
m AS (SELECT g.query_id, CASE WHEN n_rel = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, CAST(least(n_rel, 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg_10, CASE WHEN n_rel = 0 THEN 0 ELSE h10 / n_rel END AS recall_10, h3 / 3 AS precision_3,
CASE WHEN h3 > 0 THEN 1.0 ELSE 0.0 END AS hit_3, coalesce(1.0 / first, 0) AS mrr FROM g JOIN rel USING (query_id))"""


@query(f"WITH {_METRICS} SELECT query_id, round(ndcg_10, 6) AS ndcg_10, round(recall_10, 6) AS recall_10, round(precision_3, 6) AS precision_3, round(hit_3, 6) AS hit_3, round(mrr, 6) AS mrr FROM m")
def ranking_metrics(spark, d):
    hits, relevant = _labelled(spark, d)
    out = metrics.ranking(hits, relevant, "query_id", "id", (3, 10))
    return out.select("query_id", *[r6(c, c) for c in ("ndcg_10", "recall_10", "precision_3", "hit_3", "mrr")])


@query(f"WITH {_METRICS} SELECT count(*) AS queries, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(recall_10), 6) AS recall_10, round(avg(mrr), 6) AS mrr FROM m")
def mean_ranking_metrics(spark, d):
    hits, relevant = _labelled(spark, d)
    out = metrics.ranking(hits, relevant, "query_id", "id", (3, 10))
    return out.agg(F.count("*").alias("queries"), *[r6(F.avg(c), c) for c in ("ndcg_10", "recall_10", "mrr")])


_BM25 = """tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\x0B\\f]+'), lambda t: t <> '') AS ts FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok), un AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM un GROUP BY 1, 2, 3),
raw AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, st GROUP BY 1), me AS (SELECT avg(idf) AS mean_idf FROM raw),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS idf FROM raw, me),
qt AS (SELECT id, term, count(*) AS qtf FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(query), '[ \\t\\n\\r\\x0B\\f]+'), lambda t: t <> '')) AS term FROM questions_finreg WHERE query IS NOT NULL) GROUP BY 1, 2),
bm AS (SELECT id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), CAST(6 AS INT)) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term), st GROUP BY 1, 2),
br AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 20)"""


def _bm25(spark, d, k=20):
    return retrieval.bm25_top_k(table(spark, d, "questions_finreg").select("id", "query"), table(spark, d, "documents").select("doc_id", "text"), "id", "query", "doc_id", "text", k)


@query(f"WITH {_BM25} SELECT id, doc_id, score, rank FROM br")
def bm25_top_k(spark, d):
    return _bm25(spark, d)


_OVERLAP = """ov AS (SELECT id, doc_id, count(*) AS shared FROM (SELECT DISTINCT id, term FROM qt) JOIN (SELECT DISTINCT doc_id, term FROM tf) USING (term) GROUP BY 1, 2),
orank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, doc_id) AS rank FROM ov) WHERE rank <= 20)"""


def _overlap(spark, d, k=20):
    return retrieval.overlap_top_k(table(spark, d, "questions_finreg").select("id", "query"), table(spark, d, "documents").select("doc_id", "text"), "id", "query", "doc_id", "text", k)


@query(f"WITH {_BM25}, {_OVERLAP} SELECT id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT id, doc_id, rank FROM br UNION ALL SELECT id, doc_id, rank FROM orank) GROUP BY 1, 2")
def reciprocal_rank_fusion(spark, d):
    return retrieval.fuse([_bm25(spark, d), _overlap(spark, d)], "id", "doc_id").select("id", "doc_id", r6("score", "score"))


_BUCKETS = "h AS (SELECT id, doc_id, rank, 1 AS bucket FROM br UNION ALL SELECT id, doc_id, rank, 2 FROM orank)"


@query(f"""WITH {_BM25}, {_OVERLAP}, {_BUCKETS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, doc_id ORDER BY bucket, rank) AS x FROM h) WHERE x = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY id, bucket ORDER BY rank) AS r FROM f) SELECT id, doc_id, merged_rank FROM (SELECT id, doc_id, row_number() OVER (PARTITION BY id ORDER BY r, bucket) AS merged_rank FROM r) WHERE merged_rank <= 15""")
def merge_round_robin(spark, d):
    hits = _bm25(spark, d).select("id", "doc_id", "rank", F.lit(1).alias("bucket")).union(_overlap(spark, d).select("id", "doc_id", "rank", F.lit(2)))
    return retrieval.merge_round_robin(hits, "id", "doc_id", "bucket", "rank", 15).select("id", "doc_id", "merged_rank")


@query(f"WITH {_BM25}, {_OVERLAP}, h AS (SELECT id, doc_id, score FROM br UNION ALL SELECT id, doc_id, CAST(shared AS DOUBLE) FROM orank) SELECT id, doc_id, max(score) AS score FROM h GROUP BY 1, 2")
def merge_by_best_score(spark, d):
    hits = _bm25(spark, d).select("id", "doc_id", "score").union(_overlap(spark, d).select("id", "doc_id", F.col("shared").cast("double")))
    return retrieval.merge_by_score(hits, "id", "doc_id")


@query(f"""WITH {_BM25}, j AS (SELECT br.*, jurisdiction AS family FROM br JOIN (SELECT doc_id, any_value(jurisdiction) AS jurisdiction FROM documents GROUP BY 1) USING (doc_id)),
t AS (SELECT *, CASE WHEN family IS NOT NULL AND row_number() OVER (PARTITION BY id, family ORDER BY rank) = 1 THEN 0 ELSE 1 END AS tier FROM j)
SELECT id, doc_id, family, balanced_rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, rank) AS balanced_rank FROM t) WHERE balanced_rank <= 8""")
def balance_families(spark, d):
    hits = _bm25(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("jurisdiction").alias("family")), "doc_id")
    return retrieval.balance_families(hits, "id", "family", "rank", 8).select("id", "doc_id", "family", "balanced_rank")


@query(f"""WITH {_BM25}, j AS (SELECT br.*, source, title FROM br JOIN documents USING (doc_id)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, source ORDER BY rank) AS x FROM j WHERE source IS NOT NULL) WHERE x = 1)
SELECT id, source, doc_id, rank FROM f""")
def dedupe_keep_first(spark, d):
    hits = _bm25(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").where("source is not null")
    return retrieval.keep_first(hits, ["id", "source"], ["rank"]).select("id", "source", "doc_id", "rank")


_STOP = "(" + ",".join(f"'{w}'" for w in T.TITLE_STOPWORDS) + ")"


@query(f"""WITH {_BM25}, j AS (SELECT br.id, br.doc_id, br.score, br.rank, q.query, x.text, x.title FROM br JOIN questions_finreg q USING (id) JOIN documents x ON x.doc_id = br.doc_id WHERE regexp_matches(x.text, '[^ \\t\\n\\r\\x0B\\f]')),
k AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(coalesce(query, '')), '[a-z0-9]+', 0), lambda t: length(t) > 2 AND t NOT IN {_STOP})) AS qk, list_distinct(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+', 0), lambda t: length(t) > 2 AND t NOT IN {_STOP})) AS tk,
len(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\x0B\\f]+'), lambda t: t <> '')) AS n, min(score) OVER (PARTITION BY id) AS lo, max(score) OVER (PARTITION BY id) AS hi FROM j)
SELECT id, doc_id, round(0.2 * CASE WHEN hi = lo THEN 0 ELSE (score - lo) / (hi - lo) END + 0.1 / log2(3 + rank - 1) + 0.03 * (1 - exp(-n / 120.0)) + 0.06 * CASE WHEN len(qk) = 0 THEN 0 ELSE len(list_intersect(qk, tk)) / len(qk) END, 6) AS final_score FROM k""")
def feature_rerank(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "title")
    hits = _bm25(spark, d).join(docs, "doc_id").join(table(spark, d, "questions_finreg").select("id", "query"), "id").withColumn("position", F.col("rank") - 1)
    out = retrieval.rerank_features(hits, "id", "query", "text", "title", "score", "position")
    return out.select("id", "doc_id", r6("final_score", "final_score"))


_SPLIT = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[ \\t\\n\\r\\x0B\\f]+'), lambda t: t <> '')"


@query(f"""WITH {_BM25}, {_OVERLAP}, c AS (SELECT o.id, o.doc_id, {_SPLIT.format('q.query')} AS q, {_SPLIT.format('x.text')} AS d FROM orank o JOIN questions_finreg q USING (id) JOIN documents x USING (doc_id)), z AS (SELECT id, count(*) AS n, avg(len(d)) AS a FROM c GROUP BY 1),
f AS (SELECT id, term, count(*) AS df FROM (SELECT id, unnest(list_distinct(d)) AS term FROM c) GROUP BY 1, 2), w AS (SELECT id, term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM f JOIN z USING (id)), m AS (SELECT id, avg(idf) AS mean FROM w GROUP BY 1),
i AS (SELECT id, term, CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS idf FROM w JOIN m USING (id)), t AS (SELECT id, doc_id, term, len(d) AS dl, len(list_filter(d, lambda x: x = term)) AS tf FROM (SELECT *, unnest(q) AS term FROM c)),
s AS (SELECT id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM t JOIN i USING (id, term) JOIN z USING (id) WHERE tf > 0 GROUP BY 1, 2) SELECT c.id, c.doc_id, round(coalesce(score, 0), 6) AS score FROM c LEFT JOIN s USING (id, doc_id)""")
def bm25_of_candidates(spark, d):
    docs, questions = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "questions_finreg").select("id", "query")
    hits = _overlap(spark, d).select("id", "doc_id").join(docs, "doc_id").join(questions, "id")
    return retrieval.bm25_candidates(hits, "id", "doc_id", "query", "text").select("id", "doc_id", r6("score", "score"))


@query(f"""WITH {_BM25}, j AS (SELECT br.id, br.doc_id, br.score, br.rank, q.query, x.text, x.title, x.page_count FROM br JOIN questions_finreg q USING (id) JOIN documents x ON x.doc_id = br.doc_id WHERE regexp_matches(x.text, '[^ \\t\\n\\r\\x0B\\f]')),
k AS (SELECT *, list_distinct({_SPLIT.format('query')}) AS qs, list_distinct({_SPLIT.format('text')}) AS ds, list_distinct(list_filter(regexp_extract_all(lower(coalesce(query, '')), '[a-z0-9]+', 0), lambda t: length(t) > 2 AND t NOT IN {_STOP})) AS qk, list_distinct(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+', 0), lambda t: length(t) > 2 AND t NOT IN {_STOP})) AS tk,
len({_SPLIT.format('text')}) AS n, min(score) OVER (PARTITION BY id) AS lo, max(score) OVER (PARTITION BY id) AS hi FROM j)
SELECT id, doc_id, round(0.54 * coalesce(len(list_intersect(qs, ds)) / nullif(sqrt(len(qs) * len(ds)), 0), 0) + 0.2 * CASE WHEN hi = lo THEN 0 ELSE (score - lo) / (hi - lo) END + 0.1 / log2(3 + rank - 1) + 0.07 * ln(1 + coalesce(page_count, 0)) + 0.03 * (1 - exp(-n / 120.0)) + 0.06 * CASE WHEN len(qk) = 0 THEN 0 ELSE len(list_intersect(qk, tk)) / len(qk) END, 6) AS final_score FROM k""")
def full_feature_rerank(spark, d):
    """The reranker with all six features: word cosine stands in for a model's similarity, pages for evidence."""
    docs = table(spark, d, "documents").select("doc_id", "text", "title", F.coalesce("page_count", F.lit(0)).alias("pages"))
    hits = _bm25(spark, d).join(docs, "doc_id").join(table(spark, d, "questions_finreg").select("id", "query"), "id").withColumn("position", F.col("rank") - 1)
    q, c = F.array_distinct(retrieval.words(F.coalesce("query", F.lit("")))), F.array_distinct(retrieval.words(F.col("text")))
    hits = hits.withColumn("alike", F.coalesce(F.try_divide(F.size(F.array_intersect(q, c)).cast("double"), F.sqrt((F.size(q) * F.size(c)).cast("double"))), F.lit(0.0)))
    out = retrieval.rerank_features(hits, "id", "query", "text", "title", "score", "position", "alike", "pages")
    return out.select("id", "doc_id", r6("final_score", "final_score"))


@query(f"""WITH {_BM25} SELECT q.type, count(DISTINCT b.id) AS questions, count(*) AS hits, count(DISTINCT b.doc_id) AS documents, round(avg(b.score), 6) AS score, round(avg(CASE WHEN l.theme IS NULL THEN 0.0 ELSE 1.0 END), 6) AS labelled
FROM br b JOIN questions_finreg q USING (id) LEFT JOIN (SELECT id, min(theme) AS theme FROM question_labels GROUP BY 1) l USING (id) WHERE rank <= 5 GROUP BY 1""")
def flagship_grounding(spark, d):
    """Retrieve evidence for every question and report on it by question type."""
    labels = table(spark, d, "question_labels").groupBy("id").agg(F.min("theme").alias("theme"))
    hits = _bm25(spark, d).where("rank <= 5").join(table(spark, d, "questions_finreg").select("id", "type"), "id").join(labels, "id", "left")
    return hits.groupBy("type").agg(F.countDistinct("id").alias("questions"), F.count("*").alias("hits"), F.countDistinct("doc_id").alias("documents"), r6(F.avg("score"), "score"), r6(F.avg(F.when(F.col("theme").isNull(), 0.0).otherwise(1.0)), "labelled"))
