"""Queries for scanning, cleaning and chunking texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.functions import text as T
from quaystone.operators import chunking, verify
from quaystone.plans.evaluation import r6
from quaystone.plans.registry import query
from quaystone.sources.tables import table

_B = "[ \\t\\n\\r\\x0B\\f]"
_STRIP = "regexp_replace({0}, '^" + _B + "+|" + _B + "+$', '', 'g')"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("""SELECT coalesce(source_type, 'unknown') AS source_type, count(*) AS n, sum(length(text)) AS chars, count(DISTINCT source) AS sources, count(*) FILTER (n_chars <> length(text)) AS stale FROM documents GROUP BY 1""")
def document_statistics(spark, d):
    rows = table(spark, d, "documents")
    return rows.groupBy(F.coalesce("source_type", F.lit("unknown")).alias("source_type")).agg(F.count("*").alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars"), F.countDistinct("source").alias("sources"), F.count_if(F.col("n_chars") != F.length("text")).alias("stale"))


_PARTS = "SELECT doc_id, part_no, length(part) AS n_chars, md5(part) AS digest FROM (SELECT doc_id, i AS part_no, " + _STRIP.format("p[i]") + " AS part FROM (SELECT doc_id, string_split(text, '{sep}') AS p FROM documents WHERE text IS NOT NULL), unnest(range(1, len(p) + 1)) u(i)) WHERE part <> ''"


@query(_PARTS.replace("'{sep}'", "chr(10) || chr(10)"))
def paragraph_scan(spark, d):
    return chunking.parts(docs(spark, d), "\n\n").select("doc_id", "part_no", F.length("part").alias("n_chars"), F.md5("part").alias("digest"))


@query(_PARTS.replace("'{sep}'", "chr(10)"))
def line_scan(spark, d):
    return chunking.parts(docs(spark, d), "\n").select("doc_id", "part_no", F.length("part").alias("n_chars"), F.md5("part").alias("digest"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(range(0, length(text), 462), lambda i: substring(text, CAST(i + 1 AS BIGINT), 512)), lambda c: """ + _STRIP.format("c") + """ <> '') AS cs FROM documents WHERE length(text) > 0)
SELECT doc_id, i - 1 AS chunk_index, len(cs) AS total_chunks, md5(cs[i]) AS digest FROM s, unnest(range(1, len(cs) + 1)) u(i)""")
def fixed_chunks(spark, d):
    return chunking.fixed(docs(spark, d)).select("doc_id", "chunk_index", "total_chunks", F.md5("chunk").alias("digest"))


_SENTENCES = "sents AS (SELECT doc_id, i AS sent_no, " + _STRIP.format("p[i]") + " AS s FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])" + _B + "+([A-ZА-Я])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(1))), unnest(range(1, len(p) + 1)) u(i))"


@query(f"WITH {_SENTENCES} SELECT doc_id, sent_no, md5(s) AS digest FROM sents WHERE s <> ''")
def sentence_scan(spark, d):
    return chunking.sentences(docs(spark, d)).select("doc_id", "sent_no", F.md5("sentence").alias("digest"))


@query(f"""WITH {_SENTENCES}, k AS (SELECT * FROM sents WHERE s <> ''), r AS (SELECT doc_id, sent_no, s || ' ' || lead(s, 1) OVER w || ' ' || lead(s, 2) OVER w AS p FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY sent_no)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, substring(lower(p), 1, 240) ORDER BY sent_no) AS n FROM r WHERE length(p) BETWEEN 220 AND 900)
SELECT doc_id, sent_no, md5(p) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_no) AS m FROM f WHERE n = 1) WHERE m <= 18""")
def sliding_passages(spark, d):
    return chunking.passages(chunking.sentences(docs(spark, d))).select("doc_id", "sent_no", F.md5("passage").alias("digest"))


@query("""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '""" + _B + """+', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest, sha256(t) AS sha FROM n""")
def squeezed_text(spark, d):
    t = T.squeeze(F.col("text"))
    return docs(spark, d).where("text is not null").select("doc_id", t.alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"), F.sha2("t", 256).alias("sha"))


@query("""WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '""" + _B + """+', ' ', 'g'), ' ') AS line FROM documents WHERE text IS NOT NULL), w AS (SELECT *, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM l),
h AS (SELECT doc_id, length(line) BETWEEN 1 AND 120 AND NOT regexp_matches(line, '[.?!;:]$') AND (regexp_matches(line, '^[0-9]+(\\.[0-9]+)*[.)]? +[A-Z]') OR (len(ws) BETWEEN 2 AND 12 AND len(list_filter(ws, lambda x: regexp_matches(x, '^[0-9]+$'))) = 0 AND len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]'))) >= greatest(2, len(ws) - 1))) AS h FROM w)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (h) AS headings FROM h GROUP BY 1""")
def heading_lines(spark, d):
    lines = docs(spark, d).where("text is not null").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("line", T.squeeze("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.is_heading(F.col("line"))).alias("headings"))


_SECTIONS = """WITH l AS (SELECT doc_id, i, trim(regexp_replace(p[i], '""" + _B + """+', ' ', 'g'), ' ') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL), unnest(range(1, len(p) + 1)) u(i)),
w AS (SELECT *, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM l),
k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN length(line) <= 120 AND NOT regexp_matches(line, '[.?!;:]$') AND (regexp_matches(line, '^[0-9]+(\\.[0-9]+)*[.)]? +[A-Z]') OR (len(ws) BETWEEN 2 AND 12 AND len(list_filter(ws, lambda x: regexp_matches(x, '^[0-9]+$'))) = 0 AND len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]'))) >= greatest(2, len(ws) - 1))) THEN 'heading' ELSE 'text' END AS kind FROM w),
s AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN line END IGNORE NULLS) OVER x AS heading, sum(CASE WHEN kind <> 'text' THEN 1 ELSE 0 END) OVER x AS island FROM k WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
b AS (SELECT doc_id, min(i) AS f, max(heading) AS heading, string_agg(line, ' ' ORDER BY i) AS block FROM s WHERE kind = 'text' GROUP BY doc_id, island)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS block_no, heading, md5(block) AS digest FROM b"""


def section_blocks_sql(page: str) -> str:
    """The SQL of the section blocks with page lines, which set the page and close a block."""
    marked = _SECTIONS.replace("CASE WHEN line = '' THEN 'blank'", f"CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '{page}') THEN 'page'")
    marked = marked.replace("AS heading, sum(", "AS heading, last_value(CASE WHEN kind = 'page' THEN CAST(regexp_extract(line, '([0-9]+)$', 1) AS INT) END IGNORE NULLS) OVER x AS page, sum(")
    return marked.replace("max(heading) AS heading,", "max(heading) AS heading, max(page) AS page,").replace("block_no, heading,", "block_no, page, heading,")


@query(_SECTIONS)
def section_blocks(spark, d):
    return chunking.sections(docs(spark, d)).select("doc_id", "block_no", "heading", F.md5("block").alias("digest"))


@query()
def boundary_aware_chunks(spark, d):
    return chunking.boundary_aware(docs(spark, d))


@query()
def packed_segments(spark, d):
    return chunking.segments(docs(spark, d))


@query()
def section_chunks(spark, d):
    return chunking.by_section(chunking.sections(docs(spark, d)))


@query()
def semantic_chunks(spark, d):
    return chunking.semantic(docs(spark, d))


@query()
def paragraph_chunks(spark, d):
    return chunking.paragraphs(docs(spark, d))


@query()
def citation_paragraphs(spark, d):
    return chunking.numbered_paragraphs(docs(spark, d))


@query()
def cleaned_text(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", chunking.clean(F.col("text")).alias("text"))


@query("""WITH w AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(candidate_answer, '')), '""" + _B + """+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT id, candidate_answer FROM controlled_candidate_cases)),
g AS (SELECT *, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END AS g FROM w)
SELECT id, len(w) AS words, round(CASE WHEN len(w) = 0 THEN 0 ELSE coalesce(list_max(list_transform(list_filter(w, lambda x: length(x) > 3), lambda x: len(list_filter(w, lambda y: y = x)))), 0) / len(w) END, 6) AS top_share,
coalesce(list_max(list_transform(g, lambda x: len(list_filter(g, lambda y: y = x)))), 0) AS top_gram FROM g""")
def repetition_signals(spark, d):
    rows = table(spark, d, "controlled_candidate_cases").select("id", "candidate_answer").distinct()
    return verify.repetition(rows, "candidate_answer").select("id", "words", r6("top_share", "top_share"), "top_gram")


@query("""WITH m AS (SELECT DISTINCT id, regexp_replace(lower(metadata.source_file), '[\\\\/]+', '/', 'g') AS p FROM detector_eval_finreg_v1 WHERE metadata.source_file IS NOT NULL)
SELECT id, p, nullif(regexp_extract(p, '([^/]+)\\.[a-z]+ *$', 1), '') AS stem, nullif(regexp_extract(p, '_([a-z]+)_[0-9]+\\.', 1), '') AS kind, regexp_replace(regexp_replace(p, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM m""")
def path_metadata(spark, d):
    p = F.regexp_replace(F.lower("metadata.source_file"), r"[\\/]+", "/")
    rows = table(spark, d, "detector_eval_finreg_v1").where("metadata.source_file is not null").select("id", p.alias("p")).distinct()
    part = lambda r: F.nullif(F.regexp_extract("p", r, 1), F.lit(""))
    return rows.select("id", "p", part(r"([^/]+)\.[a-z]+ *$").alias("stem"), part(r"_([a-z]+)_[0-9]+\.").alias("kind"), T.slug(F.col("p")).alias("slug"))
