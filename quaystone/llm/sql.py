"""SQL of the training-data queries that DuckDB can answer on whole small tables, by plain counting and pairing."""

from __future__ import annotations

_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"

P1 = """WITH RECURSIVE known AS (SELECT org_key, min(org_id) AS org_id FROM (SELECT org_id, regexp_replace(lower(name), '[^\\p{L}\\p{N}]', '', 'g') AS org_key FROM (SELECT org_id, unnest(list_concat([source_org, org_name], coalesce(aliases, []))) AS name FROM source_orgs)) WHERE org_key <> '' GROUP BY 1),
keyed AS (SELECT id, nullif(regexp_replace(regexp_replace(regexp_replace(lower(metadata.source_file), '[\\\\/]+', '/', 'g'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '^(\\./|/)', ''), '') AS f, nullif(regexp_replace(lower(metadata.source_org), '[^\\p{L}\\p{N}]', '', 'g'), '') AS org_key FROM detector_eval_finreg_v1),
ends AS (SELECT id, 'f:' || f AS f, CASE WHEN org_id IS NOT NULL THEN 'o:' || org_id WHEN org_key IS NOT NULL THEN 'n:' || org_key END AS o, org_id FROM keyed LEFT JOIN known USING (org_key)),
edges AS (SELECT DISTINCT f AS a, o AS b FROM ends WHERE f IS NOT NULL AND o IS NOT NULL), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
vertices AS (SELECT f AS v FROM ends WHERE f IS NOT NULL UNION SELECT o FROM ends WHERE o IS NOT NULL), reach AS (SELECT v, v AS u FROM vertices UNION SELECT r.v, e.b FROM reach r JOIN both_ways e ON e.a = r.u),
orgs AS (SELECT DISTINCT o AS u, org_id FROM ends WHERE org_id IS NOT NULL), smallest AS (SELECT v, min(org_id) AS group_org_id FROM reach LEFT JOIN orgs USING (u) GROUP BY 1)
SELECT DISTINCT id, group_org_id FROM ends JOIN smallest ON v = coalesce(f, o)"""

P2 = """WITH l AS (SELECT d.rowid AS doc, doc_id, source, i AS line_no, p[i] AS line FROM (SELECT rowid, doc_id, source, string_split(text, chr(10)) AS p FROM (SELECT row_number() OVER () AS rowid, * FROM documents) WHERE text IS NOT NULL AND source IS NOT NULL) d, unnest(range(1, len(p) + 1)) u(i)),
k AS (SELECT *, regexp_replace(lower(line), '[\\p{Z}\\t\\n\\x0B\\f\\r\\x{85}\\x1c-\\x1f0-9]+', '', 'g') AS key FROM l WHERE regexp_matches(line, '\\p{L}')), n AS (SELECT source, count(*) AS n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1),
s AS (SELECT source, key, count(DISTINCT doc) AS support FROM k GROUP BY 1, 2), f AS (SELECT source, key FROM s JOIN n USING (source) WHERE support >= 5 AND support >= 0.2 * n) SELECT DISTINCT doc_id, line_no FROM k JOIN f USING (source, key)"""

P3 = f"""WITH t AS (SELECT 'detector_eval_finreg_v1' AS table_name, id, premise AS text FROM detector_eval_finreg_v1 UNION SELECT 'controlled_candidate_cases', id, query FROM controlled_candidate_cases),
w AS (SELECT *, list_distinct({_WORDS.format('text')}) AS ws FROM t WHERE text IS NOT NULL), s AS (SELECT * FROM w WHERE len(ws) > 0)
SELECT DISTINCT a.table_name, a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.table_name = b.table_name AND a.id < b.id AND a.text <> b.text AND least(len(a.ws), len(b.ws)) * 10 >= 7 * greatest(len(a.ws), len(b.ws)) WHERE len(list_intersect(a.ws, b.ws)) * 17 >= 7 * (len(a.ws) + len(b.ws))"""

P7 = f"""WITH r AS (SELECT DISTINCT id, unnest([premise, hypothesis]) AS t FROM detector_eval_finreg_v1), rw AS (SELECT id, {_WORDS.format('t')} AS w FROM r WHERE t IS NOT NULL), dw AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
rg AS (SELECT DISTINCT id, array_to_string(w[i:i + 11], ' ') AS g FROM rw, unnest(range(1, len(w) - 10)) u(i)), dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM dw, unnest(range(1, len(w) - 10)) u(i))
SELECT DISTINCT doc_id, id FROM dg JOIN rg USING (g)"""

SQL = {"p1_found": P1, "p2_found": P2, "p3_found": P3, "p7_found": P7}
