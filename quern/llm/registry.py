"""Queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from quern.llm import media, mixing, neardup, packing, quality, secrets, sharding, substrings, surrogates, vectors

QUERIES = {
    "op1_pfair_mix": mixing.query,
    "op2_media_columns": media.query,
    "op3_external_shuffle": sharding.query,
    "op4_suffix_tree_dedup": substrings.query,
    "op5_sum_of_squares_packing": packing.query,
    "op6_inverted_multi_index": vectors.query,
    "op7_bbit_minhash": neardup.query,
    "op8_pii_surrogates": surrogates.query,
    "op9_empirical_bayes_quality": quality.query,
    "op10_crf_secrets": secrets.query,
}

WORDS = r"[^\x20\x09-\x0D]+"
REACH = "reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x), comp AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a)"

ORACLE = {
    "op4_suffix_tree_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 49], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w)),
lead AS (SELECT t, min(doc_id) AS lo FROM win GROUP BY t),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(p, p + 50)) AS i FROM win JOIN lead USING (t) WHERE lo < doc_id)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY i) AS k, count(*) AS n FROM each e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = e.doc_id AND g.i = e.i) GROUP BY e.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
""",
    "op6_inverted_multi_index": f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT a.id AS x, b.id AS y FROM nodes a JOIN nodes b ON a.label = b.label AND a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
{REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE x = id) AS n_links, c AS component_id, id = c AS kept FROM comp
""",
    "op7_bbit_minhash": rf"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT id, t FROM (SELECT id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[p] || ' ' || ws[p + 1] END AS t FROM (SELECT id, ws, unnest(range(1, greatest(len(ws), 2))) AS p FROM w WHERE len(ws) > 0))),
nodes AS (SELECT w.id, count(t) AS n FROM w LEFT JOIN s ON w.id = s.id GROUP BY w.id),
shared AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.id < b.id GROUP BY a.id, b.id),
one AS (SELECT x, y FROM shared JOIN nodes p ON p.id = x JOIN nodes q ON q.id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
links AS (SELECT x, y FROM one UNION ALL SELECT y, x FROM one),
{REACH}
SELECT id AS doc_id, n AS n_shingles, c AS component_id, id = c AS kept FROM comp JOIN nodes USING (id)
""",
}
