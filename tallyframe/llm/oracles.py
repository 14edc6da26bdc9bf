"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS gram FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS MATERIALIZED (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)
), r(id, comp) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.id
), c AS (
  SELECT id, min(comp) AS component_id FROM r GROUP BY id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id::BIGINT AS component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0
), e AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), r(id, comp) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.id
), c AS (
  SELECT id, min(comp) AS component_id FROM r GROUP BY id
), n AS (
  SELECT a, count(*) AS n FROM e GROUP BY a
)
SELECT t.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id::BIGINT AS component_id, t.vec_id = c.component_id AS kept
FROM embeddings t JOIN c ON c.id = t.vec_id LEFT JOIN n ON n.a = t.vec_id
"""

SUBSTRING_DEDUP = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), s AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i+34], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), again AS (
  SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)
), m AS (
  SELECT p.doc_id, p.i, p.word,
    coalesce(max(a.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM p LEFT JOIN again a ON a.doc_id = p.doc_id AND a.i = p.i
), k AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_words, 0)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""

ORACLE_SQL = {"op1_near_dedup": NEAR_DEDUP, "op3_embedding_dedup": NEAR_VECTORS, "op9_substring_dedup": SUBSTRING_DEDUP}
