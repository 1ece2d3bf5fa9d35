"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS n, vec_id AS c FROM embeddings
  UNION
  SELECT r.n, l.b FROM reach r JOIN links l ON l.a = r.c
), component AS (SELECT n, min(c) AS c FROM reach GROUP BY n),
counts AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT e.vec_id, coalesce(k, 0) AS n_links, component.c AS component_id, e.vec_id = component.c AS kept
FROM embeddings e JOIN component ON component.n = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id
"""

NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (
  SELECT doc_id AS n, doc_id AS c FROM documents
  UNION
  SELECT r.n, l.b FROM reach r JOIN links l ON l.a = r.c
)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT n, min(c) AS c FROM reach GROUP BY n) r ON r.n = d.doc_id
"""


def _runs(size: int) -> str:
    """Tables of the runs (doc_id, a, b) that strings of `size` bytes which start twice cover, found from the places that start one."""
    return f"""
places{size} AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, {2 * size})) AS h FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - {size - 1})) AS p FROM d WHERE len(x) >= {2 * size})),
twice{size} AS (SELECT h FROM places{size} GROUP BY h HAVING count(*) > 1),
starts{size} AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM places{size} WHERE h IN (SELECT h FROM twice{size})),
runs{size} AS (
  SELECT doc_id, min(p) AS a, max(p) + {size} AS b
  FROM (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + {size} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM starts{size}) GROUP BY doc_id, g
)"""


#: Bytes are pairs of hex digits; for the words of a run, each white byte becomes one mark and all others stay.
SUFFIX_DEDUP = rf"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
{_runs(400)}, {_runs(200)},
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM runs400 WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL
  SELECT doc_id, max(runs400.b), max(len(d.x) // 2) FROM runs400 JOIN d USING (doc_id) GROUP BY doc_id
), kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM runs400 GROUP BY doc_id),
long AS (
  SELECT doc_id, a, b FROM runs200 JOIN d USING (doc_id)
  WHERE len(regexp_extract_all(regexp_replace(regexp_replace(substr(x, 2 * a + 1, 2 * (b - a)), '(..)', '\1 ', 'g'), '(20|09|0A|0B|0C|0D) ', '_', 'g'), '[^_]+')) > 50
), passages AS (SELECT doc_id, sum(b - a) AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM long GROUP BY doc_id)
SELECT d.doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(sums.n, 0) AS BIGINT) AS n_removed, coalesce(sums.k, 0) AS n_spans, sha256(unhex(coalesce(kept.k, x))) AS kept_sha256,
  coalesce(sums.spans, '') AS spans, coalesce(passages.spans, '') AS passages, CAST(coalesce(passages.n, 0) AS BIGINT) AS passage_bytes
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN passages USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op8_suffix_dedup": SUFFIX_DEDUP, "op9_embedding_dedup": EMBEDDING_DEDUP, "op10_ngram_join": NGRAM_JOIN}
