"""DuckDB SQL for the queries that SQL expresses over whole tables.

What has no SQL here rests on fitted models, tokenizer files, random orders or
markup; tests hold those queries against brute force.
"""

from __future__ import annotations

MIX = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat(CASE WHEN source IS NULL THEN '-' ELSE '+' || md5(source) END, '|', coalesce(CAST(doc_id AS VARCHAR), '-'), '|', coalesce(md5(text), '-'))) AS key
  FROM documents),
sums AS (SELECT source, sum(size) AS s FROM docs GROUP BY source),
weighted AS (SELECT source, CAST(s AS DOUBLE) AS s, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sums),
ranked AS (SELECT *, 3 * s AS cap, row_number() OVER (ORDER BY 3 * s / w, source NULLS LAST) AS r FROM weighted),
levels AS (SELECT *, ((SELECT sum(s) FROM ranked) - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
level AS (SELECT arg_min(level, r) FILTER (w * level <= cap) AS level FROM levels),
target AS (SELECT source, s, least(cap, coalesce(w * level.level, cap)) AS target FROM ranked, level),
budget AS (SELECT *, CAST(floor(target + 1e-6) AS BIGINT) AS b, CASE WHEN s > 0 THEN CAST(floor(floor(target + 1e-6) / s) AS BIGINT) ELSE 0 END AS epochs FROM target),
ordered AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM docs)
SELECT o.doc_id, CAST(o.size AS BIGINT) AS size, CAST(t.s AS BIGINT) AS source_size, t.target,
  CAST(t.epochs * o.size + greatest(0, least(o.size, t.b - t.epochs * t.s - o.before)) AS BIGINT) AS taken, t.epochs AS whole_epochs
FROM ordered o JOIN budget t ON o.source IS NOT DISTINCT FROM t.source
"""

NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT DISTINCT x, x FROM edges UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(l.m, d.doc_id) AS component_id, coalesce(l.m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""

VECTORS = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, v, list_transform(v, lambda e: e / list_max(list_transform(v, lambda f: abs(f)))) AS u
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)
  WHERE len(v) > 0 AND len(list_filter(v, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(v, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.u) = len(b.u)
  WHERE list_cosine_similarity(a.u, b.u) >= 0.98),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
counts AS (SELECT x, count(*) AS n FROM edges GROUP BY x),
reach(a, b) AS (SELECT DISTINCT x, x FROM edges UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.vec_id, coalesce(c.n, 0) AS n_links, coalesce(l.m, d.vec_id) AS component_id, coalesce(l.m, d.vec_id) = d.vec_id AS kept
FROM embeddings d LEFT JOIN counts c ON c.x = d.vec_id LEFT JOIN least l ON l.a = d.vec_id
"""

REPEATS = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) / 2 AS BIGINT) - 49)) AS i FROM docs WHERE len(h) >= 100)),
first AS (SELECT w, min(doc_id) AS m FROM windows GROUP BY w),
hits AS (SELECT doc_id, i FROM windows JOIN first USING (w) WHERE m < doc_id),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hits)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM spans),
cut AS (SELECT g.doc_id, string_agg(substr(d.h, 2 * g.c + 1, 2 * (g.a - g.c)), '' ORDER BY g.a) AS head, max(g.b) AS last, sum(g.b - g.a) AS n, count(*) AS k
  FROM gaps g JOIN docs d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, CAST(len(d.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, coalesce(c.k, 0) AS n_spans,
  sha256(unhex(CASE WHEN c.n IS NULL THEN d.h ELSE coalesce(c.head, '') || substr(d.h, 2 * c.last + 1) END)) AS kept_sha256
FROM docs d LEFT JOIN cut c USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op5_repeat_removal": REPEATS,
    "op6_source_mixing": MIX,
    "op8_minhash_near_dedup": NEAR,
    "op10_cap_filters": VECTORS,
}
