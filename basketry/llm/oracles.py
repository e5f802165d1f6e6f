"""DuckDB SQL of the operators that SQL can express.

The others have none: XXH64 (op4), BPE merges (op2, op13), crc32 (op3) and fitted
models (op5, op6, op8, op9) are tested against brute-force versions.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op1_topk"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rnk FROM s
)
SELECT query_id, CAST(rnk AS INTEGER) AS rank, vec_id, score FROM r WHERE rnk <= 10
"""

ORACLE["op7_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents
), t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, CAST(source_size AS DOUBLE) * 2 AS cap FROM t
), x AS (
  SELECT *, CAST([5, 2, 1][(place - 1) % 3 + 1] AS DOUBLE) AS wt FROM w
), l AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () * 1.5
             - coalesce(sum(cap) OVER (ORDER BY cap / wt, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(wt) OVER (ORDER BY cap / wt, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM x
), p AS (
  SELECT source, source_size, least(cap, wt * max(lvl) OVER ()) AS target FROM l
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM p
), g AS (
  SELECT source, h, sum(size) AS words, max(size) AS each FROM d GROUP BY source, h
), c AS (
  SELECT g.source, g.h, b.target - b.whole * CAST(b.source_size AS DOUBLE) AS budget,
         sum(g.words) OVER (PARTITION BY g.source ORDER BY g.h) AS upto
  FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source
), u AS (
  SELECT source, min(CASE WHEN upto > budget THEN h END) AS tau,
         max(budget) - coalesce(max(CASE WHEN upto <= budget THEN upto END), 0) AS rest
  FROM c GROUP BY source
), k AS (
  SELECT u.source, u.tau, CASE WHEN g.each > 0 THEN CAST(floor(u.rest / g.each) AS BIGINT) ELSE 0 END AS fit,
         u.rest - CASE WHEN g.each > 0 THEN CAST(floor(u.rest / g.each) AS BIGINT) ELSE 0 END * coalesce(g.each, 0) AS rest
  FROM u LEFT JOIN g ON g.source IS NOT DISTINCT FROM u.source AND g.h = u.tau
), m AS (
  SELECT d.source, arg_min(d.h, (abs(d.size - k.rest), d.h)) AS more
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
  WHERE d.h >= k.tau AND abs(d.size - k.rest) < k.rest GROUP BY d.source
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY doc_id) AS nth FROM d
)
SELECT n.doc_id, n.source, n.size, b.source_size, b.target,
       CAST(n.size * (b.whole + CASE WHEN n.h < k.tau THEN 1
                                     WHEN n.nth <= CASE WHEN n.h = k.tau THEN k.fit ELSE 0 END + CASE WHEN n.h = m.more THEN 1 ELSE 0 END THEN 1
                                     ELSE 0 END) AS BIGINT) AS taken
FROM n JOIN b ON n.source IS NOT DISTINCT FROM b.source
JOIN k ON n.source IS NOT DISTINCT FROM k.source
LEFT JOIN m ON n.source IS NOT DISTINCT FROM m.source
"""

ORACLE["op10_chat"] = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l,
         string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10), ''
                    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
  FROM t GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN {'turn': turn, 'role': role, 'text': text} END
), w AS (
  SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies, min(text) AS text FROM c GROUP BY l
), p AS (
  SELECT DISTINCT list_slice(l, 1, CAST(i AS BIGINT)) AS k FROM (SELECT l, unnest(range(1, len(l))) AS i FROM c)
)
SELECT conv_id, CAST(len(l) AS BIGINT) AS n_turns, n_copies, text FROM w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = w.l)
"""

ORACLE["op11_negatives"] = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same,
         CAST(list_sum(list_transform(list_zip(a.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v ON a.row <> v.row WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS place
  FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rnk
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
  WHERE p.place <= 5
)
SELECT anchor_id, positive_id, CAST(rnk AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rnk <= 5
"""

ORACLE["op12_lexical"] = r"""
WITH i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), w AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), d AS (
  SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n, words FROM w WHERE len(words) > 0
), c AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM d
), f AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(words) AS term FROM d) GROUP BY row, term
), g AS (
  SELECT term, CAST(floor(1000 * ln((2 * c.docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM f, c GROUP BY term, c.docs
), m AS (
  SELECT row, doc_id, 100 - 90 + ((90 * n * docs) // length) AS m FROM d, c
), s AS (
  SELECT i.item_id, f.row, m.doc_id, CAST(sum(g.weight * ((1000000000 * f.tf) // (1000 * f.tf + 8 * m.m))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN g USING (term) JOIN m USING (row) GROUP BY i.item_id, f.row, m.doc_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rnk FROM s WHERE score > 0
)
SELECT item_id, CAST(rnk AS INTEGER) AS rank, doc_id, score FROM r WHERE rnk <= 10
"""
