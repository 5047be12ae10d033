"""DuckDB SQL for the queries of this subpackage that SQL can express."""

LINE_DEDUP = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND doc_id <> holder AS gone
  FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

TOPK_SEARCH = """
WITH rows AS (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         list_sum([CASE WHEN (coalesce(a[1], 0) > 0) <> (coalesce(a[2], 0) > 0) THEN 1 ELSE 0 END
                   FOR a IN list_zip(q.embedding, v.embedding)]) AS distance
  FROM rows q JOIN rows v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, distance::INTEGER AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM pairs)
WHERE rank <= 10
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM fine a JOIN fine b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.y, e.vec_id)) AS component_id, e.vec_id <= coalesce(l.y, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counts c ON e.vec_id = c.x LEFT JOIN least_of l ON e.vec_id = l.x
"""

SOURCE_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
size_of AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, source, term),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM cells GROUP BY lang, source),
p AS (
  SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000 * (c.n + 5)) // (t.total + 5 * s.v) AS p
  FROM cells c JOIN totals t ON t.lang = c.lang AND t.source = c.source JOIN size_of s ON s.lang = c.lang),
of_lang AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM cells GROUP BY lang, term),
q AS (
  SELECT o.lang, o.term, 1 + (1000000000 * (o.n + 5)) // (t.total + 5 * s.v) AS q
  FROM of_lang o JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM of_lang GROUP BY lang) t USING (lang) JOIN size_of s USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS one, y.source AS two, sum(abs(x.p - y.p)) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) d
    ON d.lang = a.lang AND d.one = a.source AND d.two = b.source),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 50
"""

HARD_NEGATIVES = """
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS r FROM pairs WHERE same) WHERE r <= 5)
SELECT anchor_id, positive_id, rank, other_id AS negative_id, positive_score, score AS negative_score FROM (
  SELECT p.*, n.other_id, n.score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
WHERE rank <= 10
"""
