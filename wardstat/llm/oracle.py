"""DuckDB twins of the queries that SQL can express."""

ORACLE = {}

ORACLE["op7_stream_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)"""

ORACLE["op6_segment_line_dedup"] = r"""
WITH r AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
l AS (SELECT row, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
      FROM r WHERE text IS NOT NULL),
d AS (SELECT line, length(line) AS n, min({'o': doc_id IS NULL, 'd': doc_id, 'r': row, 'p': pos}) AS f FROM l
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
e AS (SELECT * FROM d WHERE n >= 20),
pairs AS (
  SELECT x.line AS a, y.line AS b, x.f AS fa, y.f AS fb FROM e x JOIN e y
    ON left(x.line, x.n // 2) = left(y.line, x.n // 2) AND y.n - x.n IN (0, 1) AND x.line <> y.line AND levenshtein(x.line, y.line) <= 1
  UNION
  SELECT x.line, y.line, x.f, y.f FROM e x JOIN e y
    ON right(x.line, x.n - x.n // 2) = right(y.line, x.n - x.n // 2) AND y.n - x.n IN (0, 1) AND x.line <> y.line
       AND levenshtein(x.line, y.line) <= 1),
late AS (SELECT CASE WHEN fa < fb THEN b ELSE a END AS line FROM pairs GROUP BY 1),
m AS (SELECT l.row, l.doc_id, l.pos, l.line,
             d.line IS NOT NULL AND (late.line IS NOT NULL OR d.f.r <> l.row OR d.f.p <> l.pos) AS goes
      FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN late ON l.line = late.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM m GROUP BY row, doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM r WHERE text IS NULL"""

#: integer vectors; a shorter vector counts as filled up with zeros
VECTORS = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, {label} AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
DOT = "CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT)"

ORACLE["op11_hard_negatives"] = VECTORS.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END") + f""",
s AS MATERIALIZED (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid AS rid, b.vec_id AS id, a.label = b.label AS same, {DOT} AS score
  FROM e a JOIN e b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0 AND a.label IS NOT NULL AND b.label IS NOT NULL),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS LAST, rid) <= 5),
w AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, n.id AS negative_id, n.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY n.score DESC, n.id NULLS LAST, n.rid) AS rank
      FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same
       AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 10"""

ORACLE["op13_bit_sliced_top_k"] = VECTORS.format(label="label") + f""",
s AS (SELECT a.rid AS query, a.vec_id AS query_id, b.rid, b.vec_id, {DOT} AS score
      FROM e a JOIN e b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST, rid) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

ORACLE["op12_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
             || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
             || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
      FROM t LEFT JOIN m USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || x.c || y.c || z.c AS filter_order FROM l a, l b, l x, l y, l z
      WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
f AS (SELECT g.*, o.filter_order, list_min(list_transform(string_split(fails, ''), lambda c: strpos(filter_order, c))) AS gone
      FROM g, o),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS step),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, n, good, toxic, fails,
             CASE WHEN fails = '' THEN 6 ELSE gone END AS gone FROM f, k),
r AS (SELECT part, filter_order, step, letter,
             CAST(sum(CASE WHEN gone > step THEN n ELSE 0 END) AS BIGINT) AS kept,
             CAST(sum(CASE WHEN gone = step THEN n ELSE 0 END) AS BIGINT) AS removed,
             CAST(sum(CASE WHEN gone < step AND contains(fails, letter) THEN n ELSE 0 END) AS BIGINT) AS redundant,
             CAST(sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
             CAST(sum(CASE WHEN gone = step THEN good ELSE 0 END) AS BIGINT) AS good_lost,
             CAST(sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""
