"""SQL counterparts of operators that SQL can express, for DuckDB: the same rows by other means."""

OP3_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS following FROM docs),
edits AS (
  SELECT doc_id, text, substring(text, 1, length(text) - length(text) // 4) || substring(following, 1, length(text) // 4) AS edited FROM pairs),
every AS (SELECT doc_id, 1 AS kind, text AS t FROM edits UNION ALL SELECT doc_id, 2, edited FROM edits),
leaves AS (
  SELECT doc_id, kind, list_transform(string_split(t, chr(10)), lambda p:
    list_transform(regexp_extract_all(p, '[ \t\n\x0B\f\r]*(?:[^ \t\n\x0B\f\r]+[ \t\n\x0B\f\r]*){1,4}|[ \t\n\x0B\f\r]+'), lambda x: sha256(x))) AS ps FROM every),
paragraphs AS (
  SELECT doc_id, kind, list_transform(ps, lambda own: substring(sha256(array_to_string(own, '')), 1, 16) || '=' || array_to_string(list_transform(own, lambda d: substring(d, 1, 8)), '.')) AS ps FROM leaves),
joined AS (
  SELECT doc_id, kind, array_to_string(list_transform(ps, lambda p, i: p || CASE WHEN i = len(ps) THEN '' WHEN p[1] IN ('0', '1') THEN ';' ELSE ' ' END), '') AS s FROM paragraphs),
bodies AS (
  SELECT doc_id, kind, array_to_string(list_transform(string_split(s, ';'), lambda x: substring(sha256(x), 1, 16) || '{' || x || '}'), ';') AS b FROM joined),
prints AS (SELECT doc_id, kind, sha256(b) || ';' || b AS f, list_distinct(regexp_extract_all(b, '[=.]([0-9a-f]{8})', 1)) AS own, regexp_extract_all(b, '([0-9a-f]{16})=', 1) AS ps FROM bodies),
both_ AS (
  SELECT e.doc_id, e.text, e.edited, a.f AS fingerprint, b.f AS edited_fingerprint, a.own AS x, b.own AS y, a.ps AS p, b.ps AS q,
         coalesce(lead(a.f) OVER w, first_value(a.f) OVER w) AS next_f, coalesce(lead(a.own) OVER w, first_value(a.own) OVER w) AS z
  FROM edits e JOIN prints a ON a.doc_id = e.doc_id AND a.kind = 1 JOIN prints b ON b.doc_id = e.doc_id AND b.kind = 2
  WINDOW w AS (ORDER BY e.doc_id)),
fronts AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, least(len(p), len(q)) + 1), lambda i: p[i] <> q[i]), true), 0) - 1, least(len(p), len(q))) AS front FROM both_),
rests AS (SELECT *, list_reverse(p[front + 1:]) AS r, list_reverse(q[front + 1:]) AS s FROM fronts),
backs AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, least(len(r), len(s)) + 1), lambda i: r[i] <> s[i]), true), 0) - 1, least(len(r), len(s))) AS back FROM rests),
stretches AS (SELECT *, fingerprint <> edited_fingerprint AS other, r[back + 1:] AS gone, s[back + 1:] AS come FROM backs)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN fingerprint = edited_fingerprint THEN 1 ELSE CAST(2 * len(list_intersect(x, y)) AS DOUBLE) / greatest(1, len(x) + len(y)) END AS near_edited,
       CASE WHEN fingerprint = next_f THEN 1 ELSE CAST(2 * len(list_intersect(x, z)) AS DOUBLE) / greatest(1, len(x) + len(z)) END AS near_next,
       CAST(CASE WHEN other THEN front END AS INTEGER) AS first_changed, CAST(CASE WHEN other THEN len(gone) END AS INTEGER) AS n_before, CAST(CASE WHEN other THEN len(come) END AS INTEGER) AS n_after,
       CAST(CASE WHEN other THEN len(list_filter(list_distinct(gone), lambda d: NOT list_contains(come, d))) END AS INTEGER) AS n_deleted,
       CAST(CASE WHEN other THEN len(list_filter(list_distinct(come), lambda d: NOT list_contains(gone, d))) END AS INTEGER) AS n_inserted,
       CAST(CASE WHEN other THEN len(list_intersect(gone, come)) END AS INTEGER) AS n_moved
FROM stretches
"""

OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '') AS w FROM documents),
keyed AS (SELECT doc_id, array_to_string(w, ' ') AS k, w FROM words WHERE len(w) > 0),
texts AS (SELECT row_number() OVER (ORDER BY k) AS t, k, any_value(w) AS w, count(*) AS n, min(doc_id) AS first_id FROM keyed GROUP BY k),
grams AS (SELECT DISTINCT t, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM texts),
sizes AS (SELECT t, count(*) AS s FROM grams GROUP BY t),
common AS (SELECT a.t AS a, b.t AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.t < b.t GROUP BY a.t, b.t),
near AS (SELECT a, b FROM common JOIN sizes x ON x.t = a JOIN sizes y ON y.t = b WHERE 5 * c >= 4 * (x.s + y.s - c)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
counts AS (SELECT a AS t, count(*) AS n_texts, sum(n) AS n_docs FROM links JOIN texts ON texts.t = b GROUP BY a),
reach AS (SELECT t, t AS r FROM counts UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.t),
classes AS (SELECT reach.t, min(first_id) AS class_id FROM reach JOIN texts ON texts.t = reach.r GROUP BY reach.t)
SELECT d.doc_id, CASE WHEN x.t IS NULL THEN d.doc_id ELSE coalesce(c.class_id, x.first_id) END AS class_id,
       CAST(coalesce(x.n - 1, 0) + coalesce(m.n_docs, 0) AS BIGINT) AS n_links, coalesce(m.n_texts, 0) AS n_text_links, coalesce(x.n - 1, 0) AS n_copies
FROM documents d LEFT JOIN keyed USING (doc_id) LEFT JOIN texts x ON x.k = keyed.k LEFT JOIN counts m ON m.t = x.t LEFT JOIN classes c ON c.t = x.t
"""
