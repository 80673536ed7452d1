"""SQL twins of the audits and joins of 11 to 13."""

from __future__ import annotations

CONVERSATION_REPAIR = r"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT] || list_transform(range(8), lambda z: 0::BIGINT),
          lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
coded AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(s)), lambda i: ascii(substr(s, (i + 1)::INT, 1))::BIGINT),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code
  FROM named, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded)),
ids AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
  SELECT g, turn, role, text, substr(role, 1, 1) AS x, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged d JOIN ids ON ids.conv_id IS NOT DISTINCT FROM d.conv_id),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
         lag(x) OVER (PARTITION BY g ORDER BY i) || x AS two
  FROM placed),
counts AS (
  SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY g),
moves(before, after, inserted) AS (VALUES (0, 2, 0), (1, 2, 0), (2, 3, 0), (3, 2, 0), (0, 3, 1), (1, 3, 1), (2, 2, 1), (3, 3, 1), (0, 1, 0), (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0)),
edits(e, extra) AS (VALUES ('K', 0), ('R', 1), ('D', 2)),
path AS (
  SELECT g, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': '', 'lines': ''} AS best FROM ids
  UNION ALL
  SELECT p.g, j.i, m.after,
         min({'cost': p.best.cost + extra + 5 * inserted + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END,
              'audit': p.best.audit || CASE WHEN inserted = 1 THEN 'I' ELSE '' END || e,
              'lines': p.best.lines || CASE WHEN inserted = 0 THEN '' WHEN m.after = 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END
                       || CASE WHEN e = 'D' THEN '' ELSE chr(10) || CASE WHEN e = 'K' THEN role WHEN m.after = 2 THEN 'user' ELSE 'assistant' END || ':' || text END})
  FROM path p JOIN judged j ON j.g = p.g AND j.i = p.i + 1 JOIN moves m ON m.before = p.state JOIN edits ON true
  WHERE CASE e WHEN 'D' THEN m.after = m.before AND inserted = 0
               WHEN 'K' THEN fault NOT IN ('blank', 'duplicate') AND (m.after, x) IN ((1, 's'), (2, 'u'), (3, 'a')) AND NOT (m.after = m.before AND inserted = 0)
               ELSE fault NOT IN ('blank', 'duplicate') AND m.after >= 2 AND NOT (m.after = m.before AND inserted = 0) END
  GROUP BY p.g, j.i, m.after),
ended AS (
  SELECT p.g, min({'cost': best.cost + CASE state WHEN 2 THEN 5 WHEN 1 THEN 10 ELSE 0 END, 'audit': best.audit || CASE state WHEN 2 THEN 'I' WHEN 1 THEN 'II' ELSE '' END,
                   'lines': best.lines || CASE state WHEN 2 THEN chr(10) || 'assistant:' WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE '' END}) AS best
  FROM path p LEFT JOIN counts c ON c.g = p.g WHERE i = coalesce(n, 0) GROUP BY p.g)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.cost AS cost, best.audit AS audit,
       sha256(substr(best.lines, 2)) AS repaired_sha256
FROM ids JOIN ended e ON e.g = ids.g LEFT JOIN counts c ON c.g = ids.g
"""

FILTER_AUDIT = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
f AS (
  SELECT w.doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
         regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = w.doc_id),
combos AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
one AS (SELECT unnest(range(1, 6)) AS k),
orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda k: substr('ABCDE', k::INT, 1)), '') AS filter_order, unnest(range(1, 6)) AS step FROM orders),
r AS (
  SELECT part, filter_order, step, o[step] AS own,
         sum(n) FILTER (NOT list_bool_or(list_transform(o[1:step], lambda k: fails[k])))::BIGINT AS kept,
         sum(n) FILTER (fails[o[step]] AND NOT list_bool_or([false] || list_transform(o[1:step - 1], lambda k: fails[k])))::BIGINT AS removed,
         sum(n) FILTER (fails[o[step]] AND list_bool_or([false] || list_transform(o[1:step - 1], lambda k: fails[k])))::BIGINT AS redundant,
         sum(n) FILTER (fails[o[step]] AND len(list_filter(fails, lambda x: x)) = 1)::BIGINT AS unique_fails,
         sum(good) FILTER (fails[o[step]] AND NOT list_bool_or([false] || list_transform(o[1:step - 1], lambda k: fails[k])))::BIGINT AS good_lost,
         sum(toxic) FILTER (fails[o[step]] AND NOT list_bool_or([false] || list_transform(o[1:step - 1], lambda k: fails[k])))::BIGINT AS toxic_lost
  FROM combos, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
       coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM r
"""

JACCARD_JOIN = r"""
WITH RECURSIVE
w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3])) END AS s FROM w),
k AS (SELECT r, doc_id, len(s) AS n, dense_rank() OVER (ORDER BY list_sort(s)) AS g, s FROM s),
g AS (SELECT g, min(doc_id) AS least, any_value(s) AS s, any_value(n) AS n FROM k GROUP BY g),
t AS (SELECT g, n, unnest(s) AS t FROM g),
l AS (SELECT a.g AS a, b.g AS b FROM t a JOIN t b ON a.t = b.t AND a.g <> b.g AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.g, b.g, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT g AS a, g AS b FROM g UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE c END AS component_id
FROM k JOIN (SELECT a, min(least) AS c FROM reach JOIN g ON g.g = reach.b GROUP BY a) m ON m.a = k.g
"""
