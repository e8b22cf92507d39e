"""The queries of this subpackage that DuckDB's SQL can express."""

from __future__ import annotations

_CRC = "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(k, ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)"

#: Damage and faults row by row, cheapest edits by a recursion over rows and states, replay by one over edits.
OP11 = f"""WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
picked AS (SELECT conv_id, turn, role, text, xor({_CRC}, 4294967295) % 20 AS pick FROM src),
hurt AS (SELECT conv_id, turn, CASE WHEN pick = 4 THEN 'user' ELSE role END AS role, CASE WHEN pick = 1 THEN '' WHEN pick = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM picked JOIN (VALUES (1), (2)) c(copy) ON copy = 1 OR pick = 3 WHERE pick <> 0),
seq AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM hurt),
faulty AS (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial,
  CASE WHEN t = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM seq),
paired AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM faulty),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM paired GROUP BY conv_id),
steps(q, initial, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
writes(q, role, q2) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
before(q, q1, cost, edits) AS (SELECT q, q, 0, '' FROM writes UNION ALL SELECT q, q2, 5, 'I' FROM writes UNION ALL SELECT a.q, b.q2, 10, 'II' FROM writes a JOIN writes b ON b.q = a.q2),
moves AS (SELECT q, '*' AS initial, true AS del, q1 AS q2, cost + 2 AS cost, edits || 'D' AS edits FROM before
  UNION ALL SELECT b.q, s.initial, false, s.q2, b.cost, b.edits || 'K' FROM before b JOIN steps s ON s.q = b.q1 UNION ALL SELECT b.q, '*', false, w.q2, b.cost + 1, b.edits || 'R' FROM before b JOIN writes w ON w.q = b.q1),
best(conv_id, i, q, edits) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, '000000000' FROM conversations
  UNION ALL SELECT b.conv_id, b.i + 1, m.q2, min(lpad(CAST(CAST(left(b.edits, 9) AS INTEGER) + m.cost + CASE WHEN f.fault = 'truncated' AND NOT m.del THEN 5 ELSE 0 END AS VARCHAR), 9, '0') || substr(b.edits, 10) || m.edits)
  FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1 JOIN moves m ON m.q = b.q AND m.initial IN ('*', f.initial) AND (m.del OR f.fault IN ('none', 'truncated'))
  GROUP BY b.conv_id, b.i, m.q2),
ends(q, cost, edits) AS (VALUES (0, 0, ''), (1, 10, 'II'), (2, 5, 'I'), (3, 0, '')),
told AS (SELECT b.conv_id, min(lpad(CAST(CAST(left(b.edits, 9) AS INTEGER) + e.cost AS VARCHAR), 9, '0') || substr(b.edits, 10) || e.edits) AS edits
  FROM best b JOIN ends e USING (q) LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id WHERE b.i = coalesce(c.n, 0) GROUP BY b.conv_id),
said AS (SELECT conv_id, CAST(left(edits, 9) AS BIGINT) AS cost, substr(edits, 10) AS audit FROM told),
replay(conv_id, p, i, q, lines) AS (SELECT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, CAST([] AS VARCHAR[]) FROM said
  UNION ALL SELECT r.conv_id, r.p + 1, CASE WHEN substr(a.audit, r.p + 1, 1) = 'I' THEN r.i ELSE r.i + 1 END,
    CASE substr(a.audit, r.p + 1, 1) WHEN 'D' THEN r.q WHEN 'K' THEN s.q2 ELSE w.q2 END,
    CASE substr(a.audit, r.p + 1, 1) WHEN 'D' THEN r.lines WHEN 'I' THEN list_append(r.lines, w.role || ':') WHEN 'K' THEN list_append(r.lines, f.role || ':' || f.text) ELSE list_append(r.lines, w.role || ':' || f.text) END
  FROM replay r JOIN said a ON a.conv_id IS NOT DISTINCT FROM r.conv_id AND r.p < length(a.audit) JOIN writes w ON w.q = r.q
  LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1 LEFT JOIN steps s ON s.q = r.q AND s.initial = f.initial)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, a.cost, a.audit,
  sha256(array_to_string(r.lines, chr(10))) AS repaired_sha256
FROM said a JOIN replay r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.p = length(a.audit) LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id"""

OP13 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, v.vec_id, v.label, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) a JOIN v ON v.vec_id <> a.vec_id AND len(v.q) = len(a.q)),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE s.label <> s.own AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5"""

_COSINE = "list_dot_product(a.q, b.q) / sqrt(list_dot_product(a.q, a.q) * list_dot_product(b.q, b.q))"
OP8 = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) AND {_COSINE} >= 0.9),
rc AS (SELECT vec_id AS n, vec_id AS r FROM embeddings UNION SELECT rc.n, p.b FROM rc JOIN p ON rc.r = p.a),
co AS (SELECT n AS vec_id, min(r) AS component_id FROM rc GROUP BY 1),
ln AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT co.vec_id, coalesce(n, 0) AS n_links, component_id, co.vec_id = component_id AS kept FROM co LEFT JOIN ln ON ln.vec_id = co.vec_id"""
