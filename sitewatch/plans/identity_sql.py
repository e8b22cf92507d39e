"""The queries of ``operators.identity`` in DuckDB's SQL."""

from __future__ import annotations

from sitewatch.plans.search_sql import EVENTS

_DOT = "list_dot_product({}.v, {}.v)"
_COSINE = f"round({_DOT.format('a', 'b')} / sqrt({_DOT.format('a', 'a')} * {_DOT.format('b', 'b')}), 9)"
IDENTITIES = f"""{EVENTS}, ob AS (SELECT event_id, epoch_us(ts) AS tm, k % 3 = 0 AS matched, CASE WHEN k % 3 = 0 THEN 'person:' || user_id ELSE 'unmatched:' || camera_id || ':' || user_id END AS key,
  CASE WHEN is_violation THEN event_type END AS violation, CAST(embedding AS DOUBLE[]) AS v FROM ev JOIN embeddings ON vec_id = event_id),
sc AS (SELECT a.event_id, b.event_id AS seen_id, b.tm AS seen_tm, {_COSINE} AS score FROM ob a JOIN ob b ON (b.tm, b.event_id) < (a.tm, a.event_id) AND b.tm >= a.tm - 172800000000),
li AS (SELECT event_id, arg_max(seen_id, (score, -seen_tm, -seen_id)) AS seen_id, max(score) AS score FROM sc WHERE score >= 0.45 GROUP BY 1),
e1 AS (SELECT x.key AS a, y.key AS b FROM li JOIN ob x ON x.event_id = li.event_id JOIN ob y ON y.event_id = li.seen_id),
e2 AS (SELECT a, b FROM e1 UNION SELECT b, a FROM e1),
rc AS (SELECT DISTINCT key AS n, key AS r FROM ob UNION SELECT rc.n, e2.b FROM rc JOIN e2 ON rc.r = e2.a),
ro AS (SELECT n AS key, min(r) AS root FROM rc GROUP BY 1),
nm AS (SELECT root, coalesce(arg_max(key, (tm, event_id)) FILTER (matched), arg_min(key, (tm, event_id))) AS identity FROM ob JOIN ro USING (key) GROUP BY 1),
idn AS (SELECT key, identity FROM ro JOIN nm USING (root))"""

ORACLE_SQL = {
    "st07_identities": f"WITH RECURSIVE {IDENTITIES} SELECT ob.event_id, ob.key, identity, seen_id, round(score, 6) AS score FROM ob JOIN idn USING (key) LEFT JOIN li ON li.event_id = ob.event_id",
    "st07_merged_alerts": f"WITH RECURSIVE {IDENTITIES}, al AS (SELECT key, violation, max(tm) AS tm FROM ob WHERE violation IS NOT NULL GROUP BY ALL) SELECT identity, violation, max(tm) AS last_at, count(*) AS keys FROM al JOIN idn USING (key) GROUP BY ALL",
}
