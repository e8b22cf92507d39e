"""All analytics queries by name, and the same in DuckDB's SQL where SQL can express them."""

from __future__ import annotations

import re

from sitewatch.functions.vocabulary import TYPES
from sitewatch.operators import dashboard, exchange, identity, lifecycle, runtime, search, similarity, spatial, telemetry, temporal, tracking
from sitewatch.plans import exchange_sql, identity_sql, lifecycle_sql, runtime_sql, search_sql, spatial_sql, tracking_sql
from sitewatch.streaming import lifecycle as stream_lifecycles
from sitewatch.streaming import requests as stream_requests

#: The modules whose queries are registered under their functions' names.
MODULES = (dashboard, exchange, identity, lifecycle, runtime, search, similarity, spatial, telemetry, temporal, tracking)


def _queries(module) -> dict:
    """Functions of a module that are called by an operator's id, as in ``a01_summary`` or ``st05_cooldown``."""
    own = ((name, f) for name, f in vars(module).items() if getattr(f, "__module__", "") == module.__name__)
    return {name: f for name, f in own if re.match(r"(a|f|io|j|o|p|r|s|st|u|w)\d\d_", name) and name != "j07_assignments"}


QUERIES = {name: f for module in MODULES for name, f in _queries(module).items()}
QUERIES |= {f.__name__: f for f in (stream_lifecycles.stream_lifecycle, stream_lifecycles.stream_temporal, stream_requests.stream_requests)}

_EV = """ev0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'cam_' || CAST(user_id % 16 AS VARCHAR) AS camera_id FROM events),
ev AS (SELECT *, CASE WHEN k % 10 <> 0 THEN CAST(user_id AS VARCHAR) END AS person_id,
  CASE WHEN k = 98 THEN 'inspection_presence:' || camera_id WHEN k <> 99 THEN 'camera:' || camera_id END AS source,
  event_type IN ('error', 'purchase', 'signup') AS is_violation FROM ev0),
sh AS (SELECT * FROM ev WHERE source NOT LIKE 'inspection_presence:%')"""
_TYPES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TYPES))
_TY = f"""{_EV}, names(o, type) AS (VALUES {_TYPES}),
ty AS (SELECT ev.*, o, type FROM ev, names WHERE (o < 7 AND (k >> o) & 1 = 1) OR (event_type = 'error' AND type = 'unauthorized_intrusion') OR (event_type = 'signup' AND type = 'fall_detected')),
vt AS (SELECT * FROM ty WHERE source NOT LIKE 'inspection_presence:%' AND is_violation AND ts >= TIMESTAMP '2024-01-01')"""
_BOX = f"""{_EV}, b0 AS (SELECT event_id // 8 AS frame, event_id AS obj, CASE WHEN event_id % 8 < 4 THEN 'person' ELSE 'item' END AS kind, (k % 50 + 50) / 100.0 AS score,
  CAST((event_id * 37 + k * 11) % 500 AS DOUBLE) AS x1, CAST((event_id * 53 + k * 7) % 300 AS DOUBLE) AS y1, k FROM ev),
bx AS (SELECT frame, obj, kind, score, x1, y1, x1 + 60 + k * 3 % 200 AS x2, y1 + 80 + k * 5 % 180 AS y2 FROM b0),
pr0 AS (SELECT p.frame, p.obj AS person, i.obj AS item, greatest(0, least(p.x2, i.x2) - greatest(p.x1, i.x1)) * greatest(0, least(p.y2, i.y2) - greatest(p.y1, i.y1)) AS both_,
  (p.x2 - p.x1) * (p.y2 - p.y1) AS pa, (i.x2 - i.x1) * (i.y2 - i.y1) AS ia,
  (i.x1 + i.x2) / 2 BETWEEN p.x1 AND p.x2 AND (i.y1 + i.y2) / 2 BETWEEN p.y1 AND p.y2 AS centre FROM bx p JOIN bx i ON p.frame = i.frame AND p.kind = 'person' AND i.kind = 'item'),
pr AS (SELECT *, both_ / (pa + ia - both_) AS iou FROM pr0)"""
_TEL = """tl AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate FROM lineitem),
te AS (SELECT l_suppkey AS camera, l_suppkey % 4 AS shard, CAST(round(l_extendedprice * 100) AS BIGINT) AS units, CAST(round(l_extendedprice * 100) AS BIGINT) / 10000 AS ms, l_returnflag || l_linestatus AS stage, CAST(l_quantity AS INTEGER) AS batch, tl.* FROM tl)"""
_SC = """sc AS (SELECT q.vec_id AS query, s.vec_id AS subject, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])) /
  sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * list_dot_product(CAST(s.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[]))) AS score
  FROM embeddings q JOIN embeddings s ON q.vec_id % 100 = 0 AND q.vec_id <> s.vec_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, subject) AS rank FROM sc)"""
_WIN = f"""{_EV}, pv AS (SELECT camera_id, user_id, event_id, ts, epoch(date_trunc('day', ts)) + 30600 AS o FROM ev WHERE event_type = 'view'),
pw AS (SELECT *, CAST(oo + floor((epoch(ts) - oo) / 18000) * 18000 AS BIGINT) AS window_start FROM (SELECT *, CASE WHEN epoch(ts) >= o THEN o ELSE o - 86400 END AS oo FROM pv)),
rec AS (SELECT camera_id, window_start, window_start + 18000 AS window_end, min(ts) AS first_at, max(ts) AS last_at, arg_max(user_id, (ts, event_id)) AS person FROM pw GROUP BY ALL)"""


def _rank(p: float) -> str:
    return f"max(CASE WHEN i = ceil((n - 1) * {p}) THEN ms END)"


_ORD = "OVER (PARTITION BY user_id ORDER BY ts, event_id"

ORACLE_SQL = {
    "a01_summary": f"WITH {_EV} SELECT count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS today, count(*) FILTER (is_violation) AS violations, count(*) FILTER (is_violation AND ts >= TIMESTAMP '2024-01-30') AS today_violations, count(DISTINCT person_id) AS persons, CASE WHEN count(*) = 0 THEN 100.0 ELSE round((count(*) - count(*) FILTER (is_violation)) / count(*) * 100, 1) END AS compliance_rate FROM sh",
    "a04_daily_violations": f"WITH {_EV} SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM sh WHERE is_violation AND ts >= TIMESTAMP '2024-01-23 23:59:59' GROUP BY 1",
    "a05_type_counts": f"WITH {_TY} SELECT type, count(*) AS n FROM vt GROUP BY type",
    "a06_trend": f"WITH {_TY}, c AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT event_id) AS n FROM vt WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1) SELECT DATE '2024-01-30' - CAST(i AS INTEGER) AS day, coalesce(n, 0) AS n FROM range(7) r(i) LEFT JOIN c ON c.day = DATE '2024-01-30' - CAST(i AS INTEGER)",
    "a07_breakdown": f"WITH {_TY} SELECT names.o + 1 AS position, names.type, count(vt.event_id) AS n FROM names LEFT JOIN vt ON vt.type = names.type GROUP BY ALL",
    "a08_top_violators": f"WITH {_EV}, t AS (SELECT person_id, count(*) AS n FROM sh WHERE is_violation AND person_id IS NOT NULL AND ts >= TIMESTAMP '2024-01-01' GROUP BY 1 ORDER BY n DESC, person_id LIMIT 5) SELECT person_id, coalesce(c_name, person_id) AS name, n FROM t LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = person_id",
    "a09_top_cameras": f"WITH {_TY}, c AS (SELECT camera_id, o, type, count(*) AS n FROM vt GROUP BY ALL) SELECT camera_id, CAST(sum(n) AS BIGINT) AS total, string_agg(type || '=' || CAST(n AS VARCHAR), ',' ORDER BY o) AS breakdown FROM c GROUP BY camera_id ORDER BY total DESC, camera_id LIMIT 5",
    "a10_today_and_week": f"WITH {_EV} SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS today, count(*) FILTER (ts >= TIMESTAMP '2024-01-29') AS week FROM sh",
    "a12_person_rolling": f"WITH {_EV}, c AS (SELECT person_id, count(*) FILTER (is_violation AND ts >= TIMESTAMP '2024-01-30') AS d1, count(*) FILTER (is_violation AND ts >= TIMESTAMP '2024-01-24') AS d7, count(*) FILTER (is_violation AND ts >= TIMESTAMP '2024-01-01') AS d30 FROM ev GROUP BY 1) SELECT CAST(c_custkey AS VARCHAR) AS person_id, coalesce(d1, 0) AS d1, coalesce(d7, 0) AS d7, coalesce(d30, 0) AS d30 FROM customer LEFT JOIN c ON c.person_id = CAST(c_custkey AS VARCHAR)",
    "a13_segment_leaders": "SELECT c_mktsegment, rank, c_custkey, c_acctbal FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer) WHERE rank <= 2",
    "f06_type_filter": f"WITH {_EV} SELECT event_id, camera_id FROM sh WHERE (k >> 2) & 1 = 1",
    "f08_active_visits": "SELECT o_orderkey, o_orderdate <= TIMESTAMP '1998-06-30 12:00:00' AS present FROM orders WHERE o_orderdate + to_days(CAST(o_orderkey % 20 AS INTEGER)) >= TIMESTAMP '1998-06-30 12:00:00'",
    "f10_person_search": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_name ILIKE '%00012%'",
    "j01_names": f"WITH {_EV} SELECT event_id, coalesce(c_name, person_id, 'unknown') AS name FROM sh LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = person_id",
    "o01_event_page": f"WITH {_EV} SELECT event_id, ts, camera_id FROM sh ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40",
    "o02_recent_violations": f"WITH {_EV} SELECT event_id, ts FROM sh WHERE is_violation ORDER BY ts DESC, event_id DESC LIMIT 10",
    "u05_ordered_types": f"WITH {_TY} SELECT ev.event_id, coalesce(string_agg(ty.type, ',' ORDER BY ty.o), '') AS types FROM ev LEFT JOIN ty ON ty.event_id = ev.event_id GROUP BY 1",
    "j08_best_subject": f"WITH {_SC}, p AS (SELECT query, max(CASE WHEN rank = 1 THEN subject END) AS s, max(score) AS b, min(score) AS c FROM rk WHERE rank <= 2 GROUP BY 1) SELECT query, CASE WHEN b >= 0.2 AND b - c >= 0.005 THEN s END AS subject, round(b, 4) AS best FROM p",
    "j09_ranked_subjects": f"WITH {_SC} SELECT query, CAST(rank AS INTEGER) AS rank, subject, round(least(1.0, greatest(0.0, (score + 1) / 2)) * 100, 1) AS points FROM rk WHERE rank <= 10",
    "a35_label_means": "SELECT label, CAST(place AS INTEGER) AS place, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS place FROM embeddings) GROUP BY ALL",
    "j03_item_person": f"WITH {_BOX} SELECT frame, person, item, round(iou, 6) AS iou FROM pr WHERE centre OR greatest(both_ / pa, both_ / ia) >= 0.1 OR iou >= 0.1",
    "j05_best_person": f"WITH {_BOX} SELECT frame, item, person FROM (SELECT *, row_number() OVER (PARTITION BY frame, item ORDER BY round(iou, 9) DESC, person) AS r FROM pr WHERE round(iou, 9) >= 0.3) WHERE r = 1",
    "f12_large_boxes": f"WITH {_BOX}, a AS (SELECT *, (x2 - x1) * (y2 - y1) >= 30000 AS large FROM bx WHERE kind = 'person'), c AS (SELECT *, bool_or(large) OVER (PARTITION BY frame) AS a FROM a) SELECT frame, obj FROM c WHERE large OR (NOT a AND score >= 0.7 AND (y2 - y1) / (x2 - x1) >= 1.3)",
    "a19_percentiles": f"WITH {_TEL}, r AS (SELECT *, row_number() OVER (PARTITION BY stage, shard ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY stage, shard) AS n FROM te) SELECT stage, shard, {_rank(0.5)} AS p50, {_rank(0.95)} AS p95, {_rank(0.99)} AS p99, count(*) AS n FROM r GROUP BY stage, shard",
    "a21_slowest_cameras": f"WITH {_TEL}, r AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY camera) AS n FROM te) SELECT camera, {_rank(0.95)} AS p95, sum(units) / (count(*) * 10000) AS mean, count(*) AS n FROM r GROUP BY camera ORDER BY p95 DESC, camera LIMIT 5",
    "a21_slowest_stages": f"WITH {_TEL}, r AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY camera) AS n FROM te), five AS (SELECT camera, {_rank(0.95)} AS p95 FROM r GROUP BY camera ORDER BY p95 DESC, camera LIMIT 5), q AS (SELECT *, row_number() OVER (PARTITION BY camera, stage ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY camera, stage) AS n FROM te WHERE camera IN (SELECT camera FROM five)), g AS (SELECT camera, stage, {_rank(0.95)} AS p95, count(*) AS n FROM q GROUP BY camera, stage) SELECT camera, stage, row_number() OVER (PARTITION BY camera ORDER BY p95 DESC, stage) AS place, p95, n FROM g QUALIFY place <= 5",
    "a22_batch_sizes": f"WITH {_TEL} SELECT batch, count(*) AS n FROM te GROUP BY batch",
    "a23_main_shard": f"WITH {_TEL}, c AS (SELECT camera, (shard + batch % 3) % 4 AS at_, count(*) AS n FROM te GROUP BY ALL) SELECT camera, arg_min(at_, (-n, at_)) AS shard FROM c GROUP BY camera",
    "w06_rolling_mean": f"WITH {_TEL}, r AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY l_shipdate DESC, l_orderkey DESC, l_partkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC, l_returnflag DESC, l_linestatus DESC) AS r FROM te) SELECT camera, round(avg(ms), 4) AS mean, count(*) AS n FROM r WHERE r <= 30 GROUP BY camera",
    "a26_shard_summary": f"WITH {_TEL}, c AS (SELECT shard, camera, avg(ms) AS m FROM te GROUP BY ALL) SELECT shard, round(avg(m), 4) AS mean, count(*) FILTER (m > 560) AS hot FROM c GROUP BY shard",
    "w02_stable_items": f"WITH {_EV} SELECT event_id, sum(k & 1) {_ORD} ROWS 2 PRECEDING) = 3 AND count(*) {_ORD} ROWS 2 PRECEDING) = 3 AS stable FROM ev",
    "w03_fused_confidence": f"WITH {_EV}, c AS (SELECT event_id, k / 100.0 AS x, lag(k / 100.0) {_ORD}) AS y, lag(k / 100.0, 2) {_ORD}) AS z FROM ev) SELECT event_id, round(CASE WHEN y IS NULL THEN x WHEN z IS NULL THEN 0.7 * x + 0.3 * y ELSE 0.7 * x + 0.3 * (0.7 * y + 0.3 * z) END, 9) AS fused FROM c",
    "w05_gaps": f"WITH {_EV} SELECT * FROM (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) {_ORD}))) // 1000 AS gap_ms FROM ev) WHERE gap_ms IS NOT NULL",
    "w08_latest": f"WITH {_EV} SELECT camera_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM ev GROUP BY 1",
    "s10_shifts": f"WITH {_EV} SELECT CASE WHEN hour(ts) < 8 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS shift_date, CASE WHEN hour(ts) >= 8 AND hour(ts) < 20 THEN 'day' ELSE 'night' END AS shift, count(*) AS n FROM ev GROUP BY ALL",
    "a15_patrol_records": f"WITH {_WIN} SELECT * FROM rec",
    "j16_missed_windows": f"WITH {_WIN} SELECT c.camera_id, w.window_start FROM (SELECT DISTINCT window_start FROM rec) w, (SELECT DISTINCT camera_id FROM ev) c WHERE (c.camera_id, w.window_start) NOT IN (SELECT (camera_id, window_start) FROM rec)",
    "j15_visits_by_day": "SELECT CAST(d AS DATE) AS day, count(*) AS n FROM range(TIMESTAMP '1998-06-01', TIMESTAMP '1998-07-01', INTERVAL 1 DAY) r(d) JOIN orders ON CAST(o_orderdate AS DATE) <= d AND CAST(o_orderdate + to_days(CAST(o_orderkey % 20 AS INTEGER)) AS DATE) >= d AND o_orderdate >= DATE '1998-05-01' AND o_orderdate < DATE '1998-07-01' GROUP BY 1",
}
ORACLE_SQL |= search_sql.ORACLE_SQL | runtime_sql.ORACLE_SQL | lifecycle_sql.ORACLE_SQL | spatial_sql.ORACLE_SQL | exchange_sql.ORACLE_SQL | identity_sql.ORACLE_SQL | tracking_sql.ORACLE_SQL
ORACLE_SQL["stream_lifecycle"] = ORACLE_SQL["st06_lifecycle_with_rotation"]
ORACLE_SQL["stream_requests"] = ORACLE_SQL["j13_answered_requests"]
ORACLE_SQL["stream_temporal"] = f"SELECT 'binary' AS mode, * FROM ({ORACLE_SQL['st02_temporal_binary']}) UNION ALL SELECT 'confident' AS mode, * FROM ({ORACLE_SQL['st03_temporal_confidence']})"
