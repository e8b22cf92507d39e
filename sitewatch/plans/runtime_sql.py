"""The queries of ``operators.runtime`` in DuckDB's SQL."""

from __future__ import annotations

from sitewatch.plans.search_sql import CAMERAS, EVENTS

TIMINGS = """te AS (SELECT l_suppkey AS camera, l_suppkey % 4 AS shard, CAST(round(l_extendedprice * 100) AS BIGINT) AS units, l_returnflag || l_linestatus AS stage, CAST(l_quantity AS INTEGER) AS batch,
  l_shipdate AS ts, l_orderkey AS order_no, l_linenumber AS line_no, (l_shipdate, l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_quantity, l_returnflag, l_linestatus) AS seq FROM lineitem)"""
_LAST = "OVER (PARTITION BY camera ORDER BY seq ROWS 29 PRECEDING)"
ROLLING = f"""{TIMINGS}, ro0 AS (SELECT *, list_sort(list(units) {_LAST}) AS last, count(*) {_LAST} AS n, sum(units) {_LAST} AS total, max(batch) {_LAST} AS top_batch FROM te),
ro AS (SELECT *, total / (n * 10000) AS mean, last[CAST(round_even((n - 1) * 0.95, 0) AS INTEGER) + 1] / 10000 AS p95 FROM ro0)"""
LATEST = f"""{TIMINGS}, la0 AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY seq DESC) AS r FROM te),
la1 AS (SELECT camera, count(*) AS n, CAST(sum(units) AS BIGINT) AS units, list_sort(list(units)) AS srt, CAST(sum(batch) AS BIGINT) AS batches, count(*) FILTER (batch > 48) AS skips, arg_min(shard, r) AS shard, list_sort(list(batch)) AS waits, CAST(sum(order_no % 1200) AS BIGINT) AS age, CAST(sum(line_no % 4) AS BIGINT) AS persons, CAST(sum(order_no % 3) AS BIGINT) AS backlog FROM la0 WHERE r <= 30 GROUP BY camera),
la2 AS (SELECT *, srt[CAST(round_even((n - 1) * 0.95, 0) AS INTEGER) + 1] AS p95_units, waits[CAST(round_even((n - 1) * 0.95, 0) AS INTEGER) + 1] * 10 AS p95_wait FROM la1),
la AS (SELECT *, units / (n * 10000) AS mean, p95_units / 10000 AS p95 FROM la2)"""
_MEAN = "({0} * {1} + n) // (n * 2)"


def _decimals(total: str, places: int) -> str:
    x = _MEAN.format(total, 2 * 10**places)
    return f"{x} // {10**places} || '.' || lpad(CAST({x} % {10**places} AS VARCHAR), {places}, '0')"


HOT = f"""{LATEST}, ho0 AS (SELECT *, 100 * ((mean >= 550)::INT + (p95 >= 950)::INT + (batches * 10 >= 280 * n)::INT + (p95_wait >= 490)::INT + (age >= 700 * n)::INT + (persons >= 2 * n)::INT + (backlog * 4 >= 5 * n)::INT) + least(100, (skips * 200 + 3) // 6) AS score, list_filter([
  CASE WHEN mean > 550 THEN 'avg_latency=' || (units * 10 + n * 5000) // (n * 10000) // 10 || '.' || (units * 10 + n * 5000) // (n * 10000) % 10 END,
  CASE WHEN p95 > 950 THEN 'p95_latency=' || (p95_units * 10 + 5000) // 10000 // 10 || '.' || (p95_units * 10 + 5000) // 10000 % 10 END,
  CASE WHEN batches * 10 > 280 * n THEN 'avg_batch_wait=' || (batches * 200 + n) // (n * 2) // 10 || '.' || (batches * 200 + n) // (n * 2) % 10 END,
  CASE WHEN p95_wait > 490 THEN 'p95_batch_wait=' || p95_wait || '.0' END,
  CASE WHEN {_MEAN.format('age', 20)} > 7000 THEN 'latest_frame_age=' || {_decimals('age', 1)} END,
  CASE WHEN {_MEAN.format('persons', 200)} > 200 THEN 'avg_person_count=' || {_decimals('persons', 2)} END,
  CASE WHEN {_MEAN.format('backlog', 200)} > 125 THEN 'avg_backlog=' || {_decimals('backlog', 2)} END,
  CASE WHEN skips >= 3 THEN 'backpressure_skips=' || skips END], lambda x: x IS NOT NULL) AS named FROM la),
ho AS (SELECT *, CASE WHEN len(named) = 0 AND score >= 300 THEN ['hotness_score=' || score // 100 || '.' || lpad(CAST(score % 100 AS VARCHAR), 2, '0')] ELSE named END AS reasons, len(named) > 0 OR score >= 300 AS hot, mean < 450 AND p95 < 920 AND persons * 2 <= 3 * n AS calm FROM ho0)"""
_N = "order_no % 11"
LINES = f"""{TIMINGS}, li AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') || ',000 INFO [worker] ' AS head FROM te),
ln AS (SELECT *, CASE {_N} WHEN 7 THEN head || 'Dropping invalid frame payload' WHEN 8 THEN head || 'Skipping inference sample for camera=a' || camera || '-f' WHEN 9 THEN head || 'FRAME_TIMING {{"camera_id": "cam_' || camera
  WHEN 10 THEN 'Expired pending async identity update' ELSE head || 'FRAME_TIMING {{"camera_id": "cam_' || camera || '", "stage": "' || stage || '", "units": ' || units || ', "batch": ' || batch || '}}' END AS line FROM li)"""
_TIMING = "regexp_extract(line, 'FRAME_TIMING (\\{.*\\})', 1)"
PARSED = f"""{LINES}, ps0 AS (SELECT *, try_strptime(substr(line, 1, 23), '%Y-%m-%d %H:%M:%S,%g') AS tm, {_TIMING} AS payload FROM ln),
ps AS (SELECT *, CASE WHEN payload <> '' THEN json_extract_string(payload, '$.camera_id') END AS camera_id, CASE WHEN payload <> '' THEN json_extract_string(payload, '$.stage') END AS stg, CASE WHEN payload <> '' THEN CAST(json_extract_string(payload, '$.units') AS BIGINT) END AS u, CASE WHEN payload <> '' THEN CAST(json_extract_string(payload, '$.batch') AS INTEGER) END AS bt FROM ps0)"""
_EV_ORDER = "ORDER BY ts, event_id"
HEADS = f"""{EVENTS}, he AS (SELECT event_id, ts, camera_id, k % 6 AS persons, k % 6 - coalesce(lag(k % 6) OVER (PARTITION BY camera_id {_EV_ORDER}), 0) AS change FROM ev),
hd AS (SELECT *, CAST(sum(change) OVER ({_EV_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM he)"""
BOXES = f"""{EVENTS}, bx AS (SELECT event_id // 8 AS frame, event_id AS obj, CASE WHEN event_id % 8 < 4 THEN 'person' ELSE 'item' END AS kind, (k % 50 + 50) / 100.0 AS score, (60 + k * 3 % 200) * (80 + k * 5 % 180) AS size FROM ev)"""
_PCT = "max(CASE WHEN i = {} THEN units END)"

ORACLE_SQL = {
    "w06_rolling_metrics": f"WITH {ROLLING} SELECT camera, order_no, line_no, mean, p95, top_batch, n FROM ro",
    "a18_last_metrics": f"WITH {LATEST} SELECT camera, mean, p95, n FROM la",
    "a20_worker_percentiles": f"WITH {TIMINGS}, r AS (SELECT shard, units, row_number() OVER (PARTITION BY shard ORDER BY units) - 1 AS i, count(*) OVER (PARTITION BY shard) AS n FROM te), f AS (SELECT shard, {_PCT.format('round_even((n - 1) * 0.5, 0)')} AS p50, {_PCT.format('round_even((n - 1) * 0.95, 0)')} AS p95 FROM r GROUP BY shard) SELECT s AS shard, coalesce((p50 + 500) // 1000 / 10, 0.0) AS p50, coalesce((p95 + 500) // 1000 / 10, 0.0) AS p95 FROM range(5) t(s) LEFT JOIN f ON shard = s",
    "a22_capacity": f"WITH {HOT}, o AS (SELECT units, row_number() OVER (ORDER BY units) - 1 AS i, count(*) OVER () AS n FROM te) SELECT (SELECT count(*) FROM te) AS n, (SELECT count(*) FROM te WHERE batch = 1) AS ones, count(*) FILTER (hot) AS hot_cameras, (SELECT count(*) FROM te WHERE batch = 1) >= 0.85 * (SELECT count(*) FROM te) AND count(*) FILTER (hot) >= 2 AND (SELECT {_PCT.format('ceil((n - 1) * 0.95)')} FROM o) > 5000000 AS warning FROM ho",
    "a26_shard_overview": f"WITH {LATEST}, s AS (SELECT shard, count(*) AS cameras, list_sort(list(mean)) AS means, count(*) FILTER (mean > 550) AS hot, list(CAST(camera AS VARCHAR) ORDER BY p95_units DESC, camera)[1:5] AS top FROM la GROUP BY shard) SELECT shard, cameras, means[CAST(round_even((cameras - 1) * 0.95, 0) AS INTEGER) + 1] AS p95_of_means, hot, array_to_string(top, ',') AS hottest, hot >= 2 AS warning FROM s",
    "a27_hotness": f"WITH {HOT} SELECT camera, score / 100 AS score FROM ho",
    "a28_recommendations": f"WITH {HOT} SELECT camera, hot, CASE WHEN hot THEN 'fast' WHEN calm THEN 'accurate' ELSE 'balanced' END AS profile, CASE WHEN hot THEN array_to_string(reasons, ',') WHEN calm THEN 'latency headroom is high' ELSE 'current load is within balanced profile range' END AS reason FROM ho",
    "a29_rates": f"WITH {EVENTS}, e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS tm, k % 10 = 0 AS s FROM ev), f AS (SELECT camera_id, count(*) FILTER (NOT s) AS n, count(*) FILTER (s) AS z, min(tm) FILTER (NOT s) AS a, max(tm) FILTER (NOT s) AS b FROM e GROUP BY 1) SELECT camera_id, CASE WHEN n >= 2 AND b > a THEN (n - 1) * 86400 / (b - a) END AS per_day, (z * 2000 + n + z) // ((n + z) * 2) / 1000 AS skip_ratio, CAST(epoch(TIMESTAMP '2024-01-30 23:59:59') AS BIGINT) - b AS age_s FROM f",
    "a30_batch_statistics": f"WITH {EVENTS} SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2024-01-01') AS start, count(*) AS frames, CAST(sum(k % 6) AS BIGINT) AS persons, max(k % 6) AS most, count(DISTINCT camera_id) AS cameras, count(*) FILTER (k % 6 >= 4) AS complex FROM ev GROUP BY 1",
    "s34_complexity": f"WITH {BOXES} SELECT frame, count(*) FILTER (kind = 'person') AS persons, count(*) AS complexity FROM bx GROUP BY 1",
    "io10_log_lines": f"WITH {PARSED} SELECT CASE WHEN camera_id IS NOT NULL THEN 'timing' WHEN line LIKE '%FRAME_TIMING%' THEN 'broken' ELSE 'notice' END AS kind, tm IS NULL AS timeless, count(*) AS n FROM ps WHERE tm IS NULL OR tm BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' GROUP BY ALL",
    "io10_log_tree": f"WITH {PARSED} SELECT 'worker-' || camera % 4 AS component, CASE WHEN camera_id IS NOT NULL THEN 'timing' WHEN line LIKE '%FRAME_TIMING%' THEN 'broken' ELSE 'notice' END AS kind, tm IS NULL AS timeless, count(*) AS n FROM ps WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' AND camera % 4 <> 2 GROUP BY ALL",
    "io11_timings": f"WITH {PARSED} SELECT camera_id, stg AS stage, count(*) AS n, CAST(sum(u) AS BIGINT) AS units, max(bt) AS batch FROM ps WHERE camera_id IS NOT NULL GROUP BY ALL",
    "a24_latest_payloads": f"WITH {PARSED}, r AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY tm DESC, order_no DESC, line_no DESC, camera DESC, units DESC, batch DESC, stage DESC) AS r FROM ps WHERE camera_id IS NOT NULL) SELECT camera_id, stg AS stage, u AS units, bt AS batch FROM r WHERE r = 1",
    "a25_log_counters": f"WITH {LINES} SELECT 'invalid frames' AS name, count(*) FILTER (line LIKE '%Dropping invalid frame payload%') AS n FROM ln UNION ALL SELECT 'expired identities', count(*) FILTER (line LIKE '%Expired pending async identity update%') FROM ln UNION ALL SELECT 'a' || camera || '-f', count(*) FROM ln WHERE {_N} = 8 GROUP BY camera",
    "a16_head_count": f"WITH {EVENTS}, l AS (SELECT camera_id, arg_max(k % 6, (ts, event_id)) AS n FROM ev GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN camera_id = 'cam_3' THEN 9 ELSE n END) AS BIGINT) AS with_replacement FROM l",
    "r03_overcapacity": f"WITH {HEADS} SELECT event_id, camera_id, total FROM hd WHERE total > 48",
    "r04_capacity_alerts": f"WITH {HEADS}, b AS (SELECT *, CAST(floor(floor(epoch(ts)) / 21600) AS BIGINT) AS bucket FROM hd WHERE total > 48) SELECT bucket, min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(total, (ts, event_id)) AS total FROM b WHERE bucket NOT IN (SELECT CAST(floor(floor(epoch(ts)) / 21600) AS BIGINT) FROM ev WHERE k = 97) GROUP BY bucket",
    "a33_floor_activity": f"WITH {EVENTS}, {CAMERAS}, l AS (SELECT camera_id, arg_max(k % 6, (ts, event_id)) AS n FROM ev GROUP BY 1), j AS (SELECT l.camera_id, n, trim(floor) AS floor FROM l JOIN ca ON ca.camera_id = l.camera_id WHERE n > 0) SELECT floor, arg_min(camera_id, (-n, camera_id)) AS busiest, arg_min(camera_id, (n, camera_id)) AS calmest FROM j GROUP BY floor",
    "u02_merged_shards": f"WITH {EVENTS} SELECT camera_id, CAST(arg_max(event_id, (ts, event_id)) % 4 AS INTEGER) AS shard, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM ev GROUP BY 1",
    "j18_camera_status": f"WITH {EVENTS}, {CAMERAS}, l AS (SELECT camera_id, CAST(arg_max(event_id, (ts, event_id)) % 4 AS INTEGER) AS shard, arg_max(event_type, (ts, event_id)) AS event_type FROM ev GROUP BY 1) SELECT ca.camera_id, enabled, shard, event_type FROM ca LEFT JOIN l ON l.camera_id = ca.camera_id",
    "j20_target_shards": f"WITH {HOT}, q AS (SELECT shard, units, row_number() OVER (PARTITION BY shard ORDER BY units) - 1 AS i, count(*) OVER (PARTITION BY shard) AS n FROM te), f AS (SELECT shard, {_PCT.format('ceil((n - 1) * 0.95)')} AS p95 FROM q GROUP BY shard), b AS (SELECT arg_min(shard, (p95, shard)) AS s FROM f) SELECT camera, shard, CASE WHEN s <> shard THEN s END AS lightest, (SELECT arg_min(f.shard, (f.p95, f.shard)) FROM f WHERE f.shard <> ho.shard) AS next_lightest FROM ho, b WHERE hot",
    "st18_latest_tasks": f"WITH {EVENTS} SELECT camera_id, CAST(floor(floor(epoch(ts)) / 21600) AS BIGINT) AS slot, arg_max(event_id, (ts, event_id)) AS event_id, count(*) - 1 AS replaced FROM ev GROUP BY ALL",
    "w11_top_persons": f"WITH {BOXES} SELECT frame, obj, CAST(row_number() OVER (PARTITION BY frame ORDER BY score DESC, obj) AS INTEGER) AS r FROM bx WHERE kind = 'person' QUALIFY r <= 2",
    "w12_identity_picks": f"WITH {BOXES}, p AS (SELECT *, CASE WHEN obj % 3 = 0 THEN 0 WHEN obj % 3 = 1 AND obj % 13 >= 10 THEN 1 WHEN obj % 3 = 2 AND obj % 13 >= 8 THEN 2 END AS priority FROM bx WHERE kind = 'person') SELECT frame, obj, priority, CAST(row_number() OVER (PARTITION BY frame ORDER BY priority, size DESC, obj) AS INTEGER) AS r FROM p WHERE priority IS NOT NULL QUALIFY r <= 2",
    "s24_shards": f"WITH {CAMERAS} SELECT camera_id, CASE WHEN camera_id = 'cam_7' THEN 0 ELSE CAST(CAST('0x' || substr(sha256(camera_id), 1, 16) AS UBIGINT) % 4 AS INTEGER) END AS shard FROM ca",
    "s25_camera_of_path": f"WITH {CAMERAS} SELECT camera_id, CASE WHEN number % 3 <> 0 THEN camera_id END AS found FROM ca",
    "s26_durations": f"WITH {EVENTS} SELECT event_id, CASE WHEN k % 5 <> 0 THEN (k * 1234 + 50) // 100 / 10 END AS ms FROM ev",
    "s27_merged_telemetry": f"WITH {EVENTS} SELECT event_id, CAST(k AS VARCHAR) AS a, CASE WHEN k % 2 = 0 THEN 'right' ELSE 'left' END AS b, CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) END AS c FROM ev",
    "st23_profiles": f"WITH {CAMERAS}, w AS (SELECT camera_id, CAST(number % 4 AS INTEGER) AS level, CAST(number % 5 + 1 AS INTEGER) AS base, CASE number % 4 WHEN 0 THEN 'fast' WHEN 2 THEN 'accurate' ELSE 'balanced' END AS profile FROM ca), o AS (SELECT *, CASE profile WHEN 'fast' THEN least(base, 2) WHEN 'accurate' THEN greatest(base, 2) ELSE base END AS own FROM w) SELECT camera_id, profile, level, CASE WHEN level >= 2 THEN 1 WHEN level = 1 THEN least(own, 2) ELSE own END AS fps, profile <> 'fast' AND level < 2 AS pose, profile = 'fast' OR level >= 2 AS unknown_only, CASE WHEN profile = 'fast' OR level >= 2 THEN 1 ELSE 2 END AS identities, CASE WHEN profile = 'fast' OR level >= 3 THEN 2 ELSE 4 END AS persons FROM o",
    "st01_sampled_frames": f"WITH RECURSIVE {EVENTS}, o AS (SELECT camera_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS tm, row_number() OVER (PARTITION BY camera_id ORDER BY floor(epoch(ts)), event_id) AS r FROM ev), f AS (SELECT camera_id, event_id, r, tm + 14400 AS due, true AS kept FROM o WHERE r = 1 UNION ALL SELECT o.camera_id, o.event_id, o.r, CASE WHEN o.tm >= due THEN greatest(due + 14400, o.tm) ELSE due END, o.tm >= due FROM f JOIN o ON o.camera_id = f.camera_id AND o.r = f.r + 1) SELECT camera_id, event_id FROM f WHERE kept",
    "st22_degrade_levels": f"""WITH RECURSIVE {ROLLING}, o AS (SELECT camera, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, order_no, line_no, p95, row_number() OVER (PARTITION BY camera ORDER BY CAST(floor(epoch(ts) / 86400) AS BIGINT), order_no, line_no, p95) AS r FROM ro),
f AS (SELECT camera, order_no, line_no, r, 0 AS level, CAST(-1000000 AS BIGINT) AS since, CASE WHEN p95 >= 980 THEN 3 WHEN p95 >= 960 THEN 2 WHEN p95 >= 940 THEN 1 END AS wish, day AS wished FROM o WHERE r = 1
UNION ALL SELECT camera, order_no, line_no, r, CASE WHEN act THEN level + (CASE WHEN want > level THEN 1 ELSE -1 END) ELSE level END, CASE WHEN act THEN day ELSE since END, CASE WHEN want = level OR act THEN NULL ELSE want END, CASE WHEN want <> level AND (wish IS NULL OR wish <> want) THEN day ELSE wished END
FROM (SELECT *, coalesce(want <> level AND wish = want AND day - since >= 15 AND day - wished >= (CASE WHEN want > level THEN 10 ELSE 25 END), false) AS act
FROM (SELECT o.camera, o.order_no, o.line_no, o.r, o.day, f.level, f.since, f.wish, f.wished, CASE WHEN p95 >= 980 THEN 3 WHEN p95 >= 960 THEN 2 WHEN p95 >= 940 THEN 1 WHEN f.level > 0 AND p95 <= 900 THEN 0 ELSE f.level END AS want FROM f JOIN o ON o.camera = f.camera AND o.r = f.r + 1) a) b)
SELECT camera, order_no, line_no, level FROM f""",
}
