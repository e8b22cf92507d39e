"""The queries of ``operators.search`` in DuckDB's SQL."""

from __future__ import annotations

from sitewatch.functions.vocabulary import LABELS, NO_LABEL, RAW_LABELS, SPELLINGS, TYPES

EVENTS = """ev0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'cam_' || CAST(user_id % 16 AS VARCHAR) AS camera_id FROM events),
ev AS (SELECT *, CASE WHEN k % 10 <> 0 THEN CAST(user_id AS VARCHAR) END AS person_id,
  CASE WHEN k = 98 THEN 'inspection_presence:' || camera_id WHEN k <> 99 THEN 'camera:' || camera_id END AS source,
  event_type IN ('error', 'purchase', 'signup') AS is_violation,
  list_filter([CASE WHEN k & 1 > 0 THEN 'NO-Hardhat' END, CASE WHEN k & 2 > 0 THEN 'no_mask' END, CASE WHEN k & 4 > 0 THEN 'safety vest' END,
    CASE WHEN k & 8 > 0 THEN 'no protective shoes' END, CASE WHEN k & 16 > 0 THEN 'Gloves' END, CASE WHEN k & 32 > 0 THEN 'no_goggles' END, CASE WHEN k & 64 > 0 THEN ' gas-mask' END], lambda x: x IS NOT NULL) AS missing,
  CASE event_type WHEN 'error' THEN ['Unauthorized Intrusion'] WHEN 'signup' THEN ['fall-detected', 'waving'] ELSE CAST([] AS VARCHAR[]) END AS actions,
  list_filter([CASE WHEN k & 1 > 0 THEN 'hardhat' END, CASE WHEN k & 2 > 0 THEN 'mask' END, CASE WHEN k & 4 > 0 THEN 'protective_clothing' END, CASE WHEN k & 8 > 0 THEN 'safety_shoes' END,
    CASE WHEN k & 16 > 0 THEN 'gloves' END, CASE WHEN k & 32 > 0 THEN 'goggles' END, CASE WHEN k & 64 > 0 THEN 'respirator' END,
    CASE event_type WHEN 'error' THEN 'unauthorized_intrusion' WHEN 'signup' THEN 'fall_detected' END], lambda x: x IS NOT NULL) AS types,
  CASE WHEN k % 7 = 0 THEN 'Worker ' || CAST(user_id AS VARCHAR) END AS person_name,
  CASE WHEN k % 2 = 1 THEN CAST([] AS VARCHAR[]) WHEN k % 4 = 0 THEN ['fall_detected', 'hardhat'] END AS stored,
  CASE WHEN k % 3 = 0 THEN 'snaps' END AS bucket, CASE WHEN k % 3 = 0 THEN 'violation/' || event_id || '.jpg' END AS key, CASE WHEN k % 5 = 0 THEN '/data/old/snap_' || event_id || '.jpg' END AS path,
  CASE WHEN k % 2 = 0 THEN [camera_id, 'cam_' || CAST((user_id + 1) % 16 AS VARCHAR)] ELSE [camera_id] END AS cameras FROM ev0)"""
PERSONS = """pe AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 11 = 3 THEN 'track_' || c_custkey WHEN c_custkey % 13 = 4 THEN '   ' WHEN c_custkey % 17 = 5 THEN CAST(c_custkey AS VARCHAR)
  WHEN c_custkey % 19 = 6 THEN 'person_' || c_custkey WHEN c_custkey % 23 = 7 THEN 'Unknown ' || c_custkey ELSE c_name END AS name, c_mktsegment <> 'BUILDING' AS employee, c_acctbal, c_mktsegment, c_custkey FROM customer)"""
CAMERAS = """ca AS (SELECT 'cam_' || s_suppkey AS camera_id, floor, CASE WHEN s_suppkey % 2 = 0 THEN trim(floor) ELSE '' END || ' 通道' || s_suppkey AS name, CASE WHEN s_suppkey % 5 = 0 THEN ' 门' || s_suppkey ELSE '' END AS suffix,
  CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 7 = 1 THEN 'camera.local' ELSE '10.0.' || s_suppkey % 4 || '.' || s_suppkey * 37 % 256 END AS host, s_suppkey % 3 <> 0 AS patrol, s_suppkey % 9 <> 0 AS enabled, s_suppkey AS number, s_acctbal
  FROM (SELECT *, ['一楼', '二楼', ' 三楼', '室外', '地下', '四楼'][CAST(s_suppkey % 6 + 1 AS INTEGER)] AS floor FROM supplier))"""
SCHEDULES = """sd0 AS (SELECT CAST(o_orderdate AS DATE) AS shift_date, CAST(min(o_custkey) AS VARCHAR) AS x, CAST(max(o_custkey) AS VARCHAR) AS y FROM orders GROUP BY 1),
sd AS (SELECT shift_date, datediff('day', DATE '1992-01-01', shift_date) AS day, CASE WHEN day % 7 = 0 THEN x WHEN day % 2 = 0 THEN '["' || x || '", "' || y || '"]' ELSE x || ' , ,' || y END AS day_ids FROM sd0)"""
COUNTERS = """pc0 AS (SELECT person_id, ts, is_violation, row_number() OVER (PARTITION BY person_id ORDER BY ts, event_id) AS r FROM ev WHERE person_id IS NOT NULL),
pc AS (SELECT person_id, r, ts AS seen FROM pc0 WHERE r = 1 UNION ALL SELECT o.person_id, o.r, CASE WHEN o.is_violation OR o.ts - seen >= INTERVAL 6 HOURS THEN o.ts ELSE seen END FROM pc JOIN pc0 o ON o.person_id = pc.person_id AND o.r = pc.r + 1),
co AS (SELECT person_id, count(*) AS events, count(*) FILTER (is_violation) AS violations, (SELECT arg_max(seen, r) FROM pc WHERE pc.person_id = pc0.person_id) AS last_seen FROM pc0 GROUP BY 1)"""
SETTINGS = "st AS (SELECT TIMESTAMP '2024-01-01' + to_days(CAST(n_nationkey * 7 % 25 AS INTEGER)) AS updated_at, n_regionkey + 1 AS interval_hours, n_nationkey FROM nation)"
_NAMES = ", ".join(f"({i + 1}, '{t}', '{LABELS[t]}')" for i, t in enumerate(TYPES))
_RAW = ", ".join(f"('{k}', '{v}')" for k, v in {**RAW_LABELS, **LABELS}.items())
_SPELL = ", ".join(f"('{x}', '{t}', '{LABELS[t]}', {i})" for t, xs in SPELLINGS.items() for i, x in enumerate(xs))
_KEY = "translate(lower(trim({})), '- ', '__')"
_IDS = "list_filter(list_transform(CASE WHEN day_ids LIKE '[%' THEN CAST(CAST(day_ids AS JSON) AS VARCHAR[]) ELSE string_split(day_ids, ',') END, lambda x: trim(x)), lambda x: x <> '')"
_WRITTEN = f"""{EVENTS}, wr AS (SELECT event_id, [s || 'Z', s || '+08:00', s || '.250', s || '.5-05:30', 'yesterday'][CAST(event_id % 5 + 1 AS INTEGER)] AS text,
  [date_trunc('second', ts), date_trunc('second', ts), date_trunc('second', ts) + INTERVAL 250 MILLISECONDS, date_trunc('second', ts) + INTERVAL 500 MILLISECONDS, NULL][CAST(event_id % 5 + 1 AS INTEGER)] AS plain FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS s FROM ev))"""

ORACLE_SQL = {
    "f01_filtered_events": f"WITH {EVENTS} SELECT event_id, ts, camera_id FROM ev WHERE camera_id = 'cam_3' AND is_violation AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'",
    "f05_name_search": f"WITH {EVENTS}, {PERSONS} SELECT event_id, person_id, camera_id FROM ev WHERE person_name ILIKE '%42%' OR person_id IN (SELECT id FROM pe WHERE name ILIKE '%42%')",
    "f07_with_evidence": f"WITH {EVENTS} SELECT event_id FROM ev WHERE is_violation AND (key IS NOT NULL OR path IS NOT NULL)",
    "f06_raw_type_filter": f"WITH {EVENTS} SELECT event_id FROM ev WHERE k & 8 > 0",
    "f11_invalid_employees": f"WITH {PERSONS} SELECT id, name FROM pe WHERE employee AND (trim(name) = '' OR trim(name) = id OR lower(name) LIKE 'track\\_%' ESCAPE '\\' OR lower(name) LIKE 'unknown%' OR lower(name) LIKE 'person\\_%' ESCAPE '\\')",
    "io02_event_by_id": f"WITH {EVENTS} SELECT event_id, ts, camera_id, event_type FROM ev WHERE event_id = 123",
    "io03_latest_settings": f"WITH {SETTINGS} SELECT * FROM st ORDER BY updated_at DESC, n_nationkey DESC LIMIT 1",
    "f16_patrol_sightings": f"WITH {EVENTS}, {PERSONS}, {CAMERAS}, {SETTINGS} SELECT event_id, person_id, camera_id FROM ev WHERE event_type = 'view' AND person_id IN (SELECT id FROM pe WHERE c_custkey % 5 = 0) AND camera_id IN (SELECT camera_id FROM ca WHERE patrol) AND (SELECT interval_hours FROM st ORDER BY updated_at DESC, n_nationkey DESC LIMIT 1) > 0",
    "p01_labels": f"WITH {EVENTS}, raw(key, label) AS (VALUES {_RAW}), x AS (SELECT event_id, unnest(missing || actions) AS r, generate_subscripts(missing || actions, 1) AS i FROM ev), y AS (SELECT event_id, i, coalesce(label, CASE WHEN {_KEY.format('r')} = '' THEN '{NO_LABEL}' ELSE replace({_KEY.format('r')}, '_', ' ') END) AS label FROM x LEFT JOIN raw ON key = {_KEY.format('r')}) SELECT ev.event_id, coalesce(string_agg(label, ';' ORDER BY i), '') AS labels FROM ev LEFT JOIN y ON y.event_id = ev.event_id GROUP BY 1",
    "p02_effective_types": f"WITH {EVENTS} SELECT event_id, array_to_string(CASE WHEN len(stored) > 0 THEN stored ELSE types END, ',') AS types FROM ev",
    "p03_evidence_urls": f"WITH {EVENTS} SELECT event_id, CASE WHEN key IS NOT NULL THEN '/api/events/objects/' || bucket || '/' || key WHEN path IS NOT NULL THEN '/api/events/snapshots/' || parse_filename(path) END AS url FROM ev",
    "p04_event_names": f"WITH {EVENTS}, {PERSONS}, s AS (SELECT *, CASE WHEN k % 20 = 0 THEN 'unknown:' || user_id ELSE person_id END AS shown FROM ev) SELECT event_id, CASE WHEN shown LIKE 'unknown:%' THEN 'unknown' ELSE coalesce(person_name, name, shown) END AS name FROM s LEFT JOIN pe ON id = shown",
    "p05_camera_names": f"WITH {EVENTS}, {CAMERAS}, x AS (SELECT event_id, unnest(cameras) AS c, generate_subscripts(cameras, 1) AS i FROM ev) SELECT event_id, string_agg(coalesce(name, c), '、' ORDER BY i) AS names FROM x LEFT JOIN ca ON camera_id = c GROUP BY 1",
    "p06_gallery_messages": f"WITH {EVENTS}, r AS (SELECT *, missing || list_transform(actions, lambda a: 'action:' || a) AS raw FROM ev WHERE is_violation) SELECT event_id, coalesce(person_id, 'unknown person') || CASE WHEN len(raw) > 0 THEN ' missing ' || replace(array_to_string(raw, ', '), '_', ' ') ELSE ' violation' END AS message FROM r",
    "p09_camera_short_names": f"WITH {CAMERAS}, t AS (SELECT camera_id, trim(suffix) AS s, trim(floor) AS f, trim(name) AS n FROM ca) SELECT camera_id, CASE WHEN s <> '' THEN s WHEN starts_with(n, f) AND trim(substr(n, length(f) + 1)) <> '' THEN trim(substr(n, length(f) + 1)) ELSE n END AS short FROM t",
    "p10_event_options": f"WITH {EVENTS}, x AS (SELECT unnest(types) AS t FROM ev WHERE source NOT LIKE 'inspection_presence:%') SELECT position, key, label, count(t) AS events FROM (VALUES {_NAMES}) n(position, key, label) LEFT JOIN x ON t = key GROUP BY ALL",
    "o01_event_total": f"WITH {EVENTS} SELECT count(*) AS total FROM ev WHERE camera_id = 'cam_3' AND is_violation",
    "o03_person_order": f"WITH {PERSONS} SELECT row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS place, id FROM pe WHERE employee",
    "o04_camera_order": f"WITH {CAMERAS}, t AS (SELECT *, CASE trim(floor) WHEN '一楼' THEN 1 WHEN '二楼' THEN 2 WHEN '三楼' THEN 3 WHEN '四楼' THEN 4 WHEN '室外' THEN 5 WHEN '户外' THEN 5 ELSE 99 END AS a, CASE WHEN host LIKE '10.%' THEN 167772160 + CAST(split_part(host, '.', 3) AS BIGINT) * 256 + CAST(split_part(host, '.', 4) AS BIGINT) ELSE 4294967295 END AS b FROM ca) SELECT row_number() OVER (ORDER BY a, b, host, trim(floor), trim(suffix), trim(name), camera_id) AS place, camera_id FROM t",
    "o05_schedule_page": f"WITH {SCHEDULES} SELECT shift_date, day_ids, (SELECT count(*) FROM sd) AS total, (SELECT count(*) FROM sd) > 30 AS has_more FROM sd ORDER BY shift_date DESC LIMIT 10 OFFSET 20",
    "o06_latest_snapshots": f"WITH {EVENTS}, n AS (SELECT * FROM ev WHERE is_violation ORDER BY ts DESC, event_id DESC LIMIT 40) SELECT event_id, ts FROM n WHERE key IS NOT NULL OR path IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 10",
    "o07_alert_feed": f"WITH {EVENTS} SELECT event_id, ts FROM ev WHERE is_violation AND ts BETWEEN TIMESTAMP '2024-01-30 11:59:59' AND TIMESTAMP '2024-01-30 23:59:59' ORDER BY ts DESC, event_id DESC LIMIT 10",
    "o08_camera_type_table": f"WITH {EVENTS}, x AS (SELECT camera_id, unnest(types) AS t FROM ev WHERE is_violation) SELECT camera_id, count(*) FILTER (t = 'hardhat') AS hardhat, count(*) FILTER (t = 'mask') AS mask, count(*) FILTER (t = 'protective_clothing') AS protective_clothing FROM x WHERE t IN ('hardhat', 'mask', 'protective_clothing') GROUP BY 1",
    "o09_visits": "SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderdate + to_days(CAST(o_orderkey % 20 AS INTEGER)) DESC, o_orderkey) AS place, o_orderkey FROM orders QUALIFY place <= 20",
    "u01_gallery": f"WITH {PERSONS} SELECT CASE WHEN employee THEN 'employee' ELSE 'external_person' END AS subject_type, id AS subject_id, name FROM pe UNION ALL SELECT 'external_registration', CAST(s_suppkey AS VARCHAR), s_name FROM supplier",
    "u03_schedule_rows": f"WITH {SCHEDULES} SELECT shift_date, CASE WHEN day % 10 = 0 THEN 'override' WHEN day % 4 <> 0 THEN day_ids ELSE day_ids || '*' END AS day_ids FROM sd WHERE day % 10 = 0 OR day % 4 <> 0 OR day % 3 <> 0",
    "u04_set_algebra": f"WITH {EVENTS}, w AS (SELECT event_id, missing AS a, lag(missing) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM ev), i AS (SELECT *, len(list_intersect(a, b)) AS n, len(a) AS x, len(b) AS y FROM w WHERE b IS NOT NULL) SELECT event_id, x + y - n AS n_union, n AS n_both, x - n AS n_new, x = n AS inside, CASE WHEN x = 0 AND y = 0 THEN true WHEN x = 0 OR y = 0 THEN false ELSE n >= 0.5 * least(x, y) END AS similar FROM i",
    "s03_expanded_types": f"""WITH {EVENTS}, sp AS (SELECT type AS name, spelling, i FROM (VALUES {_SPELL}) t(spelling, type, label, i) UNION ALL SELECT 'new-type', 'new_type', 0), nm AS (SELECT name, string_agg(spelling, '|' ORDER BY i) AS spellings FROM sp GROUP BY 1 UNION ALL SELECT ' ', ''),
x AS (SELECT event_id, unnest(missing || actions) AS r FROM ev), c AS (SELECT name, count(DISTINCT event_id) AS n FROM x JOIN sp ON spelling = {_KEY.format('r')} GROUP BY 1) SELECT nm.name, spellings, coalesce(n, 0) AS events FROM nm LEFT JOIN c ON c.name = nm.name""",
    "s04_label_counts": f"WITH {EVENTS}, sp(spelling, type, label, i) AS (VALUES {_SPELL}), x AS (SELECT unnest(missing || actions) AS raw FROM ev) SELECT coalesce(label, {_KEY.format('raw')}) AS label, count(*) AS n FROM x LEFT JOIN sp ON spelling = {_KEY.format('raw')} GROUP BY 1",
    "s05_naive_times": f"WITH {_WRITTEN} SELECT event_id, plain AS at FROM wr",
    "s06_local_times": f"WITH {_WRITTEN} SELECT event_id, plain + CASE event_id % 5 WHEN 0 THEN INTERVAL 8 HOURS WHEN 3 THEN INTERVAL 810 MINUTES ELSE INTERVAL 0 HOURS END AS at FROM wr",
    "s08_schedule_ids": f"WITH {SCHEDULES} SELECT shift_date, array_to_string({_IDS}, '|') AS ids FROM sd",
    "s09_polygons": f"WITH {CAMERAS} SELECT camera_id, CASE WHEN number % 4 = 3 THEN 0 ELSE 2 END AS corners, CAST(CASE WHEN number % 4 = 3 THEN 0 ELSE number * 2 + 6.5 * number * 2 END AS DOUBLE) AS mixed FROM ca",
    "j17_on_duty": f"WITH {SCHEDULES}, {PERSONS}, x AS (SELECT shift_date, unnest({_IDS}) AS i, generate_subscripts({_IDS}, 1) - 1 AS place FROM sd) SELECT shift_date, CAST(place AS INTEGER) AS place, id, name FROM x JOIN pe ON id = i",
    "j19_missing_snapshots": f"WITH {EVENTS} SELECT camera_id, count(*) AS n, count(*) FILTER (event_id % 4 = 0) AS missing FROM ev WHERE is_violation AND key IS NOT NULL GROUP BY 1",
    "j21_without_camera": f"WITH {EVENTS} SELECT event_id, array_to_string(list_filter(cameras, lambda c: c <> 'cam_4'), ',') AS cameras FROM ev WHERE list_contains(cameras, 'cam_4')",
    "f17_export_rows": f"WITH {EVENTS} SELECT row_number() OVER (ORDER BY ts, event_id) AS place, event_id, key FROM ev WHERE is_violation AND key IS NOT NULL",
    "a14_person_counters": f"WITH RECURSIVE {EVENTS}, {COUNTERS} SELECT * FROM co",
    "a13_top_counters": f"WITH RECURSIVE {EVENTS}, {COUNTERS} SELECT row_number() OVER (ORDER BY violations DESC, last_seen DESC, person_id) AS place, person_id, violations FROM co QUALIFY place <= 5",
    "a11_online_cameras": f"WITH {EVENTS}, {CAMERAS} SELECT (SELECT count(*) FROM ca WHERE enabled) AS online, (SELECT max(ts) FROM ev WHERE event_type = 'view') AS last_patrol_at",
    "a31_life_sets": f"WITH {EVENTS} SELECT user_id, CAST(ts AS DATE) AS day, coalesce(array_to_string(list_sort(list_distinct(flatten(list(missing)))), '|'), '') AS missing FROM ev WHERE is_violation GROUP BY ALL",
    "a32_active_by_source": f"WITH {EVENTS}, l AS (SELECT source, arg_max(is_violation, (ts, event_id)) AS open FROM ev GROUP BY user_id, source) SELECT source, count(*) AS active FROM l WHERE open GROUP BY 1",
    "j14_clip_frames": f"WITH {EVENTS}, t AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM ev) SELECT v.event_id AS event, count(*) AS frames, min(f.at) AS first_at, max(f.at) AS last_at FROM t v JOIN t f ON v.is_violation AND f.camera_id = v.camera_id AND f.at BETWEEN v.at - 180 AND v.at + 180 GROUP BY 1",
}
