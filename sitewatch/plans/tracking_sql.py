"""The queries of ``operators.tracking`` and what came last in ``search`` and ``spatial``, in DuckDB's SQL."""

from __future__ import annotations

from sitewatch.functions.vocabulary import LABELS
from sitewatch.plans.search_sql import EVENTS, SCHEDULES
from sitewatch.plans.spatial_sql import BOXES

_CENTRE = "(i.x1 + i.x2) / 2 BETWEEN p.x1 AND p.x2 AND (i.y1 + i.y2) / 2 BETWEEN p.y1 AND p.y2"
_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in LABELS.items())


def _scaled(x: str, y: str) -> str:
    zone, text = [(64.0, 96.0), (512.0, 120.0), (480.0, 432.0), (128.0, 384.0)], "false"
    for (ax, ay), (bx, by) in zip(zone, zone[1:] + zone[:1]):
        text = f"({text} <> ((({ay}e0 > {y}) <> ({by}e0 > {y})) AND {x} < {bx - ax}e0 * ({y} - {ay}e0) / {by - ay}e0 + {ax}e0))"
    return text


ORACLE_SQL = {
    "st11_stable_tracks": f"""WITH RECURSIVE {EVENTS}, o AS (SELECT camera_id, event_id, CASE WHEN k % 3 = 0 THEN user_id END AS person, user_id * 3 % 5 + k % 2 * 5 AS raw, row_number() OVER (PARTITION BY camera_id ORDER BY floor(epoch(ts)), event_id) AS r FROM ev),
f AS (SELECT camera_id, event_id, r, CAST(1 AS BIGINT) AS track, CAST(2 AS BIGINT) AS nxt, [{{'k': raw, 'i': CAST(1 AS BIGINT)}}] AS raws, list_filter([{{'k': person, 'i': CAST(1 AS BIGINT)}}], lambda x: x.k IS NOT NULL) AS ps FROM o WHERE r = 1
UNION ALL SELECT camera_id, event_id, r, coalesce(found, nxt), CASE WHEN found IS NULL THEN nxt + 1 ELSE nxt END, list_append(list_filter(raws, lambda x: x.k <> raw), {{'k': raw, 'i': coalesce(found, nxt)}}),
  CASE WHEN person IS NULL THEN ps ELSE list_append(list_filter(ps, lambda x: x.k <> person), {{'k': person, 'i': coalesce(found, nxt)}}) END
FROM (SELECT o.*, nxt, raws, ps, coalesce(CASE WHEN person IS NOT NULL THEN list_filter(ps, lambda x: x.k = o.person)[1].i END, list_filter(raws, lambda x: x.k = o.raw)[1].i) AS found FROM f JOIN o ON o.camera_id = f.camera_id AND o.r = f.r + 1) t)
SELECT camera_id, event_id, track FROM f""",
    "st14_face_attempts": f"""WITH RECURSIVE {EVENTS}, o AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, k % 4 = 0 AS matches, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS r FROM ev),
f AS (SELECT user_id, event_id, r, t AS seen, 0 AS since, matches AS matched, true AS looks FROM o WHERE r = 1
UNION ALL SELECT user_id, event_id, r, t, CASE WHEN l THEN 0 ELSE since + 1 END, CASE WHEN l THEN matches ELSE matched END, l FROM (SELECT o.*, since, matched, o.t - seen > 172800 OR since + 1 >= CASE WHEN matched THEN 8 ELSE 10 END AS l FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1) x)
SELECT user_id, event_id FROM f WHERE looks""",
    "st12_frame_identities": f"""WITH RECURSIVE {BOXES}, o AS (SELECT frame, obj, CASE WHEN k % 3 = 0 THEN 'p' || k % 5 END AS face, ['p' || k % 4, 'p' || (k + 1) % 5] AS cands, CASE WHEN k % 7 < 4 THEN 'p' || obj % 6 END AS trk,
  row_number() OVER (PARTITION BY frame ORDER BY CAST(k % 3 <> 0 AS INTEGER), score DESC, obj) AS r FROM bx WHERE kind = 'person'),
f AS (SELECT frame, obj, r, coalesce(face, cands[1]) AS ident, [coalesce(face, cands[1])] AS taken FROM o WHERE r = 1
UNION ALL SELECT frame, obj, r, ident, list_append(taken, ident) FROM (SELECT o.frame, o.obj, o.r, taken, coalesce(CASE WHEN NOT list_contains(taken, face) THEN face END, list_filter(cands, lambda c: NOT list_contains(taken, c))[1], CASE WHEN NOT list_contains(taken, trk) THEN trk END, 'unknown:' || o.obj) AS ident FROM f JOIN o ON o.frame = f.frame AND o.r = f.r + 1) x)
SELECT frame, obj, ident AS identity FROM f""",
    "j03_equipment_of_persons": f"WITH {BOXES}, q AS (SELECT p.frame, p.obj AS person, i.k % 3 AS m, greatest(0, least(p.x2, i.x2) - greatest(p.x1, i.x1)) * greatest(0, least(p.y2, i.y2) - greatest(p.y1, i.y1)) AS b, p.w * p.h AS pa, i.w * i.h AS ia, {_CENTRE} AS c FROM bx p JOIN bx i ON p.frame = i.frame AND p.kind = 'person' AND i.kind = 'item'), g AS (SELECT frame, person, bool_or(m = 0 AND b / ia >= 0.5) AS worn, bool_or(m = 1 AND (c OR greatest(b / ia, b / pa) >= 0.1 OR b / (pa + ia - b) >= 0.1)) AS l FROM q GROUP BY ALL) SELECT frame, person, worn, l AND NOT worn AS missing, CASE WHEN NOT worn AND NOT (l AND NOT worn) THEN 0.45e0 ELSE 0.0e0 END AS supposed FROM g",
    "s16_box_shapes": f"WITH {BOXES} SELECT obj, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, y2 AS bottom, w * h AS area, h / w AS aspect FROM bx",
    "s17_in_scaled_zone": f"WITH {BOXES} SELECT obj FROM bx WHERE {_scaled('((x1 + x2) / 2)', 'y2')}",
    "f09_exemption": "SELECT count(*) > 0 AS exempt FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30 12:00:00' AND o_orderdate + to_days(CAST(o_orderkey % 20 AS INTEGER)) >= TIMESTAMP '1998-06-30 12:00:00'",
    "io13_archive_index": f"WITH {EVENTS}, m AS (SELECT 1 + event_id % 3 AS p, event_id AS place, 'own/store/' || key AS member, key, 'snap ' || event_id || repeat('.', event_id % 50) AS body FROM ev WHERE key IS NOT NULL UNION ALL SELECT CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 + event_id % 3 END, event_id + 1099511627776, 'again/store/' || key, key, 'again ' || event_id FROM ev WHERE key IS NOT NULL AND event_id % 5 = 0) SELECT key, 'part-' || min(p) || '.tar' AS part, arg_min(member, (p, place)) AS member, length(arg_min(body, (p, place))) AS size, md5(arg_min(body, (p, place))) AS md5 FROM m GROUP BY key",
    "io14_exported_rows": f"WITH {EVENTS} SELECT event_id, ts, key FROM ev WHERE is_violation AND key IS NOT NULL",
    "s30_file_names": f"WITH {EVENTS} SELECT event_id, 'snap_' || event_id || '.jpg' AS base, strftime(ts, '%Y-%m-%d_%H-%M-%S') || '.jpg' AS export FROM ev WHERE path IS NOT NULL",
    "s31_formatted": f"WITH {EVENTS}, nm(k_, v) AS (VALUES {_NAMES}) SELECT event_id, CASE event_id % 5 WHEN 0 THEN (SELECT v FROM nm WHERE k_ = 'fall_detected') WHEN 1 THEN (SELECT v FROM nm WHERE k_ = 'hardhat') WHEN 2 THEN (SELECT v FROM nm WHERE k_ = 'safety_shoes') WHEN 3 THEN 'New Kind Of Thing' ELSE (SELECT v FROM nm WHERE k_ = 'gloves') END AS label, CASE event_id % 5 WHEN 0 THEN '人员 #' || user_id WHEN 1 THEN '轨迹 #' || user_id WHEN 4 THEN CAST(user_id AS VARCHAR) ELSE '未知人员' END AS person FROM ev",
    "s32_presets": f"WITH {EVENTS} SELECT p AS preset, (SELECT count(*) FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-30' - to_days(n) AND TIMESTAMP '2024-01-30 23:59:59') AS n FROM (VALUES ('today', 0), ('3days', 3), ('7days', 7), ('30days', 30)) t(p, n)",
    "s33_day_ranges": f"WITH {SCHEDULES} SELECT shift_date, strftime(shift_date, '%Y-%m-%d') || 'T' || CASE WHEN day % 2 = 0 THEN '08:15' ELSE '00:00' END || ':00' AS start, strftime(shift_date, '%Y-%m-%d') || 'T' || CASE WHEN day % 3 = 0 THEN '17:45' ELSE '23:59' END || ':59' AS end FROM sd",
}
