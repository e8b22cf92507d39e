"""The queries of ``operators.lifecycle`` in DuckDB's SQL."""

from __future__ import annotations

from sitewatch.functions.vocabulary import PPE
from sitewatch.plans.search_sql import EVENTS

FRAMES = f"{EVENTS}, fr AS (SELECT event_id, user_id, ts, k, is_violation, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame FROM ev)"
_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
_N = {"hardhat": 5, "protective_clothing": 5}


def _list(conditions: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{PPE[i]}' END" for i, c in enumerate(conditions)) + "], lambda x: x IS NOT NULL)"


def _held(seen: str, strict: bool) -> str:
    keep = "lambda x: x NOT IN ('hardhat', 'protective_clothing')" if strict else "lambda x: true"
    return f"""{seen}, h1 AS (SELECT *, last_value(CASE WHEN len(seen) > 0 THEN seen END IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING) AS last, last_value(CASE WHEN len(seen) > 0 THEN frame END IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING) AS lf,
  last_value(CASE WHEN len(seen) > 0 THEN frame END IGNORE NULLS) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pf, last_value(CASE WHEN len(seen) > 0 THEN seen END IGNORE NULLS) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM h0),
h2 AS (SELECT *, list_filter(last, {keep}) AS held, CAST(len(seen) > 0 AND (pf IS NULL OR frame - pf > 3 OR (frame - pf > 1 AND len(list_filter(ps, {keep})) = 0)) AS INTEGER) AS fresh FROM h1),
h3 AS (SELECT *, sum(fresh) {_W} ROWS UNBOUNDED PRECEDING) AS run FROM h2),
h4 AS (SELECT *, sum(CAST(len(seen) > 0 AS INTEGER)) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM h3)
SELECT event_id, array_to_string(CASE WHEN len(seen) > 0 THEN seen WHEN frame - lf < 3 THEN held ELSE [] END, ',') AS stable, CAST(CASE WHEN len(seen) > 0 OR (frame - lf < 3 AND len(held) > 0) THEN c ELSE 0 END AS BIGINT) AS duration FROM h4"""


_BINARY = f"{FRAMES}, h0 AS (SELECT *, " + _list([f"sum((k >> {i}) & 1) {_W} ROWS {_N.get(n, 3) - 1} PRECEDING) = {_N.get(n, 3)}" for i, n in enumerate(PPE)]) + " AS seen FROM fr)"
_CONF = f"{FRAMES}, cf AS (SELECT *, " + ", ".join(f"CASE WHEN (k >> {i}) & 1 = 1 THEN (k * 7 + {13 * i}) % 100 ELSE 0 END / 100 AS c{i}" for i in range(7)) + " FROM fr)"


def _lag(i: int, n: int) -> str:
    return f"lag(c{i}, {n}) {_W})" if n else f"c{i}"


def _fused(i: int) -> str:
    low = 1 - 0.7
    return f"0.7e0 * {_lag(i, 0)} + {low!r}e0 * (0.7e0 * {_lag(i, 1)} + {low!r}e0 * {_lag(i, 2)})"


_STABLE = f"{_CONF}, h0 AS (SELECT *, " + _list([
    f"min(c{i}) {_W} ROWS 4 PRECEDING) >= 0.4e0 AND count(*) {_W} ROWS 4 PRECEDING) = 5" if n in _N else f"{_fused(i)} >= 0.4e0" for i, n in enumerate(PPE)]) + " AS seen FROM cf)"
MASKS = f"""{FRAMES}, ma AS (SELECT user_id, frame, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CASE WHEN is_violation THEN k & 127 ELSE 0 END AS p,
  CASE WHEN NOT is_violation THEN 0 WHEN event_type = 'error' THEN 1 WHEN event_type = 'signup' THEN 2 ELSE 0 END AS a FROM fr)"""
_UNLIKE = "(p > 0 AND ap > 0 AND 2 * bit_count(p & ap) < least(bit_count(p), bit_count(ap)))"
_CYCLE = f"""{MASKS}, f AS (SELECT user_id, frame, p > 0 OR a > 0 AS act, frame AS first_frame, 'new' AS opened, p AS ap, a AS aa, false AS done, CAST(NULL AS BIGINT) AS d_first, CAST(NULL AS VARCHAR) AS d_opened, CAST(NULL AS VARCHAR) AS d_closed, 0 AS dp, 0 AS da FROM ma WHERE frame = 1
UNION ALL SELECT m.user_id, m.frame, p > 0 OR a > 0, CASE WHEN act AND (p > 0 OR a > 0) AND NOT {_UNLIKE} THEN f.first_frame ELSE m.frame END,
  CASE WHEN act AND {_UNLIKE} THEN 'changed' WHEN act AND (p > 0 OR a > 0) THEN f.opened ELSE 'new' END, CASE WHEN act AND NOT {_UNLIKE} AND (p > 0 OR a > 0) THEN ap | p ELSE p END, a,
  act AND ((p = 0 AND a = 0) OR {_UNLIKE}), f.first_frame, f.opened, CASE WHEN p = 0 AND a = 0 THEN 'ended' ELSE 'changed' END, ap, aa FROM f JOIN ma m ON m.user_id = f.user_id AND m.frame = f.frame + 1)"""
_KINDS = ", ".join(str(1 << i) for i in range(9))
_ROTATE = f"""{MASKS}, mv AS (SELECT *, p | (a << 7) AS v FROM ma),
f AS (SELECT user_id, frame, v > 0 AS act, frame AS first_frame, 'new' AS opened, v AS al, list_transform([{_KINDS}], lambda x: CASE WHEN v & x > 0 THEN t END) AS alerts, false AS done, CAST(NULL AS BIGINT) AS d_first, CAST(NULL AS VARCHAR) AS d_opened, CAST(NULL AS VARCHAR) AS d_closed, 0 AS dal FROM mv WHERE frame = 1
UNION ALL SELECT user_id, frame, make OR (act AND NOT ends), CASE WHEN make THEN frame ELSE first_frame END, CASE WHEN make THEN why ELSE opened END, CASE WHEN make THEN alertable ELSE grown END,
  CASE WHEN make THEN list_transform(alerts, lambda o, i: CASE WHEN alertable & (1 << CAST(i - 1 AS INTEGER)) > 0 THEN t ELSE o END) ELSE alerts END, act AND ends, first_frame, opened, ended, dal_new
FROM (SELECT *, alertable > 0 AND why IS NOT NULL AS make, act AND (ended IS NOT NULL) AS ends, CASE WHEN ended = 'cooldown' THEN grown ELSE al END AS dal_new
FROM (SELECT *, CASE WHEN NOT act THEN NULL WHEN v = 0 THEN 'ended' WHEN unlike THEN 'changed' WHEN alertable > 0 AND v & ~al = 0 THEN 'cooldown' END AS ended,
  CASE WHEN NOT act THEN CASE WHEN v > 0 THEN 'new' END WHEN v = 0 THEN NULL WHEN unlike THEN 'changed' WHEN alertable > 0 AND v & ~al = 0 THEN 'cooldown' END AS why, ((al & 127) | p) | (a << 7) AS grown
FROM (SELECT m.user_id, m.frame, m.t, m.p, m.a, m.v, f.act, f.first_frame, f.opened, f.al, f.alerts, (m.p > 0 AND f.al & 127 > 0 AND 2 * bit_count(m.p & f.al & 127) < least(bit_count(m.p), bit_count(f.al & 127))) AS unlike,
  CAST(list_sum(list_transform(f.alerts, lambda o, i: CASE WHEN m.v & (1 << CAST(i - 1 AS INTEGER)) > 0 AND (o IS NULL OR m.t - o >= 172800) THEN 1 << CAST(i - 1 AS INTEGER) ELSE 0 END)) AS INTEGER) AS alertable
  FROM f JOIN mv m ON m.user_id = f.user_id AND m.frame = f.frame + 1) x) y) z)"""
WINDOWS = f"""{EVENTS}, wi0 AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(epoch(date_trunc('day', ts)) AS BIGINT) + 30600 AS o FROM ev),
wi AS (SELECT *, CASE WHEN t >= o THEN o ELSE o - 86400 END AS org FROM wi0), wj AS (SELECT *, org + (t - org) // 18000 * 18000 AS ws FROM wi)"""
_SUBJECTS = f"""{EVENTS}, su0 AS (SELECT event_id, ['unknown', 'employee', 'external_person', 'external_registration'][CAST(user_id % 4 + 1 AS INTEGER)] AS subject,
  (k & 127) | CASE event_type WHEN 'error' THEN 512 WHEN 'signup' THEN 16384 ELSE 0 END AS types, CAST(user_id % 16 AS INTEGER) AS c, CAST((user_id * 3571 + 600) % 32768 AS INTEGER) AS own, 517 AS other, user_id % 7 <> 0 AS active, user_id % 3 <> 0 AS ok FROM ev),
su1 AS (SELECT *, CASE WHEN c % 5 = 0 THEN 0 ELSE ((c * 7919 + 513) % 32768) | ((c * 104729 + 4096) % 32768) END AS conf FROM su0),
su2 AS (SELECT *, CASE WHEN subject = 'unknown' THEN other WHEN subject = 'external_registration' AND NOT active THEN 512 ELSE own END AS scope,
  CASE WHEN conf & 512 > 0 AND (subject = 'unknown' OR (subject = 'external_registration' AND (NOT active OR (own & 512 > 0 AND NOT ok)))) THEN 512 ELSE 0 END AS forced FROM su1),
su AS (SELECT event_id, subject, CASE WHEN conf = 0 THEN 0 ELSE (types & ((scope & conf) | forced | (conf & 4096))) | forced END AS kept, forced FROM su2)"""

ORACLE_SQL = {
    "st02_temporal_binary": f"WITH {_held(_BINARY, False)}",
    "st03_temporal_confidence": f"WITH {_held(_STABLE, True)}",
    "w03_fusions": f"WITH {_CONF} SELECT event_id, {_fused(1)} AS ema, sum(CAST(round(c1 * 100) AS BIGINT)) {_W} ROWS 2 PRECEDING) / count(*) {_W} ROWS 2 PRECEDING) AS mean, max(CAST(round(c1 * 100) AS BIGINT)) {_W} ROWS 2 PRECEDING) AS most FROM cf",
    "w04_smoothed_actions": f"WITH {FRAMES}, b AS (SELECT *, event_type = 'view' AS x, k % 3 = 0 AS y, lag(event_type = 'view', 1, false) {_W}) AS px, lag(k % 3 = 0, 1, false) {_W}) AS py FROM fr), l AS (SELECT event_id, last_value(CASE WHEN x AND px THEN 1 WHEN NOT x AND NOT px THEN 0 END IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING) AS x, last_value(CASE WHEN y AND py THEN 1 WHEN NOT y AND NOT py THEN 0 END IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING) AS y FROM b) SELECT event_id, concat_ws(',', CASE WHEN x = 1 THEN 'away' END, CASE WHEN y = 1 THEN 'busy' END) AS actions FROM l",
    "st04_event_lifecycle": f"WITH RECURSIVE {_CYCLE}, z AS (SELECT * FROM f QUALIFY frame = max(frame) OVER (PARTITION BY user_id)) SELECT user_id, d_first AS first_frame, frame - 1 AS end_frame, d_opened AS opened, d_closed AS closed, dp AS p, da AS a FROM f WHERE done UNION ALL SELECT user_id, first_frame, frame, opened, 'source end', ap, aa FROM z WHERE act",
    "st06_lifecycle_with_rotation": f"WITH RECURSIVE {_ROTATE}, z AS (SELECT * FROM f QUALIFY frame = max(frame) OVER (PARTITION BY user_id)) SELECT user_id, d_first AS first_frame, frame - 1 AS end_frame, d_opened AS opened, d_closed AS closed, dal & 127 AS p, dal >> 7 AS a FROM f WHERE done UNION ALL SELECT user_id, first_frame, frame, opened, 'source end', al & 127, al >> 7 FROM z WHERE act",
    "st05_cooldown": f"WITH RECURSIVE {EVENTS}, o AS (SELECT user_id, event_type, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(epoch(ts)), event_id) AS r FROM ev WHERE is_violation), f AS (SELECT *, t AS alert, true AS kept FROM o WHERE r = 1 UNION ALL SELECT o.*, CASE WHEN o.t - alert >= 21600 THEN o.t ELSE alert END, o.t - alert >= 21600 FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.r = f.r + 1) SELECT user_id, event_type, event_id FROM f WHERE kept",
    "s12_last_windows": f"WITH {WINDOWS} SELECT event_id, CASE WHEN ws > org THEN ws - 18000 ELSE org - 86400 + 86399 // 18000 * 18000 END AS window_start FROM wj",
    "st17_settled_windows": f"WITH {WINDOWS}, rc AS (SELECT ws, count(DISTINCT camera_id) AS c FROM wj WHERE event_type = 'view' AND ws + 18000 <= epoch(TIMESTAMP '2024-01-30 23:59:59') GROUP BY 1), cal AS (SELECT d * 86400 + 30600 + i * 18000 AS ws FROM range((SELECT (min(ws) - 30600) // 86400 FROM rc), (SELECT (max(ws) - 30600) // 86400 + 1 FROM rc)) a(d), range(5) b(i)) SELECT cal.ws AS window_start, coalesce(c, 0) AS covered, CASE WHEN c IS NULL THEN 'none covered' WHEN c < (SELECT count(DISTINCT camera_id) FROM ev) THEN 'some missing' ELSE 'covered' END AS state FROM cal LEFT JOIN rc ON rc.ws = cal.ws WHERE cal.ws BETWEEN (SELECT min(ws) FROM rc) AND (SELECT max(ws) FROM rc)",
    "j15_allowed_visits": f"WITH {EVENTS}, v AS (SELECT *, TIMESTAMP '2024-01-01' + to_days(CAST(user_id % 20 AS INTEGER)) AS a FROM ev WHERE person_id IS NOT NULL) SELECT event_id, camera_id IN ('cam_' || user_id % 16, 'cam_' || (user_id + 4) % 16, 'cam_' || (user_id + 8) % 16, 'cam_' || (user_id + 12) % 16) AS allowed FROM v WHERE ts BETWEEN a AND a + INTERVAL 5 DAYS",
    "f15_persisted_frames": f"WITH st AS (WITH {_held(_BINARY, False)}), {EVENTS} SELECT ev.event_id FROM ev JOIN st ON st.event_id = ev.event_id WHERE k % 9 = 0 OR stable <> '' OR len(actions) > 0",
    "r01_supervised": f"WITH {_SUBJECTS} SELECT event_id, kept, CASE WHEN conf = 0 THEN 0 ELSE forced END AS forced FROM su JOIN (SELECT event_id AS i, conf FROM su1) ON i = event_id",
    "f14_supervised_violations": f"WITH {_SUBJECTS} SELECT event_id, subject FROM su WHERE kept > 0",
}
