"""The queries of ``operators.spatial`` that are newer than the registry's, in DuckDB's SQL."""

from __future__ import annotations

from sitewatch.plans.search_sql import EVENTS

BOXES = f"""{EVENTS}, b0 AS (SELECT event_id // 8 AS frame, event_id AS obj, CASE WHEN event_id % 8 < 4 THEN 'person' ELSE 'item' END AS kind, (k % 50 + 50) / 100.0e0 AS score,
  CAST((event_id * 37 + k * 11) % 500 AS DOUBLE) AS x1, CAST((event_id * 53 + k * 7) % 300 AS DOUBLE) AS y1, k, CAST(60 + k * 3 % 200 AS DOUBLE) AS w, CAST(80 + k * 5 % 180 AS DOUBLE) AS h FROM ev),
bx AS (SELECT *, x1 + w AS x2, y1 + h AS y2 FROM b0)"""
PAIRS = f"""{BOXES}, q0 AS (SELECT p.frame, p.obj AS person, i.obj AS item, i.score, p.k AS pk, i.k AS ik, greatest(0, least(p.x2, i.x2) - greatest(p.x1, i.x1)) * greatest(0, least(p.y2, i.y2) - greatest(p.y1, i.y1)) AS both_, p.w * p.h AS pa, i.w * i.h AS ia,
  (i.x1 + i.x2) / 2 BETWEEN p.x1 - p.w * 0.08e0 AND p.x2 + p.w * 0.08e0 AND (i.y1 + i.y2) / 2 BETWEEN p.y1 - p.h * 0.08e0 AND p.y2 + p.h * 0.08e0 AS padded FROM bx p JOIN bx i ON p.frame = i.frame AND p.kind = 'person' AND i.kind = 'item'),
pr AS (SELECT *, both_ / (pa + ia - both_) AS iou, both_ / ia AS part FROM q0)"""


def _x(i: int) -> str:
    return f"(x1 + ({i * 37} + k * 13) % w)"


def _y(i: int) -> str:
    return f"(y1 + ({i * 53} + k * 7) % h)"


def _ok(i: int) -> str:
    return f"((k * 3 + {i * 17}) % 100 >= 35 AND {_x(i)} > 0 AND {_y(i)} > 0)"


def _mid(f, a: int, b: int) -> str:
    return f"CASE WHEN {_ok(a)} AND {_ok(b)} THEN ({f(a)} + {f(b)}) / 2 WHEN {_ok(a)} THEN {f(a)} WHEN {_ok(b)} THEN {f(b)} END"


def _inside(x: str, y: str) -> str:
    zone, text = [(100, 100), (500, 120), (450, 400), (80, 350)], "false"
    for (ax, ay), (bx, by) in zip(zone, zone[1:] + zone[:1]):
        text = f"({text} <> ((({ay} > {y}) <> ({by} > {y})) AND {x} < {bx - ax}e0 * ({y} - {ay}) / {by - ay} + {ax}))"
    return text


_ANKLES = f"{_ok(15)} AND {_ok(16)}"
ANCHORS = f"{BOXES}, an AS (SELECT frame, obj, CASE WHEN {_ANKLES} THEN ({_x(15)} + {_x(16)}) / 2 ELSE (x1 + x2) / 2 END AS x, CASE WHEN {_ANKLES} THEN ({_y(15)} + {_y(16)}) / 2 ELSE y2 END AS y FROM bx WHERE kind = 'person')"
_REACH = lambda i: f"({_ok(i)} AND sqrt(pow({_x(i)} - {_x(0)}, 2) + pow({_y(i)} - {_y(0)}, 2)) <= 0.18e0 * h)"

ORACLE_SQL = {
    "j04_first_overlaps": f"WITH {PAIRS} SELECT frame, person, min(item) AS item FROM pr WHERE part >= 0.3 GROUP BY ALL",
    "j06_greedy_matches": f"WITH RECURSIVE {PAIRS}, sc AS (SELECT frame, item, person, round(CASE WHEN padded THEN 1.5e0 ELSE 0 END + 2 * part + iou + 0.2e0 * score, 9) AS score FROM pr WHERE padded OR part >= 0.6 OR iou > 0), o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, item, person) AS r FROM sc), f AS (SELECT frame, item, person, score, r, true AS taken, [item] AS its, [person] AS ps FROM o WHERE r = 1 UNION ALL SELECT o.frame, o.item, o.person, o.score, o.r, NOT list_contains(its, o.item) AND NOT list_contains(ps, o.person), CASE WHEN NOT list_contains(its, o.item) AND NOT list_contains(ps, o.person) THEN list_append(its, o.item) ELSE its END, CASE WHEN NOT list_contains(its, o.item) AND NOT list_contains(ps, o.person) THEN list_append(ps, o.person) ELSE ps END FROM f JOIN o ON o.frame = f.frame AND o.r = f.r + 1) SELECT frame, item, person, score FROM f WHERE taken",
    "j07_assignment_costs": f"WITH {PAIRS}, c AS (SELECT frame, person % 8 AS a, item % 8 AS b, 0.4e0 * (1 - iou) + 0.6e0 * abs(pk - ik) / 100 AS cost FROM pr) SELECT c0.frame, round(min(c0.cost + c1.cost + c2.cost + c3.cost), 6) AS cost FROM c c0 JOIN c c1 ON c1.frame = c0.frame AND c0.a = 0 AND c1.a = 1 AND c1.b <> c0.b JOIN c c2 ON c2.frame = c0.frame AND c2.a = 2 AND c2.b NOT IN (c0.b, c1.b) JOIN c c3 ON c3.frame = c0.frame AND c3.a = 3 AND c3.b NOT IN (c0.b, c1.b, c2.b) GROUP BY 1",
    "w09_suppressed": f"WITH RECURSIVE {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY frame, kind ORDER BY score DESC, obj) AS r, w * h AS s FROM bx), f AS (SELECT frame, kind, obj, r, true AS kept, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 's': s}}] AS l FROM o WHERE r = 1 UNION ALL SELECT frame, kind, obj, r, ok, CASE WHEN ok THEN list_append(l, b) ELSE l END FROM (SELECT o.frame, o.kind, o.obj, o.r, l, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 's': s}} AS b, len(list_filter(l, lambda z: greatest(0, least(z.x2, o.x2) - greatest(z.x1, o.x1)) * greatest(0, least(z.y2, o.y2) - greatest(z.y1, o.y1)) >= 0.3e0 * (z.s + o.s - greatest(0, least(z.x2, o.x2) - greatest(z.x1, o.x1)) * greatest(0, least(z.y2, o.y2) - greatest(z.y1, o.y1))))) = 0 AS ok FROM f JOIN o ON o.frame = f.frame AND o.kind = f.kind AND o.r = f.r + 1) t) SELECT frame, kind, obj FROM f WHERE kept",
    "s19_pose_status": f"WITH {BOXES}, m AS (SELECT frame, obj, w, h, {_mid(_x, 5, 6)} AS sx, {_mid(_y, 5, 6)} AS sy, {_mid(_x, 11, 12)} AS hx, {_mid(_y, 11, 12)} AS hy, {_mid(_y, 15, 16)} AS ay FROM bx WHERE kind = 'person') SELECT frame, obj, CASE WHEN w / h >= 1.25 THEN 'fallen' WHEN sx IS NOT NULL AND hx IS NOT NULL AND degrees(atan2(abs(sx - hx), greatest(abs(sy - hy), 1.0))) >= 35 THEN 'bending' WHEN sx IS NOT NULL AND ay IS NOT NULL AND abs(ay - sy) < h * 0.45e0 THEN 'crouching' ELSE 'standing' END AS status FROM m",
    "s20_hand_near_mouth": f"WITH {BOXES} SELECT frame, obj, {_ok(0)} AND ({_REACH(9)} OR {_REACH(10)}) AS near FROM bx WHERE kind = 'person'",
    "s21_midpoints": f"WITH {BOXES}, m AS (SELECT frame, obj, {_mid(_x, 5, 6)} AS x, {_mid(_y, 5, 6)} AS y FROM bx WHERE kind = 'person') SELECT * FROM m WHERE x IS NOT NULL",
    "s18_zone_anchors": f"WITH {ANCHORS} SELECT * FROM an",
    "r02_overcrowded": f"WITH {ANCHORS}, z AS (SELECT frame, obj, count(*) OVER (PARTITION BY frame) AS n FROM an WHERE {_inside('x', 'y')}) SELECT * FROM z WHERE n > 2",
    "r02_zone_counts": f"WITH {BOXES} SELECT frame, count(*) FILTER ({_inside('((x1 + x2) / 2)', 'y2')}) AS inside, count(*) FILTER ({_inside('((x1 + x2) / 2)', 'y2')}) > 2 AS over FROM bx WHERE kind = 'person' GROUP BY 1",
    "f13_sure_detections": f"WITH {BOXES} SELECT frame, obj FROM bx WHERE score >= CASE WHEN kind = 'person' THEN 0.8e0 WHEN k % 3 = 0 THEN 0.55e0 ELSE 0.7e0 END",
    "p08_overlays": f"WITH {BOXES}, q AS (SELECT DISTINCT frame, kind, CAST(floor(x1 / 50) * 50 AS BIGINT) AS a, CAST(floor(y1 / 50) * 50 AS BIGINT) AS b, CAST(floor(x2 / 50) * 50 AS BIGINT) AS c, CAST(floor(y2 / 50) * 50 AS BIGINT) AS d FROM bx) SELECT frame, CAST(count(*) AS INTEGER) AS n, CAST(sum(a * 3 + d) AS BIGINT) AS mixed FROM q WHERE c > a + 100 AND d > b + 100 GROUP BY 1",
    "a34_enclosing_box": f"WITH {BOXES}, g AS (SELECT frame, list(bx) FILTER (kind = 'item') AS i, list(bx) FILTER (kind = 'person') AS p FROM bx GROUP BY 1), c AS (SELECT frame, unnest(coalesce(i, p)) AS b FROM g) SELECT frame, greatest(0.0e0, min(b.x1) - 50) AS x1, greatest(0.0e0, min(b.y1) - 50) AS y1, least(700.0e0, max(b.x2) + 50) AS x2, least(500.0e0, max(b.y2) + 50) AS y2 FROM c GROUP BY 1",
}
