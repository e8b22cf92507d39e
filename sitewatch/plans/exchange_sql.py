"""The queries of ``operators.exchange`` and the newer ones of ``operators.similarity`` in DuckDB's SQL."""

from __future__ import annotations

from sitewatch.plans.search_sql import EVENTS

_D = "CAST({}.embedding AS DOUBLE[])"
_COS = "list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1}))".format(_D.format("q"), _D.format("s"))
SCORES = f"sc AS (SELECT q.vec_id AS query, s.vec_id AS subject, s.label, {_COS} AS score FROM embeddings q JOIN embeddings s ON q.vec_id % 100 = 0 AND q.vec_id <> s.vec_id), rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, subject) AS INTEGER) AS rank FROM sc)"

ORACLE_SQL = {
    "j09_registry": f"WITH {SCORES} SELECT query, rank, subject, CASE subject % 3 WHEN 0 THEN 'employee' WHEN 1 THEN 'external_person' ELSE 'external_registration' END AS kind, round(score, 4) AS cosine, score >= 0.2 AS strong FROM rk WHERE rank <= 10",
    "j08_indexed_subjects": f"WITH {SCORES} SELECT query, CAST(rank AS INTEGER) AS rank, subject, round(score, 6) AS cosine FROM rk WHERE rank <= 5",
    "j10_known_samples": f"WITH {SCORES} SELECT query, arg_min(subject, rank) AS subject, arg_min(label, rank) AS person FROM rk WHERE rank <= 5 AND score >= 0.15 AND label <> 3 GROUP BY query",
    "j11_nearest_centroids": "WITH c AS (SELECT label, list(m ORDER BY place) AS embedding FROM (SELECT label, place, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS place FROM embeddings) GROUP BY ALL) GROUP BY label), "
    f"sc AS (SELECT q.vec_id AS query, s.label, {_COS} AS score FROM embeddings q, c s WHERE q.vec_id % 100 = 0) SELECT query, arg_max(label, score) AS person, round(max(score), 4) AS cosine FROM sc GROUP BY query",
    "st13_gallery_samples": f"WITH {EVENTS} SELECT person_id, event_id, r FROM (SELECT *, CAST(row_number() OVER (PARTITION BY person_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS r FROM ev WHERE person_id IS NOT NULL) WHERE r <= 8 AND floor(epoch(ts)) >= epoch(TIMESTAMP '2024-01-30 23:59:59') - 864000",
    "j12_merged_identities": f"WITH {EVENTS}, f AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM ev WHERE k % 3 <> 0 GROUP BY 1), o AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS seen_in, arg_max(person_name, (ts, event_id)) AS found FROM ev WHERE k % 3 = 0 AND person_name IS NOT NULL GROUP BY 1) SELECT f.user_id, event_id, coalesce(found, 'track ' || f.user_id) AS name, seen_in FROM f LEFT JOIN o ON o.user_id = f.user_id",
    "j13_answered_requests": f"WITH {EVENTS}, e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t, k % 2 = 0 AS asks FROM ev), w AS (SELECT *, first_value(CASE WHEN NOT asks THEN event_id END IGNORE NULLS) OVER l AS a, first_value(CASE WHEN NOT asks THEN t END IGNORE NULLS) OVER l AS at_ FROM e WINDOW l AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) SELECT event_id, CASE WHEN at_ - t <= 43200 THEN a END AS answer FROM w WHERE asks",
    "st21_expired_requests": f"WITH {EVENTS}, e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t, k % 2 = 0 AS asks FROM ev), w AS (SELECT *, first_value(CASE WHEN NOT asks THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS at_ FROM e) SELECT camera_id, count(*) AS expired FROM w WHERE asks AND (at_ IS NULL OR at_ - t > 43200) GROUP BY 1",
    "io08_packed_frames": f"WITH {EVENTS} SELECT event_id, CAST(4 + strlen('{{\"camera\": \"' || camera_id || '\"}}') + 2 * (k % 5) AS INTEGER) AS bytes, '{{\"camera\": \"' || camera_id || '\"}}' AS meta, repeat('é', k % 5) AS payload FROM ev",
    "io09_decoded_vectors": "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[64] AS DOUBLE) AS c FROM embeddings",
    "io12_dumped_events": f"WITH {EVENTS} SELECT event_id, camera_id, source, key, path, CASE WHEN k % 6 <> 0 THEN 'seen' || chr(9) || 'at ' || camera_id || chr(10) || chr(92) || 'N' || chr(92) || event_id END AS note FROM ev WHERE is_violation AND key IS NOT NULL",
    "io15_object_keys": f"WITH {EVENTS} SELECT event_id, 'violation/prod/' || strftime(ts, '%Y/%m/%d') || '/' || camera_id || '/' || event_id || '.jpg' AS key FROM ev WHERE is_violation",
    "io16_created_events": f"WITH {EVENTS} SELECT event_id, array_to_string(cameras, ',') AS cameras, array_to_string(types, ',') AS types, CASE WHEN k % 4 = 0 THEN event_id ELSE event_id - 3 END AS start_frame FROM ev WHERE is_violation",
    "io17_closed_events": f"WITH {EVENTS} SELECT event_id, CASE WHEN k % 3 <> 0 THEN event_id + k END AS end_frame, CASE WHEN k % 3 <> 0 THEN k + 1 + CASE WHEN k % 4 = 0 THEN 0 ELSE 3 END END AS duration FROM ev WHERE is_violation",
    "io18_named_later": f"WITH {EVENTS} SELECT event_id, coalesce(person_name, CASE WHEN event_id % 5 = 0 THEN 'Late ' || user_id END) AS name FROM ev",
    "io23_moved_snapshots": f"WITH {EVENTS} SELECT CASE WHEN event_id % 7 = 0 THEN 'missing file' WHEN event_id % 11 = 0 THEN 'upload failed' ELSE 'moved' END AS outcome, count(*) AS n FROM ev WHERE path IS NOT NULL AND key IS NULL GROUP BY 1",
}
