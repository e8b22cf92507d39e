"""Tracks of boxes over frames, their identities within a frame and over time, and when a face is looked at again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.functions.clock import seconds
from sitewatch.operators.runtime import folded
from sitewatch.operators.spatial import assigned
from sitewatch.sources.views import boxes, safety_events

#: Frames after which a known face is looked at again, and a failed one.
REFRESH, RETRY = 8, 10
#: Hits that confirm a track, misses after which it goes, largest cost of a match.
CONFIRM, MOST_MISSES, GATE = 3, 90, 0.7


def st11_stable_tracks(spark: SparkSession, d: str) -> DataFrame:
    """A number for each track of a camera: the person's, if known and seen before, else the raw track's, else the next one."""
    person = F.when(F.col("k") % 3 == 0, F.col("user_id"))
    rows = safety_events(spark, d).select("camera_id", seconds(F.col("ts")).alias("at"), "event_id", person.alias("person"), (F.col("user_id") * 3 % 5 + F.col("k") % 2 * 5).alias("raw"))

    def step(state, row):
        if row is None:
            return None, []
        raws, persons, number = state or ({}, {}, 1)
        raw, p = row["raw"], row["person"]
        mine = raws.get(raw) if p is None else persons.get(p, raws.get(raw))
        if mine is None:
            mine, number = number, number + 1
        return ({**raws, raw: mine}, persons if p is None else {**persons, p: mine}, number), [(row["camera_id"], row["event_id"], mine)]

    return folded(rows, ["camera_id"], ["at", "event_id"], step, "camera_id string, event_id bigint, track bigint")


def st14_face_attempts(spark: SparkSession, d: str, ttl: int = 172_800) -> DataFrame:
    """Frames in which a track's face is looked at: a new track's, one's that was not seen for long, and again after some frames."""
    rows = safety_events(spark, d).select("user_id", seconds(F.col("ts")).alias("at"), "event_id", (F.col("k") % 4 == 0).alias("matches"))

    def step(state, row):
        if row is None:
            return None, []
        seen, since, matched = state or (None, 0, False)
        looks = seen is None or row["at"] - seen > ttl or since + 1 >= (REFRESH if matched else RETRY)
        return (row["at"], 0 if looks else since + 1, row["matches"] if looks else matched), [(row["user_id"], row["event_id"])] if looks else []

    return folded(rows, ["user_id"], ["at", "event_id"], step, "user_id bigint, event_id bigint")


def st12_frame_identities(spark: SparkSession, d: str) -> DataFrame:
    """Who the persons of a frame are, each identity once: confirmed faces first, the surest before others; then the best
    gallery candidate that is free, the track's person if free, else an unknown one of its own number."""
    k, name = F.col("k"), lambda n: F.concat(F.lit("p"), n.cast("string"))
    person = F.struct(
        (k % 3 != 0).cast("int").alias("late"), (-F.col("score")).alias("s"), "obj", F.when(k % 3 == 0, name(k % 5)).alias("face"),
        F.array(name(k % 4), name((k + 1) % 5)).alias("found"), F.when(k % 7 < 4, name(F.col("obj") % 6)).alias("track"))
    rows = boxes(spark, d).where("kind = 'person'").groupBy("frame").agg(F.array_sort(F.collect_list(person)).alias("persons"))

    def resolved(known, x):
        taken = F.transform(known, lambda t: t["identity"])
        free = lambda c: F.when(c.isNotNull() & ~F.array_contains(taken, c), c)
        found = F.get(F.filter(x["found"], lambda c: ~F.array_contains(taken, c)), F.lit(0))
        identity = F.coalesce(free(x["face"]), found, free(x["track"]), F.concat(F.lit("unknown:"), x["obj"].cast("string")))
        return F.concat(known, F.array(F.struct(x["obj"].alias("obj"), identity.alias("identity"))))

    none = F.array().cast("array<struct<obj:bigint,identity:string>>")
    return rows.select("frame", F.explode(F.aggregate("persons", none, resolved)).alias("r")).select("frame", "r.obj", "r.identity")


class Track:
    """A box that moves at a constant speed, by a Kalman filter over its centre, shape, height and their speeds."""

    def __init__(self, number: int, box: np.ndarray):
        self.number, self.hits, self.missed = number, 1, 0
        self.mean = np.concatenate((box, np.zeros(4)))
        self.cov = np.diag([10.0, 10.0, 0.1, 10.0, 100.0, 100.0, 0.01, 100.0])

    def predict(self) -> None:
        move = np.eye(8)
        move[:4, 4:] = np.eye(4)
        self.mean = move @ self.mean
        self.cov = move @ self.cov @ move.T + np.diag([1.0, 1.0, 1e-4, 1.0, 0.01, 0.01, 1e-6, 0.01])
        self.missed += 1

    def update(self, box: np.ndarray) -> None:
        gain = self.cov[:, :4] @ np.linalg.inv(self.cov[:4, :4] + np.diag([1.0, 1.0, 0.01, 1.0]))
        self.mean = self.mean + gain @ (box - self.mean[:4])
        self.cov = self.cov - gain @ self.cov[:4]
        self.hits, self.missed = self.hits + 1, 0


def _shape(b: tuple[float, float, float, float]) -> np.ndarray:
    """Centre, sides' ratio and height of a box."""
    w, h = b[2] - b[0], b[3] - b[1]
    return np.array([b[0] + w / 2, b[1] + h / 2, w / max(h, 1e-9), h])


def _overlap(m: np.ndarray, b: tuple[float, float, float, float]) -> float:
    w, h = m[2] * m[3], m[3]
    a = (m[0] - w / 2, m[1] - h / 2, m[0] + w / 2, m[1] + h / 2)
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return both / max(1e-9, w * h + (b[2] - b[0]) * (b[3] - b[1]) - both)


def tracked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, obj, track, confirmed) of boxes (keys, frame, obj, x1, y1, x2, y2): frame by frame, tracks predict where they
    are, and the assignment of least total cost (one minus overlap) up to ``GATE`` continues them; confirmed tracks choose first,
    other boxes begin new ones. A key's boxes come sorted, a frame at a time, and only its tracks are held."""
    rows = rows.withColumn("box", F.struct("obj", "x1", "y1", "x2", "y2")).groupBy(*keys, "frame").agg(F.array_sort(F.collect_list("box")).alias("boxes"))

    def step(state, row):
        if row is None:
            return None, []
        tracks, number = state or ([], 1)
        found = {b["obj"]: (b["x1"], b["y1"], b["x2"], b["y2"]) for b in row["boxes"]}
        left, out = list(found), []
        for t in tracks:
            t.predict()
        for group in ([t for t in tracks if t.hits >= CONFIRM], [t for t in tracks if t.hits < CONFIRM]):
            if group and left:
                cost = np.array([[1 - _overlap(t.mean[:4], found[o]) for o in left] for t in group])
                turned = len(group) > len(left)
                pairs = [(j, i) if turned else (i, j) for i, j in enumerate(assigned(cost.T if turned else cost))]
                for i, j in [(i, j) for i, j in pairs if cost[i, j] <= GATE]:
                    group[i].update(_shape(found[left[j]]))
                    out.append((left[j], group[i]))
                gone = {o for o, _ in out}
                left = [o for o in left if o not in gone]
        for o in left:
            tracks.append(Track(number, _shape(found[o])))
            out.append((o, tracks[-1]))
            number += 1
        tracks = [t for t in tracks if t.missed <= MOST_MISSES and (t.hits >= CONFIRM or not t.missed)]
        return (tracks, number), [(*(row[k] for k in keys), row["frame"], o, t.number, t.hits >= CONFIRM) for o, t in sorted(out, key=lambda x: x[0])]

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return folded(rows, keys, ["frame"], step, f"{kinds}, frame bigint, obj bigint, track bigint, confirmed boolean")


def st10_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of the persons that each of 25 cameras sees."""
    rows = boxes(spark, d).where("kind = 'person'").select((F.col("frame") % 25).alias("camera"), F.floor(F.col("frame") / 25).alias("frame"), "obj", "box.*")
    return tracked(rows, ["camera"])
