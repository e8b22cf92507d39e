"""Smoothed detections, violation events with their lifecycle, patrol windows and supervision rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewatch.functions.clock import inspection_window, now, seconds
from sitewatch.functions.vocabulary import PPE
from sitewatch.operators.runtime import folded
from sitewatch.operators.temporal import INTERVAL, START, a15_patrol_records
from sitewatch.sources.views import safety_events

#: Frames in a row that an item must be seen in, by item; frames without any after which a violation ends.
MIN_FRAMES, DEFAULT_FRAMES, CLEAR_FRAMES = {"hardhat": 5, "protective_clothing": 5}, 3, 3
#: Items that must reach the threshold in every frame and are not held when they vanish.
STRICT = ("hardhat", "protective_clothing")
ALPHA, THRESHOLD = 0.7, 0.4
#: The bits of a violation: equipment from 0 on, then intrusion and fall.
INTRUSION, FALL = 1, 2


def _frames_of(name: str) -> int:
    return MIN_FRAMES.get(name, DEFAULT_FRAMES)


def _key() -> Window:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of each tracked person in order, with the bits of the equipment that is missing."""
    return safety_events(spark, d).select("event_id", "user_id", "ts", "k", "is_violation", "event_type", F.row_number().over(_key()).alias("frame"))


def _bit(i: int) -> Column:
    return F.shiftright("k", i).bitwiseAND(F.lit(1))


def with_hysteresis(rows: DataFrame, kept: Column) -> DataFrame:
    """Add ``stable`` and ``duration`` to rows with ``seen``, the stable items of each frame on its own.

    A violation lasts until ``CLEAR_FRAMES`` frames without a stable item; meanwhile its last items that
    are in ``kept`` (of ``last``) stay. Its duration counts the frames with stable items. All of it follows from
    the last frame that had one, so windows say it and no state is carried.
    """
    any_seen, upto = F.size("seen") > 0, _key().rowsBetween(Window.unboundedPreceding, 0)
    before = _key().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last", F.last(F.when(any_seen, F.col("seen")), ignorenulls=True).over(upto)).withColumn("last_frame", F.last(F.when(any_seen, F.col("frame")), ignorenulls=True).over(upto))
    rows = rows.withColumn("prior", F.last(F.when(any_seen, F.col("frame")), ignorenulls=True).over(before)).withColumn("prior_seen", F.last(F.when(any_seen, F.col("seen")), ignorenulls=True).over(before))
    held = F.filter("last", lambda x: kept_item(x, kept))
    prior_held = F.filter("prior_seen", lambda x: kept_item(x, kept))
    gap = F.col("frame") - F.col("prior")
    new = any_seen & (F.col("prior").isNull() | (gap > CLEAR_FRAMES) | ((gap > 1) & (F.size(prior_held) == 0)))
    rows = rows.withColumn("run", F.sum(new.cast("int")).over(upto)).withColumn("held", held)
    within = Window.partitionBy("user_id", "run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("count", F.sum(any_seen.cast("int")).over(within))
    holds = F.coalesce((F.col("frame") - F.col("last_frame") < CLEAR_FRAMES) & (F.size("held") > 0), F.lit(False))
    stable = F.when(any_seen, F.col("seen")).when(holds, F.col("held")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("stable", stable).withColumn("duration", F.when(any_seen | holds, F.col("count")).otherwise(0))


def kept_item(x: Column, kept: Column) -> Column:
    return F.array_contains(kept, x)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", F.array_join("stable", ",").alias("stable"), F.col("duration").cast("bigint").alias("duration"))


def st02_temporal_binary(spark: SparkSession, d: str) -> DataFrame:
    """Items that stood in all of their last frames, held for a while after they vanish."""
    seen = F.array_compact(F.array(*[
        F.when(F.sum(_bit(i)).over(_key().rowsBetween(1 - _frames_of(name), 0)) == _frames_of(name), F.lit(name)) for i, name in enumerate(PPE)]))
    return _shown(with_hysteresis(frames(spark, d).withColumn("seen", seen), F.array(*map(F.lit, PPE))))


def _confidence(i: int) -> Column:
    """Hundredths of an item that is seen, 0 of one that isn't."""
    return F.when(_bit(i) == 1, (F.col("k") * 7 + 13 * i) % 100).otherwise(0) / 100


def fused(i: int, frames_back: int) -> Column:
    """The exponential mean over the last frames: the oldest is the seed, what is not there counts 0."""
    value = F.lag(f"c{i}", frames_back - 1).over(_key())
    for back in range(frames_back - 2, -1, -1):
        value = F.lit(ALPHA) * (F.lag(f"c{i}", back).over(_key()) if back else F.col(f"c{i}")) + F.lit(1 - ALPHA) * value
    return value


def st03_temporal_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The same by fused confidences; strict items need each frame's confidence and are not held."""
    rows = frames(spark, d).select("*", *[_confidence(i).alias(f"c{i}") for i in range(len(PPE))])

    def stable(i: int, name: str) -> Column:
        n = _frames_of(name)
        if name in STRICT:
            w = _key().rowsBetween(1 - n, 0)
            return (F.min(f"c{i}").over(w) >= THRESHOLD) & (F.count("*").over(w) == n)
        return fused(i, n) >= THRESHOLD

    seen = F.array_compact(F.array(*[F.when(stable(i, name), F.lit(name)) for i, name in enumerate(PPE)]))
    return _shown(with_hysteresis(rows.withColumn("seen", seen), F.array(*[F.lit(x) for x in PPE if x not in STRICT])))


def w03_fusions(spark: SparkSession, d: str) -> DataFrame:
    """A mask's confidence over the last three frames: exponential mean, mean in hundredths, and maximum."""
    w = _key().rowsBetween(-2, 0)
    rows = frames(spark, d).withColumn("c1", _confidence(1)).withColumn("h", F.round(F.col("c1") * 100).cast("bigint"))
    return rows.select("event_id", fused(1, 3).alias("ema"), (F.sum("h").over(w) / F.count("*").over(w)).alias("mean"), F.max("h").over(w).alias("most"))


def w04_smoothed_actions(spark: SparkSession, d: str) -> DataFrame:
    """Actions that are on: after two frames in a row with it, until two in a row without; the last such pair decides."""
    def on(name: str, hit: Column) -> Column:
        before = F.lag(hit, 1, False).over(_key())
        decided = F.when(hit & before, 1).when(~hit & ~before, 0)
        return F.when(F.last(decided, ignorenulls=True).over(_key().rowsBetween(Window.unboundedPreceding, 0)) == 1, F.lit(name))

    hits = {"away": F.col("event_type") == "view", "busy": F.col("k") % 3 == 0}
    rows = frames(spark, d).select("*", *[h.alias(n) for n, h in hits.items()])
    return rows.select("event_id", F.array_join(F.array_compact(F.array(*[on(n, F.col(n)) for n in hits])), ",").alias("actions"))


def masks(spark: SparkSession, d: str) -> DataFrame:
    """Frames with their violation as two masks: equipment ``p`` and actions ``a``; other frames have none."""
    a = F.when(F.col("event_type") == "error", INTRUSION).when(F.col("event_type") == "signup", FALL).otherwise(0)
    rows = frames(spark, d)
    return rows.select("user_id", "frame", "event_id", seconds(F.col("ts")).alias("at"), F.when(F.col("is_violation"), F.col("k").bitwiseAND(F.lit(127))).otherwise(0).alias("p"), F.when(F.col("is_violation"), a).otherwise(0).alias("a"))


def similar(p: int, q: int) -> bool:
    """Two sets: half of the smaller one is common; both empty is similar, one empty is not."""
    if not p or not q:
        return p == q
    return 2 * (p & q).bit_count() >= min(p.bit_count(), q.bit_count())


EVENT = "user_id bigint, first_frame bigint, end_frame bigint, opened string, closed string, p int, a int"


def st04_event_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Violation events of each person: opened by a frame with a violation, closed by one without or by another kind.

    While it goes on, equipment adds up and actions are replaced. What is open at the person's last frame is closed there.
    """
    def step(state, row):
        if row is None:
            return None, [(state["user"], state["first"], state["last"], state["why"], "source end", state["p"], state["a"])] if state and "first" in state else []
        user, f, p, a = row["user_id"], row["frame"], row["p"], row["a"]
        closed = lambda why: [(user, state["first"], f - 1, state["why"], why, state["p"], state["a"])]
        opened = lambda why: {"user": user, "first": f, "last": f, "why": why, "p": p, "a": a}
        if not state or "first" not in state:
            return (opened("new") if p or a else {"user": user}), []
        if not (p or a):
            return {"user": user}, closed("ended")
        if p and state["p"] and not similar(p, state["p"]):
            return opened("changed"), closed("changed")
        return {**state, "p": state["p"] | p, "a": a, "last": f}, []

    return folded(masks(spark, d), ["user_id"], ["frame"], step, EVENT)


def lifecycle_step(cooldown: int):
    """The persisted lifecycle of one person: an event opens only with what may alert, and rotates when it may again."""
    kinds = [1 << i for i in range(9)]  # seven of equipment, then the actions

    def step(state, row):
        state = dict(state or {"act": None, "alerts": {}, "user": None, "frame": 0})
        act, alerts = state["act"], dict(state["alerts"])
        if row is None:
            return None, [(state["user"], act["first"], state["frame"], act["why"], "source end", act["all"] & 127, act["all"] >> 7)] if act else []
        user, f, at, p, a = row["user_id"], row["frame"], row["at"], row["p"], row["a"]
        out, why, v = [], None, p | a << 7
        prior = act["all"] if act else 0
        end = lambda reason: out.append((user, act["first"], f - 1, act["why"], reason, act["all"] & 127, act["all"] >> 7))
        alertable = sum(x for x in kinds if v & x and (x not in alerts or at - alerts[x] >= cooldown))
        if act is None:
            why = "new" if v else None
        elif not v:
            end("ended")
            act = None
        elif p and prior & 127 and not similar(p, prior & 127):
            end("changed")
            act, why = None, "changed"
        else:
            act = {**act, "all": (prior & 127 | p) | a << 7}
            if alertable and not v & ~prior:
                end("cooldown")
                act, why = None, "cooldown"
        if why and alertable:
            act = {"first": f, "why": why, "all": alertable}
            alerts.update({x: at for x in kinds if alertable & x})
        return {"act": act, "alerts": alerts, "user": user, "frame": f}, out

    return step


def st06_lifecycle_with_rotation(spark: SparkSession, d: str, cooldown: int = 172_800) -> DataFrame:
    """The same with a cooldown of two days for each kind: only kinds that may alert open an event, and an event
    that goes on without new kinds is closed and opened anew when one of its kinds may alert again."""
    return folded(masks(spark, d), ["user_id"], ["frame"], lifecycle_step(cooldown), EVENT)


def s12_last_windows(spark: SparkSession, d: str) -> DataFrame:
    """The last inspection window that was over at each event; before the first one of a day's cycle it is the last of the day before."""
    start, _ = inspection_window(F.col("ts"), START, INTERVAL)
    origin = inspection_window(F.col("ts"), START, 24 * 60)[0]
    last = F.when(start > origin, start - INTERVAL * 60).otherwise(origin - 86_400 + F.floor(F.lit(86_400 - 1) / (INTERVAL * 60)) * INTERVAL * 60)
    return safety_events(spark, d).select("event_id", last.alias("window_start"))


def st17_settled_windows(spark: SparkSession, d: str) -> DataFrame:
    """Inspection windows that are over: how many cameras were covered, and whether none was or some are missing; each window settles once."""
    records = a15_patrol_records(spark, d).where(F.col("window_end") <= seconds(now()))
    covered = records.groupBy("window_start", "window_end").agg(F.countDistinct("camera_id").alias("covered"))
    span = covered.agg(F.min("window_start").alias("a"), F.max("window_start").alias("b"))
    # the calendar of windows: starts of each day's cycle at the start clock, from the first to the last record
    day = F.explode(F.sequence(F.floor((F.col("a") - START * 60) / 86_400), F.floor((F.col("b") - START * 60) / 86_400)))
    days = span.select("a", "b", day.alias("day"))
    starts = days.select("a", "b", F.explode(F.sequence(F.col("day") * 86_400 + START * 60, F.col("day") * 86_400 + START * 60 + 86_399, F.lit(INTERVAL * 60).cast("bigint"))).alias("window_start")).where("window_start between a and b")
    cameras = safety_events(spark, d).agg(F.countDistinct("camera_id").alias("cameras"))  # one row
    rows = starts.join(covered.select("window_start", "covered"), "window_start", "left").withColumn("one", F.lit(1)).join(F.broadcast(cameras.withColumn("one", F.lit(1))), "one")
    n = F.coalesce("covered", F.lit(0))
    return rows.select("window_start", n.alias("covered"), F.when(n == 0, "none covered").when(n < F.col("cameras"), "some missing").otherwise("covered").alias("state"))


def j15_allowed_visits(spark: SparkSession, d: str) -> DataFrame:
    """Events of persons with an appointment at that time for that camera: subject and interval by a bucket of days."""
    e = safety_events(spark, d).where("person_id is not null").select("event_id", "user_id", "camera_id", "ts", F.to_date("ts").alias("day"))
    start = F.to_timestamp_ntz(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("user_id") % 20).cast("int")), "yyyy-MM-dd"), F.lit("yyyy-MM-dd"))
    visits = safety_events(spark, d).select("user_id").distinct().select("user_id", start.alias("a"), (start + F.expr("INTERVAL 5 DAYS")).alias("b"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("cam_"), ((F.col("user_id") + 4 * i) % 16).cast("string"))).alias("allowed"))
    visits = visits.withColumn("day", F.explode(F.sequence(F.to_date("a"), F.to_date("b"))))
    rows = e.join(visits, ["user_id", "day"]).where("ts between a and b")
    return rows.select("event_id", F.array_contains("allowed", F.col("camera_id")).alias("allowed"))


def f15_persisted_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames worth keeping: a known face, stable equipment missing, or an action other than the workshop's over-capacity."""
    stable = st02_temporal_binary(spark, d).select("event_id", (F.col("stable") != "").alias("stable"))
    rows = safety_events(spark, d).select("event_id", (F.col("k") % 9 == 0).alias("face"), (F.size("actions") > 0).alias("action"))
    return rows.join(stable, "event_id").where("face or stable or action").select("event_id")


def supervised(rows: DataFrame) -> DataFrame:
    """Apply supervision rules to rows with subject, scopes and masks; sets are masks of the types in vocabulary order.

    The configured scope is the camera's and the backend's. Without one, nothing is left. An unknown
    subject has the scope for others, and an intrusion in both scopes is forced; a registration
    outside its time may only intrude, one at another camera is forced as an intruder. What is allowed is what both
    scopes share, what is forced, and what holds for all.
    """
    intruder, configured = F.lit(1 << 9), F.col("camera_scope").bitwiseOR(F.col("backend_scope"))
    has = lambda c: c.bitwiseAND(intruder) > 0
    kind, scope = F.col("subject"), F.when(F.col("subject") == "unknown", F.col("other_scope")).when((F.col("subject") == "external_registration") & ~F.col("active"), intruder).otherwise(F.col("own_scope"))
    forced = F.when((kind == "unknown") & has(F.col("other_scope")) & has(configured), intruder).when(
        (kind == "external_registration") & ~F.col("active") & has(configured), intruder).when(
        (kind == "external_registration") & F.col("active") & has(F.col("own_scope")) & ~F.col("at_allowed") & has(configured), intruder).otherwise(F.lit(0))
    everywhere = configured.bitwiseAND(F.lit(1 << 12))
    allowed = scope.bitwiseAND(configured).bitwiseOR(forced).bitwiseOR(everywhere)
    allowed = F.when(configured == 0, F.lit(0)).otherwise(allowed)
    kept = F.col("types").bitwiseAND(allowed).bitwiseOR(F.when(configured == 0, F.lit(0)).otherwise(forced))
    return rows.select("*", kept.alias("kept"), F.when(configured == 0, F.lit(0)).otherwise(forced).alias("forced"))


def subjects(spark: SparkSession, d: str) -> DataFrame:
    """Persons in frames with their scopes, as masks that follow from the ids."""
    u, k = F.col("user_id"), F.col("k")
    action = F.when(F.col("event_type") == "error", 1 << 9).when(F.col("event_type") == "signup", 1 << 14).otherwise(0)
    kinds = F.array(*map(F.lit, ["unknown", "employee", "external_person", "external_registration"]))
    camera = (u % 16).cast("int")
    mask = lambda c, a, b: ((c * a + b) % 32_768).cast("int")
    return safety_events(spark, d).select(
        "event_id", F.element_at(kinds, (u % 4 + 1).cast("int")).alias("subject"), k.bitwiseAND(F.lit(127)).bitwiseOR(action).alias("types"),
        F.when(camera % 5 == 0, 0).otherwise(mask(camera, 7919, 513)).alias("camera_scope"), F.when(camera % 5 == 0, 0).otherwise(mask(camera, 104_729, 4096)).alias("backend_scope"),
        mask(u, 3571, 600).alias("own_scope"), F.lit((1 << 9) + 5).alias("other_scope"), (u % 7 != 0).alias("active"), (u % 3 != 0).alias("at_allowed"))


def r01_supervised(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each frame's types under the supervision rules, and what the rules add."""
    return supervised(subjects(spark, d)).select("event_id", "kept", "forced")


def f14_supervised_violations(spark: SparkSession, d: str) -> DataFrame:
    """Frames that are violations under the rules."""
    return supervised(subjects(spark, d)).where("kept > 0").select("event_id", "subject")
