"""Temporal filters and the lifecycle of violation events on a stream, with keyed state and event-time timers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sitewatch.functions.vocabulary import PPE
from sitewatch.operators.lifecycle import ALPHA, CLEAR_FRAMES, DEFAULT_FRAMES, EVENT, MIN_FRAMES, STRICT, THRESHOLD, lifecycle_step, masks
from sitewatch.sources.views import safety_events
from sitewatch.streaming.replay import replayed

BUFFER = max(MIN_FRAMES.values())


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


class InOrder(StatefulProcessor):
    """Rows of each person in the order of (at, event_id), however they arrive within the watermark.

    A group is a bucket of persons, so that a call to the state serves many of them. A row waits in list state, a batch of rows an
    element, until the watermark has passed its time, as an earlier one may still come; a timer stands at the first of them. A person without rows
    for ``idle`` microseconds is over: ``ended`` has the last word, then their state goes.
    """

    def __init__(self, fields: str, idle: int):
        self.schema = pa.schema([("person", pa.string()), *((n, ARROW[t]) for n, t in (f.split() for f in fields.split(", ")))])
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.seen = handle.getListState("seen", "person string, at bigint")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Declare the state of the operator itself."""

    def load(self) -> None:
        """Read the states of the bucket's persons."""
        raise NotImplementedError

    def save(self) -> None:
        """Write them back."""
        raise NotImplementedError

    def follow(self, person: str | None, rows: list[tuple]) -> list[tuple]:
        """What the next rows of a person, in order, give."""
        raise NotImplementedError

    def ended(self, person: str | None) -> list[tuple]:
        """What the end of a person gives; their state goes."""
        raise NotImplementedError

    def _wake(self, micros: int | None) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if micros is not None:
            self.handle.registerTimer(-(-micros // 1000))

    def _wait(self, rows: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_table(rows)
        return sink.getvalue().to_pybytes()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pa.concat_tables([pa.Table.from_pandas(part, self.schema, preserve_index=False) for part in rows])
        first = pc.min(new["at"]).as_py()
        self.waiting.appendValue((self._wait(new),))
        timers = list(self.handle.listTimers())
        if not timers or first < 1000 * min(timers):
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [pa.ipc.open_stream(r[0]).read_all() for r in self.waiting.get()]
        rows = pa.concat_tables(held) if held else self.schema.empty_table()
        past = pc.less_equal(rows["at"], passed)
        due, rest = rows.filter(past).sort_by([(n, "ascending") for n in self.schema.names]), rows.filter(pc.invert(past))
        self.load()
        seen, out = dict(tuple(r) for r in self.seen.get()), []
        for person, some in groupby(zip(*(c.to_pylist() for c in due.columns)), itemgetter(0)):
            some = [r[1:] for r in some]
            out += self.follow(person, some)
            seen[person] = some[-1][0]
        still = set(rest["person"].unique().to_pylist())
        for person in [x for x, last in seen.items() if x not in still and last + self.idle <= passed]:
            out += self.ended(person)
            del seen[person]
        self.waiting.put([(self._wait(rest),)]) if len(rest) else self.waiting.clear()
        self.seen.put(list(seen.items())) if seen else self.seen.clear()
        self.save()
        self._wake(min([*([pc.min(rest["at"]).as_py()] if len(rest) else []), *(last + self.idle for x, last in seen.items() if x not in still)], default=None))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class Lifecycle(InOrder):
    """The persisted lifecycle of a person's events: one open event, and the time of the last alert of each kind that still holds back."""

    columns = [f.split()[0] for f in EVENT.split(", ")]

    def __init__(self, cooldown: int, idle: int):
        super().__init__("at bigint, event_id bigint, p int, a int", idle)
        self.cooldown = cooldown

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.step = lifecycle_step(self.cooldown)
        self.event = handle.getListState("event", "person string, frame bigint, first bigint, why string, kinds int")
        self.alerts = handle.getListState("alerts", "person string, kind int, at bigint")

    def load(self) -> None:
        self.states = {p: self._state(p, frame, {"first": first, "why": why, "all": kinds} if kinds else None) for p, frame, first, why, kinds in self.event.get()}
        for person, kind, at in self.alerts.get():
            self.states[person]["alerts"][kind] = at

    def save(self) -> None:
        none = {"first": 0, "why": "", "all": 0}
        events = [(p, s["frame"], a["first"], a["why"], a["all"]) for p, s in self.states.items() for a in [s["act"] or none]]
        alerts = [(p, kind, at) for p, s in self.states.items() for kind, at in s["alerts"].items()]
        self.event.put(events) if events else self.event.clear()
        self.alerts.put(alerts) if alerts else self.alerts.clear()

    def _state(self, person: str | None, frame: int = 0, act: dict | None = None) -> dict:
        return {"user": None if person is None else int(person), "frame": frame, "act": act, "alerts": {}}

    def follow(self, person: str | None, rows: list[tuple]) -> list[tuple]:
        state, out = self.states.get(person) or self._state(person), []
        for at, _, p, a in rows:
            state, more = self.step(state, {"user_id": state["user"], "frame": state["frame"] + 1, "at": at // 1_000_000, "p": p, "a": a})
            out += more
        now = rows[-1][0] // 1_000_000  # an older alert holds nothing back any more
        self.states[person] = {**state, "alerts": {kind: at for kind, at in state["alerts"].items() if now - at < self.cooldown}}
        return out

    def ended(self, person: str | None) -> list[tuple]:
        return self.step(self.states.pop(person), None)[1]


def filtered(state: dict, mode: str, bits: int, sure: list[float]) -> tuple[dict, list[str], int]:
    """One frame through the temporal filter: new state, the stable items and for how many frames they have been.

    Two buffers, of items missing and of confidences, share one violation, so a person's frames may come in either mode. ``stable``
    items are missing in all of their last frames, or are so by fused confidence. Without any the violation lasts a few frames more.
    """
    state = dict(state)
    frame = bits if mode == "binary" else [x if bits >> i & 1 else 0.0 for i, x in enumerate(sure)]
    history = [*state.get(mode, []), frame][-BUFFER:]
    state[mode] = history
    need = [MIN_FRAMES.get(name, DEFAULT_FRAMES) for name in PPE]
    has = (lambda f, i: f >> i & 1) if mode == "binary" else (lambda f, i: f[i] > 0)
    candidates = [i for i in range(len(PPE)) if any(has(f, i) for f in history)]
    if len(history) < min((need[i] for i in candidates), default=DEFAULT_FRAMES):
        return state, [], 0

    def stands(i: int) -> bool:
        last = history[-need[i]:]
        if len(last) < need[i]:
            return False
        if mode == "binary":
            return all(has(f, i) for f in last)
        if PPE[i] in STRICT:
            return all(f[i] >= THRESHOLD for f in last)
        fused = last[0][i]
        for f in last[1:]:
            fused = ALPHA * f[i] + (1 - ALPHA) * fused
        return fused >= THRESHOLD

    stable, active = [PPE[i] for i in candidates if stands(i)], state.get("active")
    if stable:
        state |= {"active": stable, "clear": 0, "duration": state.get("duration", 0) + 1 if active else 1}
        return state, stable, state["duration"]
    state["clear"] = state.get("clear", 0) + 1
    held = [x for x in active or [] if mode == "binary" or x not in STRICT]
    if held and state["clear"] < CLEAR_FRAMES:
        return state, held, state["duration"]
    state["active"] = None
    return state, [], 0


class TemporalFilter(InOrder):
    """The temporal filter of a person's frames: the last frames' buffers, the violation that stands, and how long it has been clear."""

    columns = ["mode", "event_id", "stable", "duration"]

    def __init__(self, idle: int):
        super().__init__("at bigint, event_id bigint, mode string, bits int, sure string", idle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.persons = handle.getListState("person", "person string, state string")

    def load(self) -> None:
        self.states = {person: json.loads(state) for person, state in self.persons.get()}

    def save(self) -> None:
        states = [(person, json.dumps(state)) for person, state in self.states.items()]
        self.persons.put(states) if states else self.persons.clear()

    def follow(self, person: str | None, rows: list[tuple]) -> list[tuple]:
        state, out = self.states.get(person, {}), []
        for _, event, mode, bits, sure in rows:
            state, stable, duration = filtered(state, mode, bits, json.loads(sure) if mode != "binary" else [])
            out.append((mode, event, ",".join(stable), duration))
        self.states[person] = state
        return out

    def ended(self, person: str | None) -> list[tuple]:
        del self.states[person]
        return []


def bucketed(rows: DataFrame, buckets: int) -> GroupedData:
    """Rows by their person's bucket; one holds the persons whose state a task reads and writes at once."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("person"), F.lit(buckets))).groupBy("bucket")


def lifecycle_events(frames: DataFrame, cooldown: int = 172_800, late: str = "1 day", idle: int = 60 * 86_400, buckets: int = 16) -> DataFrame:
    """Violation events of a stream of frames (user_id, event_id, ts, p, a), each when it is over.

    Opened, changed, ended and rotated as in the batch form; a person without frames for ``idle`` seconds has left, and what is open then
    ends at their last frame. Frames later than the watermark, or without a time, are dropped; a null mask is 0. State of a person: frames that may still be preceded, one
    event, and alerts younger than the cooldown.
    """
    masks_ = [F.coalesce(c, F.lit(0)).alias(c) for c in ("p", "a")]
    rows = frames.where("ts is not null").withWatermark("ts", late).select(F.col("user_id").cast("string").alias("person"), F.unix_micros("ts").alias("at"), F.coalesce("event_id", F.lit(-1)).alias("event_id"), *masks_, "ts")
    return bucketed(rows, buckets).transformWithStateInPandas(Lifecycle(cooldown, idle * 1_000_000), EVENT, "append", "EventTime")


def temporal_items(frames: DataFrame, late: str = "1 day", idle: int = 60 * 86_400, buckets: int = 16) -> DataFrame:
    """Stable items of each frame of a stream (person, event_id, ts, mode, bits, sure), in mode ``binary`` or ``confident``.

    ``sure``: a JSON list with a confidence for each item. A person without frames for ``idle`` seconds starts anew.
    """
    rows = frames.where("ts is not null").withWatermark("ts", late).select("person", F.unix_micros("ts").alias("at"), "event_id", "mode", "bits", "sure", "ts")
    return bucketed(rows, buckets).transformWithStateInPandas(TemporalFilter(idle * 1_000_000), "mode string, event_id bigint, stable string, duration bigint", "append", "EventTime")


def _delay() -> Column:
    """Rows of the replays arrive up to twenty hours late, by a hash; the watermark waits for a day."""
    return F.pmod(F.xxhash64("event_id"), F.lit(20 * 3600)).cast("double")


def _buckets(spark: SparkSession, d: str) -> int:
    """Buckets of some 20,000 events; the same number in all runs over a table."""
    return max(16, safety_events(spark, d).count() // 20_000)


def _end() -> Column:
    return F.col("ts") + F.expr("interval 63 days")


def stream_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """The events of all persons from a stream of their frames, which come out of order: the rows of the batch form."""
    e = masks(spark, d).join(safety_events(spark, d).select("event_id", "ts"), "event_id")
    rows = e.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "p", "a")
    return replayed(rows, lambda frames: lifecycle_events(frames, buckets=_buckets(spark, d)), _delay(), _end())


def stream_temporal(spark: SparkSession, d: str) -> DataFrame:
    """Both temporal filters from one stream: a person's frames go through a filter of each mode."""
    k = F.col("k")
    sure = F.to_json(F.array(*[((k * 7 + 13 * i) % 100) / 100 for i in range(len(PPE))]))
    rows = safety_events(spark, d).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), k.bitwiseAND(F.lit(127)).cast("int").alias("bits"), sure.alias("sure"), F.explode(F.array(F.lit("binary"), F.lit("confident"))).alias("mode"))
    rows = rows.select(F.concat_ws("/", F.col("user_id").cast("string"), "mode").alias("person"), "event_id", "ts", "mode", "bits", "sure")
    return replayed(rows, lambda frames: temporal_items(frames, buckets=_buckets(spark, d)), _delay(), _end())
