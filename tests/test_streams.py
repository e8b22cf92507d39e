"""Streams with keyed state: late rows, rows out of order, restarts, and state that goes."""

import datetime
import json
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F
from sitewatch.functions.vocabulary import PPE
from sitewatch.operators.lifecycle import lifecycle_step
from sitewatch.streaming.lifecycle import filtered, lifecycle_events
from sitewatch.streaming.replay import read_to_end

DAY = datetime.datetime(2024, 3, 1, tzinfo=datetime.timezone.utc)
FRAME = "user_id bigint, event_id bigint, ts timestamp, p int, a int"


def frame(user, event, hours, p=0, a=0):
    return (user, event, DAY + datetime.timedelta(hours=hours), p, a)


def events_of(frames, cooldown=172_800):
    """The batch form's step over each person's frames in order."""
    by, out = defaultdict(list), []
    for f in sorted(frames, key=lambda f: (f[2], f[1])):
        by[f[0]].append(f)
    for user, rows in by.items():
        step, state = lifecycle_step(cooldown), None
        for i, (_, _, ts, p, a) in enumerate(rows, 1):
            state, more = step(state, {"user_id": user, "frame": i, "at": int(ts.timestamp()), "p": p, "a": a})
            out += more
        out += step(state, None)[1]
    return sorted(out, key=str)


def fed(spark, folder, batches, idle):
    """The events after each batch, and the rows of a state variable."""
    seen = []
    for batch in batches:
        spark.createDataFrame(batch, FRAME).write.mode("append").parquet(f"{folder}/in")
        read_to_end(lifecycle_events(spark.readStream.schema(FRAME).parquet(f"{folder}/in"), late="1 day", idle=idle), str(folder))
        seen.append(sorted((tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()), key=str))
    return seen


def left(spark, folder, variable):
    return spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", variable).load().count()


def test_late_rows_and_state_that_goes(spark, tmp_path):
    """A row behind the watermark changes nothing; a person who left is closed at their last frame and leaves no state."""
    first = [frame(1, 1, 0, p=3), frame(1, 2, 2, p=1), frame(2, 3, 1, p=4), frame(1, 5, 30), frame(2, 6, 30, p=4)]
    random.Random(1).shuffle(first)
    second = [frame(1, 7, 28, p=2), frame(1, 4, 3, p=64), frame(3, 9, 4, a=2)]  # the last two are 26 hours and more behind
    third = [frame(3, 10, 24 * 40)]
    fourth = [frame(3, 11, 24 * 80), frame(None, 12, 24 * 200)]
    seen = fed(spark, tmp_path, [first, second, third, fourth], idle=30 * 86_400)
    assert seen[0] == []  # what opened may still be preceded by other frames
    on_time = [*first, second[0], *third, *fourth[:1]]
    assert seen[-1] == events_of(on_time)
    assert (2, 1, 2, "new", "source end", 4, 0) in seen[-1]
    for variable in ("event", "alerts", "seen"):
        assert left(spark, tmp_path, variable) == 0
    assert left(spark, tmp_path, "waiting") == 1  # the row that moved the watermark


def test_alerts_older_than_the_cooldown_go(spark, tmp_path):
    frames = [frame(1, 1, 0, p=1), frame(1, 2, 1), frame(1, 3, 24 * 3, p=2), frame(1, 4, 24 * 3 + 1), frame(None, 5, 24 * 6)]
    seen = fed(spark, tmp_path, [frames], idle=10 * 86_400)
    assert seen[-1] == events_of(frames[:4])
    assert left(spark, tmp_path, "alerts") == 1  # of kind 2 alone


def test_rows_out_of_order_within_the_watermark(spark, tmp_path):
    rng = random.Random(6)
    frames = [frame(rng.randrange(4), k, rng.randrange(24 * 60) / 2, rng.choice([0, 0, 1, 3, 7, 64]), rng.choice([0, 0, 0, 1, 2])) for k in range(500)]
    arrival = sorted(frames, key=lambda f: (f[2] + datetime.timedelta(hours=rng.random() * 20)))
    batches = [arrival[k : k + 130] for k in range(0, 500, 130)] + [[frame(None, 999, 24 * 300)]]
    assert fed(spark, tmp_path, batches, idle=90 * 86_400)[-1] == events_of(frames)


class Held:
    """The filter said plainly: two buffers of the last five frames, one violation."""

    def __init__(self):
        self.buffers = {"binary": deque(maxlen=5), "confident": deque(maxlen=5)}
        self.active, self.count, self.clear = None, 0, 0

    def update(self, mode, sure):
        need = lambda x: 5 if x in ("hardhat", "protective_clothing") else 3
        strict = lambda x: need(x) == 5
        self.buffers[mode].append(sure)
        frames = list(self.buffers[mode])
        names = [x for x in PPE if any(x in f for f in frames)]
        if len(frames) < min([need(x) for x in names] or [3]):
            return [], 0
        stable = []
        for x in names:
            last = frames[-need(x) :]
            if len(last) < need(x):
                continue
            values = [f.get(x, 0.0) for f in last]
            mean = values[0]
            for v in values[1:]:
                mean = 0.7 * v + (1 - 0.7) * mean
            whole = all(x in f for f in last) if mode == "binary" else min(values) >= 0.4 if strict(x) else mean >= 0.4
            stable += [x] * whole
        if stable:
            self.clear, self.count = 0, self.count + 1 if self.active else 1
            self.active = stable
            return stable, self.count
        self.clear += 1
        kept = [x for x in self.active or [] if mode == "binary" or not strict(x)]
        if kept and self.clear < 3:
            return kept, self.count
        self.active = None
        return [], 0


@pytest.mark.parametrize("modes", [["binary"], ["confident"], ["binary", "confident"], ["binary"] * 4 + ["confident"]])
def test_a_person_may_alternate_between_the_filters(modes):
    rng = random.Random(2)
    for _ in range(60):
        state, held, bits = {}, Held(), 0
        for _ in range(60):
            bits = bits if rng.random() < 0.7 else rng.randrange(128) & rng.randrange(128)
            sure = [rng.choice([0.1, 0.39, 0.4, 0.5, 0.9]) for _ in PPE]
            mode = rng.choice(modes)
            state, stable, duration = filtered(json.loads(json.dumps(state)), mode, bits, sure)
            assert (stable, duration) == held.update(mode, {x: sure[i] for i, x in enumerate(PPE) if bits >> i & 1})


def test_replay_of_an_empty_table(spark, tmp_path):
    from sitewatch.streaming.replay import replayed

    none = spark.createDataFrame([], FRAME)
    assert replayed(none, lifecycle_events, F.lit(0.0), F.col("ts")).count() == 0


def test_many_persons_share_a_group_of_the_state(spark, tmp_path):
    """Persons in a few buckets, one without an id: each has a lifecycle of their own, and the state has a key a bucket."""
    rng = random.Random(9)
    frames = [frame(rng.choice([None, *range(40)]), k, rng.randrange(24 * 20), rng.choice([0, 1, 3]), rng.choice([0, 0, 2])) for k in range(400)]
    last = [frame(99, 999, 24 * 300)]
    for batch in (frames, last):
        spark.createDataFrame(batch, FRAME).write.mode("append").parquet(f"{tmp_path}/in")
        read_to_end(lifecycle_events(spark.readStream.schema(FRAME).parquet(f"{tmp_path}/in"), idle=90 * 86_400, buckets=3), str(tmp_path))
        if batch is frames:
            store = spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", "waiting").load()
            assert store.select("key").distinct().count() <= 3
    assert sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=str) == events_of(frames)
