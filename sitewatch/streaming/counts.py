"""Streaming forms: windowed counts and patrol records with a watermark, and cooldown alerts with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sitewatch.functions.clock import inspection_window
from sitewatch.operators.temporal import INTERVAL, START


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Violations per camera and window; rows later than the watermark are dropped."""
    return (
        events.where("is_violation").withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "camera_id").agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), "camera_id", "n")
    )


def patrol_records(events: DataFrame, late: str = "1 day") -> DataFrame:
    """First and last sighting of each camera and inspection window; a window's row comes once, when the watermark has passed it.

    ``events``: camera_id, event_id, user_id, ts (timestamp). The windows start anew each day at the start clock, so they are keys that
    follow from the time, and the watermark's own window of a day lets a key's state go.
    """
    start, end = inspection_window(F.col("ts"), START, INTERVAL)
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day", "1 day", f"{START} minutes"), "camera_id", start.alias("window_start"), end.alias("window_end"))
    found = rows.agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max_by("user_id", F.struct("ts", "event_id")).alias("person"))
    return found.select("camera_id", "window_start", "window_end", "first_at", "last_at", "person")


def cooldown_alerts(events: DataFrame, seconds: int = 21_600, late: str = "1 day") -> DataFrame:
    """Violations that alert, one per user, type and cooldown; the state is the last alert's time.

    ``events``: user_id, event_type, event_id, ts (timestamp). Rows of one micro-batch are taken
    in the order of their time, so the result equals the batch fold if batches come in time order. Rows older
    than the watermark change nothing, and a key's state goes once its last alert can't hold back any row that may still come.
    Of a micro-batch a key's distinct seconds are held, each with its first event: no other can alert.
    """
    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out, first = [], pd.Series(dtype="int64")
        for part in parts:
            part = part if last is None else part[part["at"] - last >= seconds]
            first = pd.concat([first, part.groupby("at")["event_id"].min()]).groupby(level=0).min()
        for at, event in first.items():  # by time
            if last is None or at - last >= seconds:
                last = int(at)
                out.append(event)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "event_type": [key[1]] * len(out), "event_id": out})

    rows = events.withWatermark("ts", late).withColumn("at", F.unix_timestamp("ts"))
    return rows.groupBy("user_id", "event_type").applyInPandasWithState(
        fold, "user_id bigint, event_type string, event_id bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
