"""Ordered-buffer operators, shifts, patrol windows and cooldowns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewatch.functions.clock import inspection_window, seconds, shift
from sitewatch.sources.views import safety_events, table

START, INTERVAL = 8 * 60 + 30, 5 * 60


def _ordered() -> Window:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def w02_stable_items(spark: SparkSession, d: str) -> DataFrame:
    """Frames in which a missing helmet was seen in all of the last three."""
    seen = F.shiftright(F.col("k"), 0).bitwiseAND(F.lit(1))
    last = _ordered().rowsBetween(-2, 0)
    rows = safety_events(spark, d).withColumn("hits", F.sum(seen).over(last)).withColumn("n", F.count("*").over(last))
    return rows.select("event_id", ((F.col("n") == 3) & (F.col("hits") == 3)).alias("stable"))


def w03_fused_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Exponential mean of the last three confidences: the oldest is the seed, each newer one has the weight 0.7."""
    buffer = F.collect_list(F.col("k") / 100.0).over(_ordered().rowsBetween(-2, 0))
    fused = F.aggregate(F.slice("b", 2, 3), F.element_at("b", 1), lambda acc, x: 0.7 * x + 0.3 * acc)
    return safety_events(spark, d).withColumn("b", buffer).select("event_id", F.round(fused, 9).alias("fused"))


def w05_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds since the key's frame before; a first frame has none."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = F.floor((micros(F.col("ts")) - micros(F.lag("ts").over(_ordered()))) / 1000)
    return safety_events(spark, d).select("event_id", gap.alias("gap_ms")).where("gap_ms is not null")


def w08_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each camera, by one aggregation instead of a sort."""
    newest = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return safety_events(spark, d).groupBy("camera_id").agg(newest.alias("e")).select("camera_id", "e.event_id", "e.event_type")


def s10_shifts(spark: SparkSession, d: str) -> DataFrame:
    date, name = shift(F.col("ts"))
    return safety_events(spark, d).groupBy(date.alias("shift_date"), name.alias("shift")).agg(F.count("*").alias("n"))


def a15_patrol_records(spark: SparkSession, d: str) -> DataFrame:
    """First and last sighting of each camera and inspection window, with the latest person."""
    start, end = inspection_window(F.col("ts"), START, INTERVAL)
    rows = safety_events(spark, d).where("event_type = 'view'").groupBy("camera_id", start.alias("window_start"), end.alias("window_end"))
    return rows.agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max_by("user_id", F.struct("ts", "event_id")).alias("person"))


def j16_missed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows with patrols somewhere in which a camera had none: calendar of windows and cameras, anti join."""
    records = a15_patrol_records(spark, d).select("camera_id", "window_start")
    windows = records.select("window_start").distinct()
    cameras = safety_events(spark, d).select("camera_id").distinct()
    every = windows.agg(F.collect_set("window_start").alias("windows"))  # five a day: one array of them goes beside each camera
    expected = cameras.withColumn("one", F.lit(1)).join(F.broadcast(every.withColumn("one", F.lit(1))), "one").select("camera_id", F.explode("windows").alias("window_start"))
    return expected.join(records, ["camera_id", "window_start"], "left_anti")


def st05_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """Violations that alert: none of the same person and type was alerted within six hours before.

    It depends on the last alert that was let through, so it is a fold over a person's rows. Of one
    second's rows only the first can alert; the others go before the shuffle. The rest is sorted by Spark,
    which can spill, and folded batch by batch, so no person's rows are in memory at once.
    """
    rows = safety_events(spark, d).where("is_violation").select("user_id", "event_type", "event_id", seconds(F.col("ts")).alias("at"))
    firsts = rows.groupBy("user_id", "event_type", "at").agg(F.min("event_id").alias("event_id"))
    firsts = firsts.repartition("user_id", "event_type").sortWithinPartitions("user_id", "event_type", F.col("at").asc_nulls_last(), "event_id")
    return firsts.select("user_id", "event_type", "event_id", "at").mapInArrow(cooldown_fold, "user_id bigint, event_type string, event_id bigint")


def cooldown_fold(batches: Iterator[pa.RecordBatch], wait: int = 21_600) -> Iterator[pa.RecordBatch]:
    """Alerts among sorted batches of (user_id, event_type, event_id, at); only the last alert is carried from one to the next."""
    key = last = None
    for b in batches:
        keep = []
        for user, kind, at in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
            alerts = (user, kind) != key or (at is not None and last is not None and at - last >= wait)
            if alerts:
                key, last = (user, kind), at
            keep.append(alerts)
        yield b.filter(pa.array(keep, pa.bool_())).select([0, 1, 2])


def j15_visits_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Visits present at noon of each day of a month: every visit is dealt to its days, then counted."""
    o = table(spark, d, "orders").where("o_orderdate < date'1998-07-01' and o_orderdate >= date'1998-05-01'")
    last = F.least(F.to_date(F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 20).cast("int"))), F.lit("1998-06-30").cast("date"))
    first = F.greatest(F.to_date("o_orderdate"), F.lit("1998-06-01").cast("date"))
    days = o.select(first.alias("a"), last.alias("b")).where("b >= a").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.groupBy("day").agg(F.count("*").alias("n"))
