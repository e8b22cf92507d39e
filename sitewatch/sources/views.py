"""Domain views over the driver's tables; scans stay lazy, so filters and columns reach the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.functions.vocabulary import matched_types

#: How the seven equipment bits of an event are spelled in the raw lists.
RAW_MISSING = ["NO-Hardhat", "no_mask", "safety vest", "no protective shoes", "Gloves", "no_goggles", " gas-mask"]
INTERNAL = "inspection_presence:"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def safety_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.withColumn("k", k).withColumn("camera_id", F.concat(F.lit("cam_"), (F.col("user_id") % 16).cast("string")))
    raw = F.array(*[F.when(F.shiftright(F.col("k"), i).bitwiseAND(F.lit(1)) == 1, name) for i, name in enumerate(RAW_MISSING)])
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value", "k", "camera_id",
        F.when(F.col("k") % 10 != 0, F.col("user_id").cast("string")).alias("person_id"),
        F.when(F.col("k") == 98, F.concat(F.lit(INTERNAL), "camera_id")).when(F.col("k") != 99, F.concat(F.lit("camera:"), "camera_id")).alias("source"),
        F.col("event_type").isin("error", "purchase", "signup").alias("is_violation"),
        F.filter(raw, lambda x: x.isNotNull()).alias("missing"),
        F.when(F.col("event_type") == "error", F.array(F.lit("Unauthorized Intrusion")))
        .when(F.col("event_type") == "signup", F.array(F.lit("fall-detected"), F.lit("waving")))
        .otherwise(F.array().cast("array<string>")).alias("actions"),
    )


def shown_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without internal ones; a null source is dropped too."""
    return safety_events(spark, sf_dir).where(~F.col("source").startswith(INTERNAL))


def typed(events: DataFrame) -> DataFrame:
    return events.withColumn("types", matched_types(F.col("missing"), F.col("actions")))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: eight boxes a frame, four persons and four items."""
    e = safety_events(spark, sf_dir)
    x1, y1 = (F.col("event_id") * 37 + F.col("k") * 11) % 500, (F.col("event_id") * 53 + F.col("k") * 7) % 300
    return e.select(
        F.floor(F.col("event_id") / 8).alias("frame"), F.col("event_id").alias("obj"),
        F.when(F.col("event_id") % 8 < 4, "person").otherwise("item").alias("kind"), ((F.col("k") % 50 + 50) / 100).alias("score"), "k",
        F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), (x1 + 60 + F.col("k") * 3 % 200).cast("double").alias("x2"), (y1 + 80 + F.col("k") * 5 % 180).cast("double").alias("y2")).alias("box"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame timings, ordered by ``seq`` within a camera; ``units`` are ten-thousandths of a millisecond as whole numbers."""
    units = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("camera"), (F.col("l_suppkey") % 4).alias("shard"), (units / 10_000).alias("ms"), units.alias("units"),
        F.concat("l_returnflag", "l_linestatus").alias("stage"), F.col("l_quantity").cast("int").alias("batch"), F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line_no"),
        F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus").alias("seq"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of worker logs: timings as JSON, some of them broken, notices, and a line without a time."""
    t, n = telemetry(spark, sf_dir), F.col("order_no") % 11
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",000 INFO [worker] "))
    cam = F.concat(F.lit("cam_"), F.col("camera").cast("string"))
    timing = F.concat(head, F.lit('FRAME_TIMING {"camera_id": "'), cam, F.lit('", "stage": "'), "stage", F.lit('", "units": '), F.col("units").cast("string"), F.lit(', "batch": '), F.col("batch").cast("string"), F.lit("}"))
    line = (
        F.when(n == 7, F.concat(head, F.lit("Dropping invalid frame payload"))).when(n == 8, F.concat(head, F.lit("Skipping inference sample for camera=a"), F.col("camera").cast("string"), F.lit("-f")))
        .when(n == 9, F.concat(head, F.lit('FRAME_TIMING {"camera_id": "'), cam)).when(n == 10, F.lit("Expired pending async identity update")).otherwise(timing))
    return t.select("ts", line.alias("line"), F.struct("order_no", "line_no", "camera", "units", "batch", "stage").alias("place"))


def case_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the event list shows them: with an own name, stored types, evidence and all cameras."""
    e = safety_events(spark, sf_dir)
    k, none = F.col("k"), F.array().cast("array<string>")
    return e.select(
        "*",
        F.when(k % 7 == 0, F.concat(F.lit("Worker "), F.col("user_id").cast("string"))).alias("person_name"),
        F.when(k % 2 == 1, none).when(k % 4 == 0, F.array(F.lit("fall_detected"), F.lit("hardhat"))).alias("stored"),
        F.when(k % 3 == 0, "snaps").alias("bucket"),
        F.when(k % 3 == 0, F.concat(F.lit("violation/"), F.col("event_id").cast("string"), F.lit(".jpg"))).alias("key"),
        F.when(k % 5 == 0, F.concat(F.lit("/data/old/snap_"), F.col("event_id").cast("string"), F.lit(".jpg"))).alias("path"),
        F.when(k % 2 == 0, F.array("camera_id", F.concat(F.lit("cam_"), ((F.col("user_id") + 1) % 16).cast("string")))).otherwise(F.array("camera_id")).alias("cameras"),
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory of persons: id, name, employee flag; some names are what trackers left."""
    key = F.col("c_custkey")
    name = (
        F.when(key % 11 == 3, F.concat(F.lit("track_"), key.cast("string"))).when(key % 13 == 4, "   ").when(key % 17 == 5, key.cast("string"))
        .when(key % 19 == 6, F.concat(F.lit("person_"), key.cast("string"))).when(key % 23 == 7, F.concat(F.lit("Unknown "), key.cast("string"))).otherwise(F.col("c_name")))
    return table(spark, sf_dir, "customer").select(key.cast("string").alias("id"), name.alias("name"), (F.col("c_mktsegment") != "BUILDING").alias("employee"), "c_acctbal", "c_mktsegment", "c_custkey")


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras from the suppliers: id, floor, name, suffix, host, patrol and enabled flags."""
    s = F.col("s_suppkey")
    floor = F.element_at(F.array(*map(F.lit, ["一楼", "二楼", " 三楼", "室外", "地下", "四楼"])), (s % 6 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("cam_"), s.cast("string")).alias("camera_id"), floor.alias("floor"),
        F.concat(F.when(s % 2 == 0, F.trim(floor)).otherwise(""), F.lit(" 通道"), s.cast("string")).alias("name"),
        F.when(s % 5 == 0, F.concat(F.lit(" 门"), s.cast("string"))).otherwise("").alias("suffix"),
        F.when(s % 7 == 0, "").when(s % 7 == 1, "camera.local").otherwise(F.concat(F.lit("10.0."), (s % 4).cast("string"), F.lit("."), (s * 37 % 256).cast("string"))).alias("host"),
        (s % 3 != 0).alias("patrol"), (s % 9 != 0).alias("enabled"), s.alias("number"), "s_acctbal")
