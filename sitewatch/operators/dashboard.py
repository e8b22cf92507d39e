"""Counts, trends, breakdowns, rankings, searches and pages over safety events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewatch.functions.clock import now
from sitewatch.functions.vocabulary import TYPES, type_order
from sitewatch.sources.views import safety_events, shown_events, table, typed


def _days_ago(n: int):
    return F.date_trunc("day", now()) - F.expr(f"INTERVAL {n} DAYS")


def a01_summary(spark: SparkSession, d: str) -> DataFrame:
    """Totals, today's totals, distinct persons and compliance in one pass."""
    today = F.col("ts") >= _days_ago(0)
    n, v = F.count("*"), F.count_if("is_violation")
    return shown_events(spark, d).agg(
        n.alias("total"), F.count_if(today).alias("today"), v.alias("violations"), F.count_if(today & F.col("is_violation")).alias("today_violations"),
        F.countDistinct("person_id").alias("persons"),
        F.when(n == 0, 100.0).otherwise(F.round((n - v) / n * 100, 1)).alias("compliance_rate"))


def a04_daily_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = shown_events(spark, d).where(F.col("is_violation") & (F.col("ts") >= now() - F.expr("INTERVAL 7 DAYS")))
    return rows.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def _violation_types(spark: SparkSession, d: str, since: int) -> DataFrame:
    rows = typed(shown_events(spark, d).where(F.col("is_violation") & (F.col("ts") >= _days_ago(since))))
    return rows.select("event_id", "ts", "camera_id", "person_id", F.explode("types").alias("type"))


def a05_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return _violation_types(spark, d, 29).groupBy("type").agg(F.count("*").alias("n"))


def a06_trend(spark: SparkSession, d: str) -> DataFrame:
    """Events with a type per day of a zero-filled week."""
    days = spark.range(7).select(F.date_sub(F.to_date(now()), F.col("id").cast("int")).alias("day"))
    rows = typed(shown_events(spark, d).where(F.col("is_violation") & (F.col("ts") >= _days_ago(6)))).where(F.size("types") > 0)
    counts = rows.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def a07_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """All types in canonical order, zero-filled."""
    names = spark.createDataFrame([(i + 1, t) for i, t in enumerate(TYPES)], "position int, type string")
    return names.join(a05_type_counts(spark, d), "type", "left").select("position", "type", F.coalesce("n", F.lit(0)).alias("n"))


def a08_top_violators(spark: SparkSession, d: str) -> DataFrame:
    """Five persons with most violations, with names."""
    rows = shown_events(spark, d).where(F.col("is_violation") & F.col("person_id").isNotNull() & (F.col("ts") >= _days_ago(29)))
    top = rows.groupBy("person_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "person_id").limit(5)
    names = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("person_id"), "c_name")
    return top.join(names, "person_id", "left").select("person_id", F.coalesce("c_name", "person_id").alias("name"), "n")


def a09_top_cameras(spark: SparkSession, d: str) -> DataFrame:
    """Five cameras by the number of types seen, with each type's count in canonical order."""
    by_type = _violation_types(spark, d, 29).groupBy("camera_id", "type").agg(F.count("*").alias("n"))
    cameras = by_type.groupBy("camera_id").agg(
        F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct(type_order(F.col("type")).alias("o"), "type", "n"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["type"], F.lit("="), p["n"].cast("string"))), ",")
    return cameras.orderBy(F.desc("total"), "camera_id").limit(5).select("camera_id", "total", text.alias("breakdown"))


def a10_today_and_week(spark: SparkSession, d: str) -> DataFrame:
    """Today's count and that since Monday."""
    return shown_events(spark, d).agg(F.count_if(F.col("ts") >= _days_ago(0)).alias("today"), F.count_if(F.col("ts") >= F.date_trunc("week", now())).alias("week"))


def a12_person_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Each person's violations today and in 7 and 30 days, zero where there are none."""
    hit = lambda n: F.count_if(F.col("is_violation") & (F.col("ts") >= _days_ago(n)))
    counts = safety_events(spark, d).where("person_id is not null").groupBy("person_id").agg(hit(0).alias("d1"), hit(6).alias("d7"), hit(29).alias("d30"))
    people = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("person_id"))
    return people.join(counts, "person_id", "left").na.fill(0, ["d1", "d7", "d30"])


def a13_segment_leaders(spark: SparkSession, d: str) -> DataFrame:
    """The two largest balances of each market segment."""
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("c_mktsegment", "rank", "c_custkey", "c_acctbal")


def f06_type_filter(spark: SparkSession, d: str) -> DataFrame:
    """Events with a type in any of its spellings."""
    return typed(shown_events(spark, d)).where(F.array_contains("types", "protective_clothing")).select("event_id", "camera_id")


def f08_active_visits(spark: SparkSession, d: str) -> DataFrame:
    """Visits that hold a moment and those still to come."""
    o = table(spark, d, "orders")
    end = F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 20).cast("int"))
    at = F.expr("timestamp_ntz'1998-06-30 12:00:00'")
    return o.where(end >= at).select("o_orderkey", ((F.col("o_orderdate") <= at)).alias("present"))


def f10_person_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where((F.col("c_mktsegment") != "BUILDING") & F.lower("c_name").contains("00012")).select("c_custkey", "c_name")


def j01_names(spark: SparkSession, d: str) -> DataFrame:
    """A person's name for each event: the dimension's, else the id, else unknown."""
    people = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("person_id"), "c_name")
    return shown_events(spark, d).join(people, "person_id", "left").select("event_id", F.coalesce("c_name", "person_id", F.lit("unknown")).alias("name"))


def o01_event_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of twenty, newest first."""
    return shown_events(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).offset(40).limit(20).select("event_id", "ts", "camera_id")


def o02_recent_violations(spark: SparkSession, d: str) -> DataFrame:
    return shown_events(spark, d).where("is_violation").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "ts")


def u05_ordered_types(spark: SparkSession, d: str) -> DataFrame:
    """Each event's types in first-seen order."""
    return typed(safety_events(spark, d)).select("event_id", F.array_join("types", ",").alias("types"))
