"""Percentiles, histograms, modes and rolling metrics of frame timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewatch.sources.views import telemetry


def ranked_values(rows: DataFrame, keys: list[str], value: str, places: dict[str, Column], width: int) -> DataFrame:
    """(keys, n, a column for each of ``places``): the whole number ``value`` at exact places of each key's sorted rows.

    ``places``: by name, a place from 0 as an expression of ``n``. Equal values are counted before
    the shuffle; counts by value range (``width`` wide) tell in which range a place lies, and only
    the values of such ranges are sorted, so no task sorts a key's rows.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("c")).withColumn("range", F.floor(F.col(value) / width))
    whole = Window.partitionBy(*keys)
    ranges = counts.groupBy(*keys, "range").agg(F.sum("c").alias("c"))
    ranges = ranges.withColumn("n", F.sum("c").over(whole)).withColumn("before", F.sum("c").over(whole.orderBy("range")) - F.col("c"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at.cast("bigint").alias("at")) for name, at in places.items()]))
    wanted = ranges.withColumn("w", wanted).where("w.at >= before and w.at < before + c").select(*keys, "range", "n", "before", "w.name", "w.at")
    inside = Window.partitionBy(*keys, "name").orderBy(value)
    found = wanted.join(counts, [*keys, "range"]).withColumn("upto", F.sum("c").over(inside) + F.col("before"))
    found = found.where("upto > at").groupBy(*keys, "n", "name").agg(F.min(value).alias("v"))
    return found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places])


def ceiled(p: float) -> Column:
    """The place of a report's percentile: ceil((n - 1) p)."""
    return F.ceil((F.col("n") - 1) * F.lit(p))


def half_even(p: float) -> Column:
    """The place of a worker's percentile: (n - 1) p, halves to the even place."""
    return F.rint((F.col("n") - 1) * F.lit(p))


def _in_ms(*names: str) -> list[Column]:
    return [(F.col(name) / 10_000).alias(name) for name in names]


def a19_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """p50, p95 and p99 per stage and shard: the value at place ceil((n - 1) p) of the sorted ones."""
    found = ranked_values(telemetry(spark, d), ["stage", "shard"], "units", {"p50": ceiled(0.5), "p95": ceiled(0.95), "p99": ceiled(0.99)}, 10_000)
    return found.select("stage", "shard", *_in_ms("p50", "p95", "p99"), "n")


def a21_slowest_cameras(spark: SparkSession, d: str) -> DataFrame:
    """Five cameras by p95."""
    rows = telemetry(spark, d)
    means = rows.groupBy("camera").agg((F.sum("units") / (F.count("*") * 10_000)).alias("mean"))
    found = ranked_values(rows, ["camera"], "units", {"p95": ceiled(0.95)}, 10_000).join(means, "camera")
    return found.select("camera", *_in_ms("p95"), "mean", "n").orderBy(F.desc("p95"), "camera").limit(5)


def a21_slowest_stages(spark: SparkSession, d: str) -> DataFrame:
    """The five slowest stages of each of the five slowest cameras."""
    rows = telemetry(spark, d).join(F.broadcast(a21_slowest_cameras(spark, d).select("camera")), "camera", "left_semi")  # five rows
    found = ranked_values(rows, ["camera", "stage"], "units", {"p95": ceiled(0.95)}, 10_000)
    place = F.row_number().over(Window.partitionBy("camera").orderBy(F.desc("p95"), "stage"))
    return found.withColumn("place", place).where("place <= 5").select("camera", "stage", "place", *_in_ms("p95"), "n")


def a22_batch_sizes(spark: SparkSession, d: str) -> DataFrame:
    return telemetry(spark, d).groupBy("batch").agg(F.count("*").alias("n"))


def a23_main_shard(spark: SparkSession, d: str) -> DataFrame:
    """The shard that most of a camera's timings name, as some run on the next ones; the smallest of equal ones."""
    shard = (F.col("shard") + F.col("batch") % 3) % 4
    counts = telemetry(spark, d).groupBy("camera", shard.alias("shard")).agg(F.count("*").alias("n"))
    return counts.groupBy("camera").agg(F.min_by("shard", F.struct((-F.col("n")).alias("n"), "shard")).alias("shard"))


def w06_rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean of each camera's last thirty timings at its end."""
    w = Window.partitionBy("camera").orderBy(F.desc("seq"))
    rows = telemetry(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 30")
    return rows.groupBy("camera").agg(F.round(F.avg("ms"), 4).alias("mean"), F.count("*").alias("n"))


def a26_shard_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the cameras' means per shard and the number of hot cameras."""
    cameras = telemetry(spark, d).groupBy("shard", "camera").agg(F.avg("ms").alias("mean"))
    return cameras.groupBy("shard").agg(F.round(F.avg("mean"), 4).alias("mean"), F.count_if(F.col("mean") > 560).alias("hot"))
