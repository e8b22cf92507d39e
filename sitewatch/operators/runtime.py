"""Runtime metrics of cameras and workers: rolling windows, hotness, logs, head-counts, capacity, state machines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewatch.functions.clock import now, seconds
from sitewatch.operators.telemetry import ceiled, half_even, ranked_values
from sitewatch.sources.logs import BY_COLUMN, hourly_lines, write_hourly
from sitewatch.sources.views import boxes, cameras, log_lines, safety_events, telemetry
from sitewatch.streaming.replay import shared_folder


@dataclass(frozen=True)
class Limits:
    """From where a camera is hot, and below what it has headroom."""

    mean_ms: float = 600.0
    p95_ms: float = 1200.0
    mean_wait_ms: float = 250.0
    p95_wait_ms: float = 600.0
    age_ms: float = 900.0
    persons: float = 1.5
    backlog: float = 0.5
    skips: int = 3
    score: float = 3.0
    calm_mean_ms: float = 220.0
    calm_p95_ms: float = 350.0
    calm_persons: float = 0.5
    warning_ratio: float = 0.85
    warning_p95_ms: float = 500.0


#: The timings of the test tables are a tenth of what the fixed values are made for.
LIMITS = Limits(mean_ms=550.0, p95_ms=950.0, mean_wait_ms=280.0, p95_wait_ms=490.0, age_ms=700.0, persons=2.0, backlog=1.25, skips=3, score=3.0, calm_mean_ms=450.0, calm_p95_ms=920.0, calm_persons=1.5)
LAST = 30


def _recent() -> Window:
    return Window.partitionBy("camera").orderBy("seq").rowsBetween(-(LAST - 1), 0)


def rolling(rows: DataFrame) -> DataFrame:
    """Each row with the metrics of its camera's last thirty rows, itself included."""
    w = _recent()
    place = F.rint((F.size("last") - 1) * F.lit(0.95)).cast("int") + 1
    rows = rows.withColumn("last", F.array_sort(F.collect_list("units").over(w))).withColumn("n", F.count("*").over(w))
    rows = rows.withColumn("mean", F.sum("units").over(w) / (F.col("n") * 10_000)).withColumn("p95", F.element_at("last", place) / 10_000)
    return rows.withColumn("batches", F.sum("batch").over(w)).withColumn("top_batch", F.max("batch").over(w)).drop("last")


def w06_rolling_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Mean, p95 and largest batch over the last thirty timings, at every timing."""
    return rolling(telemetry(spark, d)).select("camera", "order_no", "line_no", "mean", "p95", "top_batch", "n")


def a18_last_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The rolling mean and p95 of each camera as they stand at its end."""
    rows = latest_metrics(spark, d)
    return rows.select("camera", "mean", "p95", "n")


def latest_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A row for each camera: metrics of its last thirty timings, taken from those rows alone; the age of their frames, persons and backlog are dealt by their numbers."""
    w = Window.partitionBy("camera").orderBy(F.desc("seq"))
    last = telemetry(spark, d).withColumn("r", F.row_number().over(w)).where(F.col("r") <= LAST)
    found = last.groupBy("camera").agg(
        F.count("*").alias("n"), F.sum("units").alias("units"), F.array_sort(F.collect_list("units")).alias("sorted"), F.sum("batch").alias("batches"),
        F.array_sort(F.collect_list("batch")).alias("waits"), F.sum(F.col("order_no") % 1200).alias("age"), F.sum(F.col("line_no") % 4).alias("persons"), F.sum(F.col("order_no") % 3).alias("backlog"),
        F.count_if(F.col("batch") > 48).alias("skips"), F.max_by("shard", F.struct("seq")).alias("shard"))
    place = F.rint((F.col("n") - 1) * F.lit(0.95)).cast("int") + 1
    found = found.withColumn("p95_wait", F.element_at("waits", place) * 10).drop("waits")
    return found.withColumn("p95_units", F.element_at("sorted", place)).withColumn("mean", F.col("units") / (F.col("n") * 10_000)).withColumn("p95", F.col("p95_units") / 10_000).drop("sorted")


def _tenths(tenths: Column) -> Column:
    """A whole number of tenths as text with one decimal."""
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def a20_worker_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """p50 and p95 of each of five shards to one decimal, zero where a shard has no rows."""
    found = ranked_values(telemetry(spark, d), ["shard"], "units", {"p50": half_even(0.5), "p95": half_even(0.95)}, 10_000)
    one = lambda c: F.coalesce(F.floor((F.col(c) + 500) / 1000) / 10, F.lit(0.0)).alias(c)
    return spark.range(5).withColumnRenamed("id", "shard").join(found, "shard", "left").select("shard", one("p50"), one("p95"))


def a22_capacity(spark: SparkSession, d: str, limits: Limits = LIMITS) -> DataFrame:
    """The share of batches of one, the number of hot cameras, and whether the workers are near capacity."""
    rows = telemetry(spark, d)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.col("batch") == 1).alias("ones"))
    p95 = ranked_values(rows.withColumn("all", F.lit(1)), ["all"], "units", {"p95": ceiled(0.95)}, 10_000)
    hot = a28_recommendations(spark, d, limits).agg(F.count_if("hot").alias("hot_cameras"))  # one row each
    row = sizes.withColumn("all", F.lit(1)).join(F.broadcast(hot.withColumn("all", F.lit(1))), "all").join(F.broadcast(p95.select("all", (F.col("p95") / 10_000).alias("p95"))), "all")
    warning = (F.col("ones") >= F.lit(limits.warning_ratio) * F.col("n")) & (F.col("hot_cameras") >= 2) & (F.col("p95") > limits.warning_p95_ms)
    return row.select("n", "ones", "hot_cameras", warning.alias("warning"))


def a26_shard_overview(spark: SparkSession, d: str, limits: Limits = LIMITS) -> DataFrame:
    """A row for each shard: cameras, p95 of their means, hot ones, the five hottest by p95."""
    c = latest_metrics(spark, d)
    hot = c.withColumn("hot", F.col("mean") > limits.mean_ms)
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("p95_units")).alias("a"), "camera"))), 1, 5), lambda x: x["camera"].cast("string"))
    found = hot.groupBy("shard").agg(F.count("*").alias("cameras"), F.array_sort(F.collect_list("mean")).alias("means"), F.count_if("hot").alias("hot"), F.array_join(top, ",").alias("hottest"))
    place = F.rint((F.col("cameras") - 1) * F.lit(0.95)).cast("int") + 1
    return found.select("shard", "cameras", F.element_at("means", place).alias("p95_of_means"), "hot", "hottest", (F.col("hot") >= 2).alias("warning"))


def _half_up(total: str, places: int) -> Column:
    """A mean over ``n`` rows in units of its last decimal place, as a whole number."""
    return F.floor((F.col(total) * (2 * 10**places) + F.col("n")) / (F.col("n") * 2))


def _spelled(number: Column, places: int) -> Column:
    """A whole number of units of the last decimal place as text."""
    return F.concat(F.floor(number / 10**places).cast("string"), F.lit("."), F.lpad((number % 10**places).cast("string"), places, "0"))


def _reasons(limits: Limits) -> dict[str, tuple[Column, Column]]:
    """What makes a camera hot, in the order in which it is named: whether it holds, and the figure shown."""
    age, persons, backlog = _half_up("age", 1), _half_up("persons", 2), _half_up("backlog", 2)
    return {
        "avg_latency": (F.col("mean") > limits.mean_ms, _tenths(F.floor((F.col("units") * 10 + F.col("n") * 5000) / (F.col("n") * 10_000)))),
        "p95_latency": (F.col("p95") > limits.p95_ms, _tenths(F.floor((F.col("p95_units") * 10 + 5000) / 10_000))),
        "avg_batch_wait": (F.col("batches") * 10 > F.lit(limits.mean_wait_ms) * F.col("n"), _tenths(F.floor((F.col("batches") * 200 + F.col("n")) / (F.col("n") * 2)))),
        "p95_batch_wait": (F.col("p95_wait") > limits.p95_wait_ms, _tenths(F.col("p95_wait") * 10)),
        "latest_frame_age": (age > limits.age_ms * 10, _spelled(age, 1)),
        "avg_person_count": (persons > limits.persons * 100, _spelled(persons, 2)),
        "avg_backlog": (backlog > limits.backlog * 100, _spelled(backlog, 2)),
        "backpressure_skips": (F.col("skips") >= limits.skips, F.col("skips").cast("string")),
    }


def _hotness(limits: Limits) -> Column:
    """Hundredths of points: a whole one for each of seven limits that is reached, and skips as a share of theirs, up to one."""
    n, share = F.col("n"), max(1, limits.skips)
    reached = [
        F.col("mean") >= limits.mean_ms, F.col("p95") >= limits.p95_ms, F.col("batches") * 10 >= F.lit(limits.mean_wait_ms) * n, F.col("p95_wait") >= limits.p95_wait_ms,
        F.col("age") >= F.lit(limits.age_ms) * n, F.col("persons") >= F.lit(limits.persons) * n, F.col("backlog") >= F.lit(limits.backlog) * n,
    ]
    return sum((x.cast("int") for x in reached), F.lit(0)) * 100 + F.least(F.lit(100), F.floor((F.col("skips") * 200 + share) / (2 * share)))


def a27_hotness(spark: SparkSession, d: str, limits: Limits = LIMITS) -> DataFrame:
    """One point for each of seven conditions that holds, and skips as a share of their limit, up to one."""
    return latest_metrics(spark, d).select("camera", (_hotness(limits) / 100).alias("score"))


def a28_recommendations(spark: SparkSession, d: str, limits: Limits = LIMITS) -> DataFrame:
    """Whether a camera is hot, the profile for it, and why: by eight limits, and where none is passed by its score alone."""
    return recommended(latest_metrics(spark, d), limits)


def recommended(metrics: DataFrame, limits: Limits) -> DataFrame:
    """(camera, hot, profile, reason) of rows as ``latest_metrics`` gives them."""
    named = F.array_compact(F.array(*[F.when(holds, F.concat(F.lit(f"{name}="), shown)) for name, (holds, shown) in _reasons(limits).items()]))
    score = _hotness(limits)
    by_score = F.when(score >= limits.score * 100, F.array(F.concat(F.lit("hotness_score="), _spelled(score, 2)))).otherwise(F.array().cast("array<string>"))
    reasons = F.when(F.size(named) > 0, named).otherwise(by_score)
    hot = F.size(reasons) > 0
    calm = (F.col("mean") < limits.calm_mean_ms) & (F.col("p95") < limits.calm_p95_ms) & (F.col("persons") <= F.lit(limits.calm_persons) * F.col("n"))
    return metrics.select(
        "camera", hot.alias("hot"), F.when(hot, "fast").when(calm, "accurate").otherwise("balanced").alias("profile"),
        F.when(hot, F.array_join(reasons, ",")).when(calm, "latency headroom is high").otherwise("current load is within balanced profile range").alias("reason"))


def a29_rates(spark: SparkSession, d: str) -> DataFrame:
    """Frames a day between a camera's first and last one, the share of skipped ones, and the age of the newest in seconds."""
    e = safety_events(spark, d).withColumn("at", seconds(F.col("ts"))).withColumn("skipped", F.col("k") % 10 == 0)
    found = e.groupBy("camera_id").agg(F.count_if(~F.col("skipped")).alias("n"), F.count_if("skipped").alias("skips"), F.min(F.when(~F.col("skipped"), F.col("at"))).alias("a"), F.max(F.when(~F.col("skipped"), F.col("at"))).alias("b"))
    rate = F.when((F.col("n") >= 2) & (F.col("b") > F.col("a")), (F.col("n") - 1) * 86_400 / (F.col("b") - F.col("a")))
    share = F.floor((F.col("skips") * 2000 + F.col("n") + F.col("skips")) / ((F.col("n") + F.col("skips")) * 2)) / 1000
    return found.select("camera_id", rate.alias("per_day"), share.alias("skip_ratio"), (seconds(now()) - F.col("b")).alias("age_s"))


def a30_batch_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Persons, cameras and complex frames of each tumbling window of six hours."""
    n = F.col("k") % 6
    rows = safety_events(spark, d).groupBy(F.window("ts", "6 hours").alias("w"))
    found = rows.agg(F.count("*").alias("frames"), F.sum(n).alias("persons"), F.max(n).alias("most"), F.countDistinct("camera_id").alias("cameras"), F.count_if(n >= 4).alias("complex"))
    return found.select(F.col("w.start").alias("start"), "frames", "persons", "most", "cameras", "complex")


def s34_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Persons and detected items of a frame."""
    return boxes(spark, d).groupBy("frame").agg(F.count_if(F.col("kind") == "person").alias("persons"), F.count("*").alias("complexity"))


def parsed_lines(lines: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Lines in a time range, with their time and the timing's fields; a line without a readable time is in every range."""
    at = F.try_to_timestamp(F.substring("line", 1, 23), F.lit("yyyy-MM-dd HH:mm:ss,SSS")).cast("timestamp_ntz")
    lines = lines.withColumn("at", at)
    for text, holds in ((start, lambda t: F.col("at") >= t), (end, lambda t: F.col("at") <= t)):
        if text:
            lines = lines.where(F.col("at").isNull() | holds(F.lit(text).cast("timestamp_ntz")))
    payload = F.regexp_extract("line", r"FRAME_TIMING (\{.*\})", 1)
    return lines.withColumn("timing", F.when(payload != "", F.from_json(payload, "camera_id string, stage string, units bigint, batch int")))


def io10_log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a range by what they say."""
    rows = parsed_lines(log_lines(spark, d), "1996-01-01", "1998-12-31")
    kind = F.when(F.col("timing.camera_id").isNotNull(), "timing").when(F.col("line").contains("FRAME_TIMING"), "broken").otherwise("notice")
    return rows.groupBy(kind.alias("kind"), F.col("at").isNull().alias("timeless")).agg(F.count("*").alias("n"))


def io10_log_tree(spark: SparkSession, d: str, start: str = "1996-01-01", end: str = "1998-12-31") -> DataFrame:
    """Lines of a range by component and what they say, from files by month in the session's shared folder; months outside aren't opened.

    A line without a time counts where its file does."""
    root = shared_folder(spark)
    lines = log_lines(spark, d).select(F.concat(F.lit("worker-"), (F.col("place.camera") % 4).cast("string")).alias("component"), "ts", "line")
    write_hourly(lines, root, "month")  # the table's times are days, a few lines each
    rows = parsed_lines(hourly_lines(spark, root, start, end, ["worker-0", "worker-1", "worker-3"], BY_COLUMN, "month"), start, end)
    kind = F.when(F.col("timing.camera_id").isNotNull(), "timing").when(F.col("line").contains("FRAME_TIMING"), "broken").otherwise("notice")
    return rows.groupBy("component", kind.alias("kind"), F.col("at").isNull().alias("timeless")).agg(F.count("*").alias("n"))


def io11_timings(spark: SparkSession, d: str) -> DataFrame:
    """Timings parsed from the lines' JSON, per camera and stage."""
    rows = parsed_lines(log_lines(spark, d)).where("timing.camera_id is not null")
    return rows.groupBy(F.col("timing.camera_id").alias("camera_id"), F.col("timing.stage").alias("stage")).agg(F.count("*").alias("n"), F.sum("timing.units").alias("units"), F.max("timing.batch").alias("batch"))


def a24_latest_payloads(spark: SparkSession, d: str) -> DataFrame:
    """The last timing of each camera as it was written; of equal times the last line counts."""
    rows = parsed_lines(log_lines(spark, d)).where("timing.camera_id is not null")
    last = F.max_by("timing", F.struct("at", "place"))
    return rows.groupBy(F.col("timing.camera_id").alias("camera_id")).agg(last.alias("t")).select("camera_id", "t.stage", "t.units", "t.batch")


def a25_log_counters(spark: SparkSession, d: str) -> DataFrame:
    """Notices in the lines, and skips by camera."""
    lines = log_lines(spark, d)
    said = lines.agg(F.count_if(F.col("line").contains("Dropping invalid frame payload")).alias("invalid frames"), F.count_if(F.col("line").contains("Expired pending async identity update")).alias("expired identities"))
    rows = said.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("n")) for c in said.columns])).alias("x")).select("x.*")
    skips = lines.select(F.regexp_extract("line", "Skipping inference sample for camera=([a-f0-9-]+)", 1).alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))
    return rows.unionByName(skips)


def a16_head_count(spark: SparkSession, d: str) -> DataFrame:
    """Persons in the workshop: the latest count of each camera, one camera's replaced by a newer number."""
    latest = safety_events(spark, d).groupBy("camera_id").agg(F.max_by(F.col("k") % 6, F.struct("ts", "event_id")).alias("n"))
    return latest.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("camera_id") == "cam_3", 9).otherwise(F.col("n"))).alias("with_replacement"))


def totals_over_time(rows: DataFrame, key: str, value: str, bucket: Column) -> DataFrame:
    """Add ``total``: the sum over all keys of their latest value at each row's time (ts, event_id).

    A row changes the sum by what it differs from its key's value before. Changes are summed within a
    bucket of time, and the sums of earlier buckets are added, so no task holds the whole time line.
    """
    rows = rows.withColumn("_change", F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(key).orderBy("ts", "event_id")), F.lit(0))).withColumn("_bucket", bucket)
    before = rows.groupBy("_bucket").agg(F.sum("_change").alias("_sum"))  # a row a bucket
    before = before.withColumn("_before", F.sum("_sum").over(Window.orderBy("_bucket")) - F.col("_sum")).select("_bucket", "_before")
    inside = F.sum("_change").over(Window.partitionBy("_bucket").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("total", inside).join(before, "_bucket").withColumn("total", F.col("total") + F.col("_before")).drop("_change", "_bucket", "_before")


def _head_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = safety_events(spark, d).select("event_id", "ts", "camera_id", (F.col("k") % 6).alias("persons"))
    return totals_over_time(rows, "camera_id", "persons", F.to_date("ts"))


def r03_overcapacity(spark: SparkSession, d: str, limit: int = 48) -> DataFrame:
    """Frames at which the workshop as a whole holds more persons than its limit."""
    return _head_counts(spark, d).where(F.col("total") > limit).select("event_id", "camera_id", "total")


def r04_capacity_alerts(spark: SparkSession, d: str, limit: int = 48, cooldown: int = 21_600) -> DataFrame:
    """The first frame over the limit of each cooldown bucket that has no alert yet."""
    bucket = F.floor(seconds(F.col("ts")) / cooldown)
    over = _head_counts(spark, d).where(F.col("total") > limit).groupBy(bucket.alias("bucket")).agg(F.min_by(F.struct("event_id", "total"), F.struct("ts", "event_id")).alias("e"), F.min("ts").alias("first_ts"))
    alerted = safety_events(spark, d).where("k = 97").select(bucket.alias("bucket")).distinct()
    return over.join(alerted, "bucket", "left_anti").select("bucket", "first_ts", "e.event_id", "e.total")


def a33_floor_activity(spark: SparkSession, d: str) -> DataFrame:
    """A camera for each floor: the one with most persons, and the one with fewest of those that see any."""
    latest = safety_events(spark, d).groupBy("camera_id").agg(F.max_by(F.col("k") % 6, F.struct("ts", "event_id")).alias("n")).where("n > 0")
    rows = latest.join(cameras(spark, d).select("camera_id", F.trim("floor").alias("floor")), "camera_id")
    return rows.groupBy("floor").agg(F.min_by("camera_id", F.struct((-F.col("n")).alias("a"), "camera_id")).alias("busiest"), F.min_by("camera_id", F.struct("n", "camera_id")).alias("calmest"))


def u02_merged_shards(spark: SparkSession, d: str) -> DataFrame:
    """The statuses that four shards report, merged: of a camera that several know, the newest counts."""
    e = safety_events(spark, d)
    parts = [e.where(F.col("event_id") % 4 == s).select(F.lit(s).alias("shard"), "camera_id", "ts", "event_id", "event_type") for s in range(4)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    newest = F.max_by(F.struct("shard", "event_id", "event_type"), F.struct("ts", "event_id"))
    return rows.groupBy("camera_id").agg(newest.alias("e")).select("camera_id", "e.shard", "e.event_id", "e.event_type")


def j18_camera_status(spark: SparkSession, d: str) -> DataFrame:
    """All cameras with the newest status that any shard has of them."""
    return cameras(spark, d).select("camera_id", "enabled").join(u02_merged_shards(spark, d), "camera_id", "left").select("camera_id", "enabled", "shard", "event_type")


def j20_target_shards(spark: SparkSession, d: str) -> DataFrame:
    """Where a hot camera could move: the shard of least p95, if it is another one, and the least one of the others."""
    shards = ranked_values(telemetry(spark, d), ["shard"], "units", {"p95": ceiled(0.95)}, 10_000).agg(F.array_sort(F.collect_list(F.struct("p95", "shard"))).alias("s"))  # one row, an entry a shard
    hot = latest_metrics(spark, d).join(a28_recommendations(spark, d).where("hot").select("camera"), "camera", "left_semi").select("camera", "shard")
    rows = hot.withColumn("one", F.lit(1)).join(F.broadcast(shards.withColumn("one", F.lit(1))), "one")
    other = F.filter("s", lambda x: x["shard"] != F.col("shard"))
    return rows.select("camera", "shard", F.when(F.col("s")[0]["shard"] != F.col("shard"), F.col("s")[0]["shard"]).alias("lightest"), F.get(other, F.lit(0))["shard"].alias("next_lightest"))


def st18_latest_tasks(spark: SparkSession, d: str) -> DataFrame:
    """What a mailbox of one slot a camera hands on in each interval of six hours: the newest frame, and how many it replaced."""
    rows = safety_events(spark, d).groupBy("camera_id", F.floor(seconds(F.col("ts")) / 21_600).alias("slot"))
    return rows.agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), (F.count("*") - 1).alias("replaced"))


def w11_top_persons(spark: SparkSession, d: str) -> DataFrame:
    """The two surest persons of a frame."""
    w = Window.partitionBy("frame").orderBy(F.desc("score"), "obj")
    return boxes(spark, d).where("kind = 'person'").withColumn("r", F.row_number().over(w)).where("r <= 2").select("frame", "obj", "r")


def w12_identity_picks(spark: SparkSession, d: str) -> DataFrame:
    """Persons whose identity is asked for next: unknown ones first, then failed and known ones whose wait is over, larger boxes before smaller."""
    waited = F.col("obj") % 13
    priority = F.when(F.col("obj") % 3 == 0, 0).when((F.col("obj") % 3 == 1) & (waited >= 10), 1).when((F.col("obj") % 3 == 2) & (waited >= 8), 2)
    size = (F.col("box.x2") - F.col("box.x1")) * (F.col("box.y2") - F.col("box.y1"))
    w = Window.partitionBy("frame").orderBy("priority", F.desc("size"), "obj")
    rows = boxes(spark, d).where("kind = 'person'").withColumn("priority", priority).withColumn("size", size).where("priority is not null")
    return rows.withColumn("r", F.row_number().over(w)).where("r <= 2").select("frame", "obj", "priority", "r")


def s24_shards(spark: SparkSession, d: str) -> DataFrame:
    """A camera's shard: the first eight bytes of its id's SHA-256 as a number, modulo four; some are pinned."""
    number = F.conv(F.substring(F.sha2(F.col("camera_id").cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return cameras(spark, d).select("camera_id", F.when(F.col("camera_id") == "cam_7", 0).otherwise((number % 4).cast("int")).alias("shard"))


def s25_camera_of_path(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.when(F.col("number") % 3 == 0, "/internal/workers/").otherwise("/internal/cameras/"), "camera_id", F.lit("/frame?x=1"))
    return cameras(spark, d).select("camera_id", F.nullif(F.regexp_extract(path, "^/internal/cameras/([^/?]+)", 1), F.lit("")).alias("found"))


def s26_durations(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds between two times of a row to one decimal; null where one is missing."""
    e = safety_events(spark, d)
    a, b = F.unix_micros(F.col("ts").cast("timestamp")), F.when(F.col("k") % 5 != 0, F.unix_micros(F.col("ts").cast("timestamp")) + F.col("k") * 1234)
    return e.select("event_id", (F.floor((b - a + 50) / 100) / 10).alias("ms"))


def s27_merged_telemetry(spark: SparkSession, d: str) -> DataFrame:
    """Two maps in one; the right one wins."""
    k = F.col("k").cast("string")
    left, right = F.create_map(F.lit("a"), k, F.lit("b"), F.lit("left")), F.when(F.col("k") % 2 == 0, F.create_map(F.lit("b"), F.lit("right"), F.lit("c"), k)).otherwise(F.create_map().cast("map<string,string>"))
    kept = F.map_filter(left, lambda key, _: ~F.map_contains_key(right, "b") | (key != "b"))
    return safety_events(spark, d).select("event_id", F.map_concat(kept, right).alias("m")).select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.col("m")["c"].alias("c"))


def st23_profiles(spark: SparkSession, d: str) -> DataFrame:
    """What a profile and a degrade level allow: frames a second, pose, identities, persons."""
    rows = cameras(spark, d).select("camera_id", (F.col("number") % 4).cast("int").alias("level"), F.element_at(F.array(*map(F.lit, ["fast", "balanced", "accurate", "odd"])), (F.col("number") % 4 + 1).cast("int")).alias("wanted"), (F.col("number") % 5 + 1).cast("int").alias("base"))
    profile = F.when(F.col("wanted").isin("fast", "balanced", "accurate"), F.col("wanted")).otherwise("balanced")
    rows = rows.withColumn("profile", profile)
    fast, level = F.col("profile") == "fast", F.col("level")
    own = F.when(fast, F.least("base", F.lit(2))).when(F.col("profile") == "accurate", F.greatest("base", F.lit(2))).otherwise(F.col("base"))
    fps = F.when(level >= 2, 1).when(level >= 1, F.least(own, F.lit(2))).otherwise(own)
    most = F.when(fast, 2).otherwise(4)
    return rows.select(
        "camera_id", "profile", "level", F.greatest(F.lit(1), fps).alias("fps"), (~fast & (level < 2)).alias("pose"), (fast | (level >= 2)).alias("unknown_only"),
        F.when(fast | (level >= 2), 1).otherwise(2).alias("identities"), F.when(level >= 3, F.least(most, F.lit(2))).otherwise(most).alias("persons"))


def folded(rows: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str) -> DataFrame:
    """Each key's rows in order through ``step``(state, row) -> (state, output rows); the state of a new key is None.

    Spark sorts (and spills), and a task reads its rows batch by batch, so only one key's state is held. A
    key's last state may have more to say: ``step`` is called with row None when the key is over.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    columns = rows.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        started, kinds = False, None

        def batch(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

        for b in batches:
            out = []
            kinds = kinds or [arrow_type(f) for f in schema.split(", ")]
            for row in b.to_pylist():
                mine = tuple(row[k] for k in keys)
                if not started or mine != key:
                    if started:
                        out += step(state, None)[1]
                    key, state, started = mine, None, True
                state, more = step(state, row)
                out += more
            yield batch(out)
        if started:
            yield batch(step(state, None)[1])

    return rows.select(columns).mapInArrow(each, schema)


def arrow_type(field: str) -> pa.DataType:
    kind = field.split()[1]
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[kind]


def st01_sampled_frames(spark: SparkSession, d: str, gap: int = 14_400) -> DataFrame:
    """Frames that a camera processes: the first, then one at each slot; a slot is the last one plus the gap, or now if that is past.

    Of one second's frames only the first can be processed; the others go before the shuffle, so a camera's fold grows with time alone.
    """
    rows = safety_events(spark, d).groupBy("camera_id", seconds(F.col("ts")).alias("at")).agg(F.min("event_id").alias("event_id"))

    def step(due, row):
        if row is None or (due is not None and row["at"] < due):
            return due, []
        return max((row["at"] if due is None else due) + gap, row["at"]), [(row["camera_id"], row["event_id"])]

    return folded(rows, ["camera_id"], ["at", "event_id"], step, "camera_id string, event_id bigint")


def st22_degrade_levels(spark: SparkSession, d: str) -> DataFrame:
    """The level of each camera at its timings: one step towards what p95 asks for, after a hold, and after a stay on the present level.

    p95 over the last thirty timings asks for 3, 2 or 1 from 980, 960 and 940 milliseconds on, and for 0 from 900 down. A
    wish must stand for ten days to go up and for twenty-five to go down, and a level lasts fifteen.
    """
    rows = rolling(telemetry(spark, d)).select("camera", (F.unix_timestamp(F.col("ts").cast("timestamp")) / 86_400).cast("bigint").alias("day"), "order_no", "line_no", "p95")

    def step(state, row):
        if row is None:
            return state, []
        level, since, wish, wished = state or (0, -1_000_000, None, 0)
        p = row["p95"]
        want = 3 if p >= 980 else 2 if p >= 960 else 1 if p >= 940 else 0 if level and p <= 900 else level
        if want == level:
            wish = None
        elif want != wish:
            wish, wished = want, row["day"]
        elif row["day"] - since >= 15 and row["day"] - wished >= (10 if want > level else 25):
            level, since, wish = level + (1 if want > level else -1), row["day"], None
        return (level, since, wish, wished), [(row["camera"], row["order_no"], row["line_no"], level)]

    return folded(rows, ["camera"], ["day", "order_no", "line_no", "p95"], step, "camera bigint, order_no bigint, line_no int, level int")
