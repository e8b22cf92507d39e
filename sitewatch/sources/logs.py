"""Log files by hour: paths outside a range of time aren't opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups of a path: component, year, month, day, hour; and the same as Spark's own partitioned writer names folders.
BY_HOUR = r"/([^/]+)/(\d{4})/(\d{2})/(\d{2})/(\d{2})\.log$"
BY_COLUMN = r"/component=([^/]+)/year=(\d{4})/month=(\d{2})/day=(\d{2})/hour=(\d{2})/[^/]*$"


def hourly_lines(spark: SparkSession, root: str, start: str | None = None, end: str | None = None, components: list[str] | None = None, pattern: str = BY_HOUR, rotation: str = "hour") -> DataFrame:
    """(component, hour, place, line) of the files below ``root`` whose hour meets [start, end]; ``place`` orders the lines of a file.

    What a path says is a condition on the file's name, by which Spark leaves files out before it opens them. Files whose path doesn't
    follow ``pattern`` are left out. Files that begin a new ``rotation`` (hour, day, month) are meant to hold the lines until the next
    one. Lines within the first and last file are not cut; ``operators.runtime.parsed_lines`` does that.
    """
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, pattern, i)
    hour = F.concat_ws("", *[part(i) for i in (2, 3, 4, 5)])
    rows = spark.read.option("recursiveFileLookup", "true").text(root)
    rows = rows.where(path.rlike(pattern))
    first = lambda text: F.date_format(F.date_trunc(rotation, F.lit(text).cast("timestamp")), "yyyyMMddHH")
    if start:
        rows = rows.where(hour >= first(start))
    if end:
        rows = rows.where(hour <= first(end))
    if components is not None:
        rows = rows.where(part(1).isin(components))
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return rows.select(part(1).alias("component"), F.try_to_timestamp(hour, F.lit("yyyyMMddHH")).cast("timestamp_ntz").alias("hour"), place.alias("place"), F.col("value").alias("line"))


def write_hourly(lines: DataFrame, root: str, rotation: str = "hour") -> None:
    """Append ``lines`` (component, ts, line) below ``root`` by component and the hour that begins their ``rotation``, in folders that
    ``BY_COLUMN`` reads."""
    parts = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH"}
    rows = lines.select("component", *[F.date_format(F.date_trunc(rotation, "ts"), f).alias(c) for c, f in parts.items()], "line")
    rows.repartition("component", *parts).write.mode("append").partitionBy("component", *parts).text(root)
