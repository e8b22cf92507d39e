"""Codecs, dumps, and the events' write side as transformations: what is inserted, closed, filled in later, moved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.functions.vocabulary import matched_types
from sitewatch.sources.dumps import dump_lines, dumped
from sitewatch.sources.views import case_events, safety_events, table
from sitewatch.streaming.replay import shared_folder


def packed(meta: Column, payload: Column) -> Column:
    """Metadata and payload in one binary: the metadata's length in four bytes, then both."""
    size = F.unhex(F.lpad(F.hex(F.octet_length(meta)), 8, "0"))
    return F.concat(size, meta.cast("binary"), payload.cast("binary"))


def unpacked(data: Column) -> tuple[Column, Column]:
    size = F.conv(F.hex(F.substring(data, 1, 4)), 16, 10).cast("int")
    return F.substr(data, F.lit(5), size).cast("string"), F.substr(data, F.lit(5) + size, F.octet_length(data)).cast("string")


def io08_packed_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames packed and unpacked again."""
    meta = F.concat(F.lit('{"camera": "'), "camera_id", F.lit('"}'))
    rows = safety_events(spark, d).select("event_id", packed(meta, F.repeat(F.lit("é"), (F.col("k") % 5).cast("int"))).alias("data"))
    a, b = unpacked(F.col("data"))
    return rows.select("event_id", F.octet_length("data").alias("bytes"), a.alias("meta"), b.alias("payload"))


def encoded_vectors(rows: DataFrame, column: str) -> DataFrame:
    """``column``, an array of floats, as base64 of its little-endian bytes."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [None if x is None else np.asarray(x, "<f4").tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["vec_id", "data"])

    return rows.select("vec_id", column).mapInArrow(each, "vec_id bigint, data binary").select("vec_id", F.base64("data").alias("text"))


def decoded_vectors(rows: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [None if x is None else np.frombuffer(x, "<f4") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], ["vec_id", "embedding"])

    return rows.select("vec_id", F.unbase64("text").alias("data")).mapInArrow(each, "vec_id bigint, embedding array<float>")


def io09_decoded_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors after their way through text: their length and three of their components."""
    rows = decoded_vectors(encoded_vectors(table(spark, d, "embeddings"), "embedding"))
    e = F.col("embedding")
    return rows.select("vec_id", F.size(e).alias("n"), e[0].cast("double").alias("a"), e[1].cast("double").alias("b"), e[63].cast("double").alias("c"))


def dump_columns(spark: SparkSession, d: str) -> DataFrame:
    """Events with the 34 columns of a dump; lists are JSON, notes hold tabs, line ends and backslashes."""
    e, k = case_events(spark, d), F.col("k")
    note = F.when(k % 6 != 0, F.concat(F.lit("seen\tat "), "camera_id", F.lit("\n\\N\\"), F.col("event_id").cast("string")))
    frame = F.col("event_id")
    listed = {c: F.to_json(c) for c in ("missing", "actions", "stored", "cameras")}
    flags = {f"bit_{i}": F.shiftright(k, i).bitwiseAND(F.lit(1)) == 1 for i in range(7)}
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value", "k", "camera_id", "person_id", "source", "is_violation", "person_name", "bucket", "key", "path",
        *[x.alias(c) for c, x in listed.items()], *[x.alias(c) for c, x in flags.items()],
        (frame - 3).alias("start_frame"), F.when(k % 3 != 0, frame + k).alias("end_frame"), F.to_date("ts").alias("day"), (k / 100).alias("confidence"),
        (k % 4).alias("level"), F.when(k % 5 == 0, "").otherwise(F.col("event_type")).alias("danger"), (F.col("user_id") % 7).alias("shard"), note.alias("note"),
        F.when(k % 2 == 0, F.col("ts") + F.expr("interval 90 seconds")).alias("ended_at"))


def io12_dumped_events(spark: SparkSession, d: str) -> DataFrame:
    """Violations with a stored snapshot, read back from dumps of all events, which lie in the session's shared folder."""
    folder = shared_folder(spark)
    dump_lines(dump_columns(spark, d), "public.events").write.text(folder)
    wanted = "event_id bigint, camera_id string, source string, key string, path string, note string, is_violation boolean, bucket string"
    rows = dumped(spark, folder, "public.events", wanted)
    return rows.where("is_violation and bucket is not null and key is not null").select("event_id", "camera_id", "source", "key", "path", "note")


def io16_created_events(spark: SparkSession, d: str) -> DataFrame:
    """New events with what is filled in for them: all cameras, the types, the first frame."""
    e = case_events(spark, d).where("is_violation")
    start = F.when(F.col("k") % 4 == 0, None).otherwise(F.col("event_id") - 3)
    return e.select(
        "event_id", F.array_join(F.when(F.size("cameras") > 1, F.col("cameras")).otherwise(F.array("camera_id")), ",").alias("cameras"),
        F.array_join(matched_types(F.col("missing"), F.col("actions")), ",").alias("types"), F.coalesce(start, F.col("event_id")).alias("start_frame"))


def io17_closed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their closing row, instead of an update: the end, and the duration from the first frame."""
    e = case_events(spark, d).where("is_violation").select("event_id", F.when(F.col("k") % 4 == 0, None).otherwise(F.col("event_id") - 3).alias("start_frame"), "k")
    closing = e.where("k % 3 <> 0").select(F.col("event_id").alias("closes"), (F.col("event_id") + F.col("k")).alias("end_frame"))
    rows = e.join(closing, F.col("event_id") == F.col("closes"), "left")
    return rows.select("event_id", "end_frame", (F.col("end_frame") - F.coalesce("start_frame", "event_id") + 1).alias("duration"))


def io18_named_later(spark: SparkSession, d: str) -> DataFrame:
    """Events whose person was recognised only later: a name that came late fills a gap and replaces nothing."""
    e = case_events(spark, d).select("event_id", "person_name", "user_id")
    late = e.where("event_id % 5 = 0").select(F.col("event_id").alias("of"), F.concat(F.lit("Late "), F.col("user_id").cast("string")).alias("late"))
    return e.join(late, F.col("event_id") == F.col("of"), "left").select("event_id", F.coalesce("person_name", "late").alias("name"))


def io23_moved_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A job that moves old files into the store: rows with a path and no key, and what became of them."""
    rows = case_events(spark, d).where("path is not null and key is null")
    outcome = F.when(F.col("event_id") % 7 == 0, "missing file").when(F.col("event_id") % 11 == 0, "upload failed").otherwise("moved")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def io15_object_keys(spark: SparkSession, d: str) -> DataFrame:
    """Where an event's snapshot is stored: kind, environment, day, camera, id."""
    key = F.concat_ws("/", F.lit("violation"), F.lit("prod"), F.date_format("ts", "yyyy/MM/dd"), "camera_id", F.concat(F.col("event_id").cast("string"), F.lit(".jpg")))
    return safety_events(spark, d).where("is_violation").select("event_id", key.alias("key"))


def write_snapshots(rows: DataFrame, path: str) -> None:
    """Append rows (kind, ts, camera_id, ...) to a store that is partitioned by kind, day and camera."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("kind", "day", "camera_id").parquet(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """A manifest of images with their top predictions as JSON lines; ``rows``: image, class_name, confidence."""
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("order"), "class_name"))), 1, 5)
    best = rows.groupBy("image").agg(ranked.alias("p"))
    best.select("image", F.transform("p", lambda x, i: F.struct((i + 1).alias("rank"), x["class_name"].alias("class_name"), (-x["order"]).alias("confidence"))).alias("top_predictions")).write.mode("overwrite").json(path)
