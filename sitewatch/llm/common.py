"""Helpers that several operators share: checkpoints, distributed running sums, components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the session names.

    Only a session in one process without ``spark.checkpoint.dir`` (tests) gets a folder of its own; on
    a cluster that would be a folder that executors can't see, so there it is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return df.checkpoint()


def pressed(rows: DataFrame, column: str) -> DataFrame:
    """(doc_id, column) with the column's bytes compressed, for joins that move whole texts; no null may be in it."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press(x) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", column])

    rows = rows.select("doc_id", column)
    return rows.mapInArrow(each, rows.schema)


def numbered(docs: DataFrame) -> DataFrame | None:
    """``docs`` with ``_n``, the number of each (doc_id, text) in that order; None if every row has a doc_id of its own.

    Rows of the same doc_id and text have one number, other texts of that doc_id have their own, and a
    null doc_id comes after all others. Texts are told apart by a 64-bit hash.
    """
    repeated = docs.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("_rows")).where("doc_id is null or _rows > 1")
    if not repeated.limit(1).count():
        return None
    names = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_g")).distinct()
    names = checkpointed(names.orderBy(F.col("_id").asc_nulls_last(), "_g").withColumn("_n", F.monotonically_increasing_id()))
    return docs.join(names, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_g"))).drop("_id", "_g")


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[str | Column], value: Column, name: str) -> DataFrame:
    """Add ``name``: the running sum of ``value`` within ``keys``, in the order (bucket, order).

    Two levels: a window inside each (keys, bucket), and a second window over the bucket totals
    alone. No task holds a whole key; it holds one bucket, and the caller sizes the buckets.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    offsets = totals.select(*keys, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return (
        df.withColumn(name, F.sum(value).over(inside))
        .join(offsets, [*keys, bucket])
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_before")
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges`` (u, v): rows (node, component).

    ``component`` is the smallest node reachable; nodes without an edge are not returned. Alternates
    large-star and small-star steps until the edges stay the same; every step joins on the node with
    a minimum that was combined before the shuffle, so that a star's centre is one row.
    """
    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = signature(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = signature(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
