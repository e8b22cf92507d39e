"""Tables as file streams: written in the order of arrival, read to their end."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the session names for checkpoints; only a session in one process may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp()
    return f"{folder}/{uuid.uuid4().hex}"


def read_to_end(source: DataFrame, folder: str) -> None:
    """Append to files below ``folder`` what a streaming DataFrame gives until its input is used up, going on from the run before.

    Keyed state lies in RocksDB, in as many parts as the session has cores.
    """
    spark = source.sparkSession
    ours = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in ours}
    try:
        for k, v in ours.items():
            spark.conf.set(k, v)
        query = source.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def replayed(rows: DataFrame, form: Callable[[DataFrame], DataFrame], delay: Column, end: Column, parts: int = 6) -> DataFrame:
    """``form`` of the stream that ``rows`` make if each arrives ``delay`` seconds after its ``ts``.

    They come in ``parts`` micro-batches, in no order within one; the stream is stopped after each and goes on from its checkpoint. The last
    batch is one row that only has a time, ``end`` of the last ``ts``: it moves the watermark past all others.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    path, at = f"{folder}/in", F.unix_micros("ts") / 1e6 + delay
    span = rows.agg(F.min(at).alias("a"), F.max(at).alias("b"), F.max("ts").alias("last")).first()
    batches = [rows]
    if span["a"] is not None:
        width = (span["b"] - span["a"]) / parts + 1e-3
        dealt = rows.where(at.isNotNull()).withColumn("arrival", F.floor((at - span["a"]) / width).cast("int"))  # once, however many batches there are
        dealt.sortWithinPartitions("arrival", F.xxhash64("ts")).write.partitionBy("arrival").parquet(f"{folder}/all")
        dealt = spark.read.schema(dealt.schema).parquet(f"{folder}/all")
        batches = [dealt.where(F.col("arrival") == k).drop("arrival") for k in range(parts)]
        over = spark.range(1).select(F.lit(span["last"]).cast("timestamp").alias("ts")).select(end.alias("ts"))
        batches.append(over.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]))
    for batch in batches:
        batch.write.mode("append").parquet(path)
        found = form(spark.readStream.schema(rows.schema).parquet(path))
        read_to_end(found, folder)
    return spark.read.schema(found.schema).parquet(f"{folder}/out")
