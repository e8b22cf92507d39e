"""Rows that later steps read again, in the shared folder of the session, and what needs them there."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(rows: DataFrame) -> DataFrame:
    """Rows in the shared folder of ``spark.checkpoint.dir``, so that lost executors don't undo earlier rounds."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return rows.checkpoint()


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """All rows with ``place``, from 1 in the given order, which no two rows may share.

    A range sort deals the rows; a place is that within a partition plus the rows of the partitions before, a row for each of which is
    summed. No task sees more than its own share.
    """
    rows = checkpointed(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(sizes), part == F.col("_part")).withColumn("place", within + F.col("_before") + 1).drop("_at", "_part", "_before")
