"""Requests and their answers as two streams: a time-bounded outer join whose state goes with the watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.sources.views import safety_events
from sitewatch.streaming.replay import replayed


def second(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 1_000_000)


def dated(holds: Column) -> Column:
    """Whether a row has a time and ``holds``, as a sum: the optimizer would move a condition that doesn't name the time below the
    watermark, where a row that fails it would not move the watermark."""
    return F.when(holds, 1).otherwise(0) + F.col("ts").isNull().cast("int") * 2 == 1


def answered(requests: DataFrame, answers: DataFrame, wait: int = 43_200) -> DataFrame:
    """(event_id, ts, answer) of two streams of (event_id, user_id, ts), each with its own watermark on ``ts``.

    A request's answer is the first row of ``answers`` with its key after it, by time and then id, at most ``wait`` whole seconds later. A
    request comes out once: with its answer or, when the watermarks have passed the time that it may take, with null. What
    is later than the watermark is left out, and so are rows without a time, a key or an id. Both sides of the join and the fold of a request's
    answers are kept only as long as the watermarks say.
    """
    whole = dated(F.col("event_id").isNotNull() & F.col("user_id").isNotNull())
    asks = requests.where(whole).select("event_id", "user_id", "ts")
    said = answers.where(whole).select(F.col("event_id").alias("answer_id"), F.col("user_id").alias("answers"), F.col("ts").alias("said_at"))
    near = (F.col("said_at") >= F.col("ts")) & (F.col("said_at") <= F.col("ts") + F.expr(f"interval {int(wait) + 1} seconds"))
    after = (F.struct("said_at", "answer_id") > F.struct("ts", "event_id")) & (second(F.col("said_at")) - second(F.col("ts")) <= wait)
    pairs = asks.join(said, (F.col("user_id") == F.col("answers")) & near & after, "leftOuter")
    first = F.min(F.when(F.col("answer_id").isNotNull(), F.struct("said_at", "answer_id")))
    return pairs.groupBy("event_id", "ts").agg(first.alias("first")).select("event_id", "ts", F.col("first.answer_id").alias("answer"))


def sides(frames: DataFrame, late: str = "5 days") -> tuple[DataFrame, DataFrame]:
    """Requests and answers of one stream of (event_id, user_id, ts, asks), both as late as ``late``.

    A row's time counts for both watermarks, whichever side it is on.
    """
    marked = frames.withWatermark("ts", late)
    return marked.where(dated(F.col("asks"))), marked.where(dated(~F.col("asks")))


def stream_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests with their answers, from a stream whose rows come up to two days late and in no order: the rows of the batch form."""
    rows = safety_events(spark, d).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("k") % 2 == 0).alias("asks"))
    delay = F.pmod(F.xxhash64("event_id"), F.lit(2 * 86_400))
    found = replayed(rows, lambda frames: answered(*sides(frames)), delay, F.col("ts") + F.expr("interval 60 days"), parts=4)
    return found.select("event_id", "answer")
