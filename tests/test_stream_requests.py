"""Requests and answers as two streams: each request once, late rows and state."""

import datetime

from sitewatch.streaming.replay import read_to_end
from sitewatch.streaming.requests import answered

DAY = datetime.datetime(2024, 3, 1, tzinfo=datetime.timezone.utc)
ROW = "event_id bigint, user_id bigint, ts timestamp"


def test_each_request_comes_out_once(spark, tmp_path):
    at = lambda h: DAY + datetime.timedelta(hours=h)
    batches = [
        ([(1, 7, at(0)), (2, 7, at(1)), (3, 8, at(1)), (4, None, at(1)), (None, 7, at(1))], [(13, 8, at(14)), (11, 7, at(5)), (10, 7, at(3)), (9, 7, at(-1)), (0, 7, at(1))]),
        ([(5, 9, at(2))], [(12, 7, at(2))]),  # out of order, but within the day
        ([(20, 7, at(100))], [(21, 7, at(100))]),  # the others are over now
        ([(6, 7, at(3)), (22, 9, at(101))], [(23, 9, at(102)), (24, 8, at(13))]),  # 6 and 24 are far behind
        ([(90, 1, at(400))], [(91, 2, at(400))]),
    ]
    counts = []
    for asks, said in batches:
        for name, rows in (("asks", asks), ("said", said)):
            spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        two = [spark.readStream.schema(ROW).parquet(f"{tmp_path}/{name}").withWatermark("ts", "1 day") for name in ("asks", "said")]
        read_to_end(answered(*two), str(tmp_path))
        counts.append(spark.read.parquet(f"{tmp_path}/out").count())
    got = [(r["event_id"], r["answer"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    # 0 comes at request 2's own time with a lesser id; 13 is thirteen hours after request 3; 21 is at 20's time with a greater id
    assert sorted(got) == [(1, 0), (2, 12), (3, None), (5, None), (20, 21), (22, 23)]
    assert counts[0] == counts[1] == 0 and counts[2] == 4
