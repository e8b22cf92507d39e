"""Orders over more rows than one page, and every reason that makes a camera hot."""

import pytest

from sitewatch.operators.runtime import Limits, recommended
from sitewatch.operators.search import o04_camera_order
from sitewatch.sources.store import placed


def test_all_cameras_have_a_place(spark, tmp_path):
    n = 1_500
    rows = spark.createDataFrame([(i, f"Supplier {i}", float(i)) for i in range(1, n + 1)], "s_suppkey bigint, s_name string, s_acctbal double")
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    got = o04_camera_order(spark, str(tmp_path)).collect()
    assert sorted(r["place"] for r in got) == list(range(1, n + 1)) and len({r["camera_id"] for r in got}) == n


def test_places_follow_the_order_over_partitions(spark):
    rows = spark.range(5_000, numPartitions=7).selectExpr("id", "id * 7919 % 5003 AS key")
    got = placed(rows, [rows["key"], rows["id"]]).collect()
    want = {i: p + 1 for p, (_, i) in enumerate(sorted((i * 7919 % 5003, i) for i in range(5_000)))}
    assert {r["id"]: r["place"] for r in got} == want
    assert placed(rows.where("id < 0"), [rows["key"]]).count() == 0


#: Sums over ten timings that pass no limit.
CALM = {"n": 10, "units": 20_000_000, "mean": 200.0, "p95_units": 3_000_000, "p95": 300.0, "batches": 100, "p95_wait": 200, "age": 4_000, "persons": 4, "backlog": 2, "skips": 0}


@pytest.mark.parametrize(
    "changed, profile, reason",
    [
        ({}, "accurate", "latency headroom is high"),
        ({"persons": 6}, "balanced", "current load is within balanced profile range"),
        ({"units": 60_010_000, "mean": 600.1}, "fast", "avg_latency=600.1"),
        ({"p95_units": 12_500_000, "p95": 1250.0}, "fast", "p95_latency=1250.0"),
        ({"batches": 251}, "fast", "avg_batch_wait=251.0"),
        ({"p95_wait": 610}, "fast", "p95_batch_wait=610.0"),
        ({"age": 9_004}, "fast", "latest_frame_age=900.4"),
        ({"persons": 16}, "fast", "avg_person_count=1.60"),
        ({"backlog": 6}, "fast", "avg_backlog=0.60"),
        ({"skips": 3}, "fast", "backpressure_skips=3"),
        ({"age": 9_010, "skips": 4}, "fast", "latest_frame_age=901.0,backpressure_skips=4"),
        ({"age": 9_000, "persons": 15, "backlog": 5}, "fast", "hotness_score=3.00"),  # at three limits, past none
        ({"age": 9_000, "persons": 15, "backlog": 5, "skips": 2}, "fast", "hotness_score=3.67"),
        ({"persons": 15, "backlog": 5, "skips": 2}, "balanced", "current load is within balanced profile range"),
    ],
)
def test_reasons(spark, changed, profile, reason):
    row = {"camera": 1, **CALM, **changed}
    got = recommended(spark.createDataFrame([row]), Limits()).first()
    assert (got["profile"], got["reason"], got["hot"]) == (profile, reason, profile == "fast")
