"""Identities over time: links against all pairs, components against a plain search, and who names an identity."""

import numpy as np
import pytest

from sitewatch.operators.identity import components, links, resolved
from sitewatch.sources.store import checkpointed

LOOK = "event_id bigint, at bigint, key string, matched boolean, embedding array<float>, slice string, block string"


def all_pairs(rows, lives, alike):
    out = {}
    unit = {}
    for i, at, *_, v, _, _ in rows:
        if i is not None and at is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 1e-8:
            unit[i] = (at, np.array(np.float32(v), float) / np.linalg.norm(np.array(np.float32(v), float)))
    for i, (at, v) in unit.items():
        seen = [(-round(float(v @ w), 9), t, j) for j, (t, w) in unit.items() if len(w) == len(v) and (t, j) < (at, i) and t >= at - lives * 1_000_000]
        if seen and -min(seen)[0] >= alike:
            out[i] = min(seen)[2]
    return out


def observed(n=400, seed=3):
    """Looks of forty persons; a third of all falls into one slice of time, some are broken, some are equal."""
    rng = np.random.default_rng(seed)
    faces = rng.normal(size=(40, 8))
    rows = []
    for i in range(n):
        at = int(rng.integers(5_000_000, 9_000_000)) if i % 3 == 0 else int(rng.integers(0, 100_000_000))
        v = [float(x) for x in faces[i % 40] + rng.normal(size=8) * 0.2]
        rows.append((i, at, f"k{i % 90}", i % 7 == 0, v, "x", "y"))
    rows += [(n, 6_000_000, "n", False, None, "x", "y"), (n + 1, 6_000_000, "n", False, [0.0] * 8, "x", "y"), (n + 2, 6_000_000, "n", False, [float("nan")] * 8, None, None)]
    rows += [(n + 3, None, "n", False, rows[0][4], "x", "y"), (None, 6_000_000, "n", False, rows[0][4], "x", "y"), (n + 4, 6_000_000, "n", False, [1.0, 2.0], "x", "y")]
    rows += [(n + 5 + i, 6_000_000, "t", False, rows[3][4], "x", "y") for i in range(3)] + [(n + 9, 7_000_000, "e", False, [], "x", "y")]
    return rows


@pytest.mark.parametrize("block", [16, 4_096])
def test_links_are_those_of_all_pairs(spark, block):
    rows = observed()
    got = links(spark.createDataFrame(rows, LOOK), 4, 0.9, block).collect()
    want = all_pairs(rows, 4, 0.9)
    assert len(want) > 100 and {r["event_id"]: r["seen_id"] for r in got} == want and len(got) == len(want)


def test_a_task_sees_two_blocks_however_full_a_slice_is(spark):
    from sitewatch.operators.identity import _blocked

    rows = [(i, i, "k", False, [1.0, float(i % 5)], "x", "y") for i in range(1_000)]  # one slice
    rows = spark.createDataFrame(rows, LOOK).drop("slice", "block")
    sizes = [r["count"] for r in _blocked(rows, 4, 32).groupBy("slice", "block").count().collect()]
    assert sum(sizes) == 1_000 and max(sizes) <= 64
    assert links(rows, 4, 0.999, 32).count() == 1_000 - 5  # all but the first of each direction


def test_components_of_chains_stars_and_rings(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)]
    star = [("s5", f"s{i}") for i in range(10, 60)] + [("s9", "s5"), ("s9", "s9")]
    ring = [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("r1", "r2")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star + ring, "a string, b string")).collect()}
    want = {f"c{i:03d}": "c000" for i in range(151)} | {f"s{i}": "s10" for i in [5, 9, *range(10, 60)]} | {f"r{i}": "r1" for i in (1, 2, 3)}
    assert got == want
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_the_latest_matched_person_names_an_identity(spark):
    v, w, u = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, 0, "unmatched:a:1", False, v), (2, 10, "person:7", True, v), (3, 20, "unmatched:b:4", False, v), (4, 30, "person:8", True, v), (5, 5, "unmatched:c:2", False, w), (6, 6, "unmatched:d:3", False, w), (7, 9, "unmatched:e:5", False, u)]
    seen = spark.createDataFrame([(*r, "", "") for r in rows], LOOK)
    got = {r["key"]: r["identity"] for r in resolved(seen, checkpointed(links(seen, 4, 0.9))).collect()}
    assert got == {"unmatched:a:1": "person:8", "person:7": "person:8", "unmatched:b:4": "person:8", "person:8": "person:8", "unmatched:c:2": "unmatched:c:2", "unmatched:d:3": "unmatched:c:2", "unmatched:e:5": "unmatched:e:5"}


def test_no_observations(spark):
    none = spark.createDataFrame([], LOOK)
    found = links(none, 4, 0.9)
    assert found.count() == 0 and resolved(none, found).count() == 0
    lone = spark.createDataFrame([(1, 0, "k", False, [1.0], "", "")], LOOK)
    assert [tuple(r) for r in resolved(lone, links(lone, 4, 0.9)).select("key", "identity").collect()] == [("k", "k")]


def test_a_row_goes_to_few_tasks_and_scores_at_the_bound_count(spark):
    from sitewatch.operators.identity import BLOCK, _blocked

    full = spark.range(20_000).selectExpr("id as event_id", "id as at")  # one slice
    assert _blocked(full, 4, BLOCK).agg({"blocks": "max"}).first()[0] == 1
    bound = [0.9, float(np.sqrt(1 - 0.81))]  # cosine 0.9 to nine places, though not in single precision
    rows = [(1, 0, "k", False, [1.0, 0.0], "x", "y"), (2, 1, "k", False, bound, "x", "y"), (3, 2, "k", False, [0.8999, 0.43609], "x", "y")]
    wide = spark.createDataFrame(rows, LOOK.replace("array<float>", "array<double>"))
    assert {r["event_id"]: r["seen_id"] for r in links(wide.where("event_id < 3"), 4, 0.9).collect()} == {2: 1}
    assert links(wide.where("event_id <> 2"), 4, 0.9).count() == 0
