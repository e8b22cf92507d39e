"""The index of cells: the same rows as all pairs, with far fewer compared where vectors form groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from sitewatch.operators import cells
from sitewatch.operators.similarity import nearest


def grouped(spark, groups=30, each=40, width=16, seed=3):
    """Vectors near their group's centre, one group with a third of all, copies, and vectors that must not count."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    own = np.concatenate([np.repeat(np.arange(groups), each), np.zeros(groups * each // 2, int)])
    x = (centres[own] + 0.05 * rng.normal(size=(len(own), width))).astype(np.float32)
    x[7] = x[3]
    x[900:905] = x[3]
    vectors = [[float(v) for v in r] for r in x]
    vectors += [[0.0] * width, None, [float("nan")] * width, [None] * width, [1.0] * (width - 1), []]
    rows = [(i, v, int(own[i]) if i < len(own) else None) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id bigint, v array<float>, label bigint"), x


def ranked(frame):
    return sorted((r["query"], r["rank"], r["subject"], r["label"], round(r["score"], 9)) for r in frame.collect())


@pytest.mark.parametrize("kept", [1, 12])
def test_same_rows_as_all_pairs(spark, monkeypatch, kept):
    monkeypatch.setattr(cells, "BLOCK", 64)  # the hot cell is many blocks, a block's queries are several groups
    monkeypatch.setattr(cells, "CHUNK", 32)
    rows, x = grouped(spark)
    queries = rows.where("id % 10 = 0 or id in (3, 7) or id >= 1800").select(F.col("id").alias("query"), F.col("v").alias("q"))
    subjects = rows.select(F.col("id").alias("subject"), F.col("v").alias("s"), "label")
    plain, through = ranked(nearest(queries, subjects, kept)), ranked(nearest(queries, subjects, kept, most=0))
    assert plain == through
    unit = np.concatenate([x, np.zeros((1, x.shape[1]))]).astype(float)
    unit[:-1] /= np.sqrt((unit[:-1] ** 2).sum(1))[:, None]
    got = {}
    for q, rank, s, _, score in through:
        got.setdefault(q, []).append((s, score))
    asked = [q for q in range(len(unit)) if q % 10 == 0 or q in (3, 7) or q >= 1800]
    assert sorted(got) == asked  # the one without length is there, those that can't be compared are not
    for q in asked:
        scores = np.round(unit @ unit[q], 12)
        order = [s for s in np.lexsort((np.arange(len(unit)), -scores)) if s != q][:kept]
        assert [s for s, _ in got[q]] == order


def test_pairs_compared(spark):
    rows, _ = grouped(spark, groups=60, each=40)
    queries = rows.where("id % 10 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    index = cells.built(rows.select(F.col("id").alias("subject"), F.col("v").alias("s"), "label"), 16)
    pairs = sum(r["pairs"] for r in cells.pairs_compared(index, queries, 16, 5).collect())
    every = queries.count() * index.rows.count()
    assert pairs < every / 4, (pairs, every)


def test_empty_sides(spark):
    rows, _ = grouped(spark, groups=2, each=3)
    queries, subjects = rows.select(F.col("id").alias("query"), F.col("v").alias("q")), rows.select(F.col("id").alias("subject"), F.col("v").alias("s"), "label")
    for most in (0, 1 << 20):
        assert nearest(queries.where("false"), subjects, 3, most).count() == 0
        assert nearest(queries, subjects.where("false"), 3, most).count() == 0
        assert nearest(queries.where("query = 0"), subjects.where("subject = 0"), 3, most).count() == 0
