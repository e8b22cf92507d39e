"""Exact nearest vectors through cells around pivots: cells that can't hold a better subject are not visited."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch.sources.store import checkpointed

#: Most pivots (they go to all tasks), rows of a block of a cell, and queries that meet a block at once.
CELLS, BLOCK, CHUNK = 4096, 2048, 2048
#: Radians by which rounding may change an angle.
SLACK = 1e-6


class Index(NamedTuple):
    """``rows``: subject, s, label, cell, angle, block. Of each cell: least and greatest angle to its pivot, rows, first block, blocks."""

    rows: DataFrame
    pivots: np.ndarray
    near: np.ndarray
    far: np.ndarray
    n: np.ndarray
    first: np.ndarray
    blocks: np.ndarray


def comparable(vector: str, width: int) -> Column:
    """Whether a vector has ``width`` components, all of them finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


def units(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width in double precision, each over its length; one without length stays zero."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if not len(vectors):
        return np.zeros((0, 1))
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    length = np.sqrt((x * x).sum(1))[:, None]
    return np.divide(x, length, out=np.zeros_like(x), where=length > 1e-8)


def best(own: np.ndarray, m: np.ndarray, subject: np.ndarray, s: np.ndarray, label: pa.Array, kept: int) -> Iterator[pa.RecordBatch]:
    """(query, subject, label, score): the ``kept`` best of these subjects for each query, a block of both at a time."""
    for a in range(0, len(subject), BLOCK):
        order = a + np.argsort(subject[a : a + BLOCK], kind="stable")
        some, named = subject[order], label.take(pa.array(order))
        for b in range(0, len(own), CHUNK):
            mine = own[b : b + CHUNK]
            scores = np.round(np.clip(m[b : b + CHUNK] @ s[order].T, -1, 1), 12)  # copies tie, however a product was summed
            scores[mine[:, None] == some[None, :]] = -2
            column = np.argsort(-scores, axis=1, kind="stable")[:, :kept]
            row = np.repeat(np.arange(len(mine)), column.shape[1])
            column = column.ravel()
            real = scores[row, column] > -2
            row, column = row[real], column[real]
            yield pa.RecordBatch.from_arrays([pa.array(mine[row]), pa.array(some[column]), named.take(pa.array(column)), pa.array(scores[row, column])], ["query", "subject", "label", "score"])


def built(subjects: DataFrame, width: int) -> Index:
    """Subjects dealt to the cell of their most similar pivot; pivots are a sample of them by hash, the root of their number.

    A cell's rows are dealt to blocks of some ``BLOCK`` rows, so a cell that holds a third of all is many groups.
    """
    spark = subjects.sparkSession
    subjects = subjects.where(F.col("subject").isNotNull() & comparable("s", width))
    most = min(CELLS, max(1, round(subjects.count() ** 0.5)))
    sample = subjects.orderBy(F.xxhash64("subject"), "subject").limit(most).select("s").collect()  # CELLS rows at most
    pivots = units(pa.array([r["s"] for r in sample], pa.list_(pa.float64()))) if sample else np.zeros((1, width))
    shared = spark.sparkContext.broadcast(pivots)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                cosines = units(part.column(1)) @ shared.value.T
                cell = cosines.argmax(1)
                angle = np.arccos(np.clip(cosines[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], [*part.schema.names, "cell", "angle"])

    label = subjects.schema["label"].dataType.simpleString()
    rows = subjects.select("subject", F.col("s").cast("array<double>").alias("s"), "label").mapInArrow(dealt, f"subject bigint, s array<double>, label {label}, cell int, angle double")
    rows = checkpointed(rows)  # read for the cells' bounds and by both passes
    found = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far")).orderBy("cell").collect()  # a row a cell
    cell = np.array([r["cell"] for r in found], int)
    n, near, far = (np.array([r[c] for r in found], t) for c, t in (("n", np.int64), ("near", float), ("far", float)))
    blocks = -(-n // BLOCK)
    first = np.cumsum(blocks) - blocks
    places = spark.createDataFrame([(int(c), int(a), int(k)) for c, a, k in zip(cell, first, blocks)], "cell int, _first bigint, _blocks bigint")
    rows = rows.join(F.broadcast(places), "cell").withColumn("block", F.col("_first") + F.pmod(F.xxhash64("subject"), F.col("_blocks"))).drop("_first", "_blocks")
    return Index(rows, pivots[cell], near, far, n, first, blocks)


def _visits(index: Index, queries: DataFrame, kept: int) -> DataFrame:
    """(query, q, block) of ``queries`` (query, q, least).

    Without a ``least`` score a query goes to the nearest cells that hold ``kept`` others. With one it goes to all further
    cells whose bound reaches it: angles obey the triangle inequality, so no subject of a cell is nearer to a query than the query's angle to
    the pivot lies outside the cell's angles. (A vector without length has the score 0 everywhere, which no bound of its cell is below.)
    """
    shared = queries.sparkSession.sparkContext.broadcast(index[1:])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, near, far, n, first, blocks = shared.value
        numbers = [np.arange(a, a + k) for a, k in zip(first, blocks)]
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                if not len(pivots):
                    continue
                angle = np.arccos(np.clip(units(b.column(1)) @ pivots.T, -1, 1))
                order = np.argsort(angle, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                early = np.zeros(angle.shape, bool)
                np.put_along_axis(early, order, before <= kept, axis=1)  # one more than is kept, as a query may find itself
                least = b.column(2).to_numpy(zero_copy_only=False)
                bound = np.cos(np.maximum(0, np.maximum(angle - far, near - angle) - SLACK))
                go = np.where(np.isnan(least)[:, None], early, ~early & (bound >= least[:, None]))
                lists = [np.concatenate([numbers[c] for c in np.flatnonzero(g)]) if g.any() else np.zeros(0, np.int64) for g in go]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int64()))], ["query", "q", "blocks"])

    rows = queries.select("query", "q", F.col("least").cast("double").alias("least")).mapInArrow(each, "query bigint, q array<double>, blocks array<bigint>")
    return rows.select("query", "q", F.explode("blocks").alias("block"))


def _met(index: Index, visits: DataFrame, kept: int) -> DataFrame:
    """The best of each block for each query that visits it; a group is one block and some ``CHUNK`` of its queries."""
    asked = visits.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    left = visits.join(asked, "block").withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")))
    right = index.rows.join(asked, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    label = index.rows.schema["label"].dataType.simpleString()
    schema = f"query bigint, subject bigint, label {label}, score double"

    def each(a: pa.Table, b: pa.Table) -> pa.Table:
        kinds = pa.schema([("query", pa.int64()), ("subject", pa.int64()), b.schema.field("label"), ("score", pa.float64())])
        parts = best(a["query"].to_numpy(), units(a["q"]), b["subject"].to_numpy(), units(b["s"]), b["label"].combine_chunks(), kept) if a.num_rows and b.num_rows else ()
        return pa.Table.from_batches([p.cast(kinds) for p in parts], kinds)

    keys = ["block", "chunk"]
    return left.select(*keys, "query", "q").groupBy(*keys).cogroup(right.select(*keys, "subject", "s", "label").groupBy(*keys)).applyInArrow(each, schema)


def passes(index: Index, queries: DataFrame, width: int, kept: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Visits and findings of the first pass, then of the second, which knows each query's ``kept``-th score so far."""
    queries = queries.where(F.col("query").isNotNull() & comparable("q", width)).select("query", F.col("q").cast("array<double>").alias("q"))
    early = _visits(index, queries.withColumn("least", F.lit(None).cast("double")), kept)
    found = checkpointed(_met(index, early, kept))
    scores = F.sort_array(F.collect_list("score"), asc=False)  # of the few nearest cells, at most ``kept`` a block
    least = found.groupBy("query").agg(F.coalesce(F.get(scores, F.lit(kept - 1)), F.lit(-2.0)).alias("least"))
    late = _visits(index, queries.join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))), kept)
    return early, found, late, _met(index, late, kept)


def through_cells(queries: DataFrame, subjects: DataFrame, width: int, kept: int) -> DataFrame:
    """(query, subject, label, score) that hold the ``kept`` best subjects of each query, by score and then id."""
    _, first, _, second = passes(built(subjects, width), queries, width, kept)
    return first.unionByName(second)


def pairs_compared(index: Index, queries: DataFrame, width: int, kept: int) -> DataFrame:
    """(pass, visits, pairs): blocks that queries visit, and the pairs that are compared there."""
    early, _, late, _ = passes(index, queries, width, kept)
    sizes = index.rows.groupBy("block").agg(F.count("*").alias("n"))
    both = early.withColumn("pass", F.lit(1)).unionByName(late.withColumn("pass", F.lit(2))).groupBy("pass", "block").agg(F.count("*").alias("visits"))
    return both.join(sizes, "block").groupBy("pass").agg(F.sum("visits").alias("visits"), F.sum(F.col("visits") * F.col("n")).alias("pairs"))
