"""Hard negatives: every anchor's scores against all rows, sorted whole, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of anchors that go to all tasks at once; more anchors take more rounds.
ROUND = 16 << 20
#: Anchors whose scores against a batch stand in memory together.
BLOCK = 64
LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, q) of the rows that take part: q is floor(scale * x) of each component, as double, as a long."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q")
    )


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as longs; one beyond a long is its nearest end."""
    norm = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0.0)))
    most = norm(a) * norm(b)  # no partial sum is larger
    if most < 1 << 23:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, *LONG).astype(np.int64).reshape(len(a), len(b))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, components) of the vectors of each length, by id."""
    q = batch.column(2)
    lengths = np.diff(q.offsets.to_numpy())
    flat = q.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        at = at[np.argsort(ids[at], kind="stable")]
        yield ids[at], labels[at], flat[starts[at, None] + np.arange(n)]


class Best:
    """The first ``k`` (score descending, id ascending) of each slot, of all that was added."""

    def __init__(self, k: int, most: int = 1 << 18):
        self.k, self.most, self.parts, self.n = k, most, [], 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((slot, score, ids))
        self.n += len(slot)
        if self.n > self.most:
            self.parts = [self.first()]
            self.n = len(self.parts[0][0])
            self.most = max(self.most, 2 * self.n)

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return (np.empty(0, np.int64),) * 3
        slot, score, ids = (np.concatenate(x) for x in zip(*self.parts))
        at = np.lexsort((ids, ~score, slot))  # ~score falls as score rises, and can't overflow
        slot, score, ids = slot[at], score[at], ids[at]
        new = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        place = np.arange(len(slot)) - np.repeat(new, np.diff(np.append(new, len(slot))))
        return tuple(x[place < self.k] for x in (slot, score, ids))


def _sorted_scores(batches: Iterator[pa.RecordBatch], anchors: list[tuple]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor's number, id, label, then scores, ids and labels of a batch) sorted by score descending and id, for each anchor and batch."""
    for b in batches:
        for ids, labels, q in matrices(b):
            for numbers, a_ids, a_labels, a in anchors:
                if a.shape[1] != q.shape[1]:
                    continue
                for lo in range(0, len(a), BLOCK):
                    s = scores(a[lo : lo + BLOCK], q)
                    order = np.argsort(~s, axis=1, kind="stable")  # rows come by id
                    for i in range(len(s)):
                        yield numbers[lo + i], a_ids[lo + i], a_labels[lo + i], s[i][order[i]], ids[order[i]], labels[order[i]]


def _found(best: Best) -> Iterator[pa.RecordBatch]:
    slot, score, ids = best.first()
    for at in range(0, len(slot), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in (slot, score, ids)], ["slot", "score", "id"])


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each slot over all tasks, with their rank."""
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    Score: inner product of the components floor(256 * x). Positives: the first rows of the anchor's label but another vec_id, by score,
    ties by vec_id. Negatives of each: the first rows of another label with low * positive <= 100 * score <= high * positive.

    Every task sorts each anchor's scores against a batch of its rows, finds each positive's upper limit by binary search and reads on
    above the lower one; the firsts of all batches and tasks are merged. Rows stay where they are: anchors go to all tasks, at most
    ``ROUND`` bytes at once, and further ones in further rounds over the table.

    Rows with a null vec_id or label, a null vector or a null or non-finite component take no part. Vectors of different lengths aren't
    compared. A repeated row counts each time, but not as an anchor; rows of an anchor's vec_id are never its positives or negatives.
    Components and scores beyond a long are its nearest end. Other columns aren't read; an empty table, or one without anchors, gives no rows.
    """
    rows = quantised(rows)
    asked = rows.where(anchor).distinct()
    size = asked.agg(F.sum(F.size("q") * 8 + 24)).first()[0] or 0
    rounds = max(1, -(-size // ROUND))
    out = None
    for r in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(rounds)) == r) if rounds > 1 else asked
        got = _one_round(rows, part, positives, negatives, low, high)
        out = got if out is None else out.unionByName(got)
    return out


def _one_round(rows: DataFrame, asked: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    anchors, n = [], 0
    for b in asked.toArrow().combine_chunks().to_batches():
        for ids, labels, q in matrices(b):
            anchors.append((np.arange(n, n + len(ids)), ids, labels, q))
            n += len(ids)
    shared = context.broadcast(anchors)  # ROUND bytes at most
    owner = np.concatenate([x[1] for x in anchors]) if anchors else np.empty(0, np.int64)

    def same_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(positives)
        for number, own, label, s, ids, labels in _sorted_scores(batches, shared.value):
            at = np.flatnonzero((labels == label) & (ids != own))[:positives]
            best.add(np.full(len(at), number), s[at], ids[at])
        yield from _found(best)

    found = "slot long, score long, id long"
    chosen = _merged(rows.mapInArrow(same_label, found), positives).select("slot", "rank", "score", "id").toArrow()  # some for each anchor of the round
    slots = chosen["slot"].to_numpy() * positives + chosen["rank"].to_numpy() - 1
    limit = {int(s): int(x) for s, x in zip(slots, chosen["score"].to_numpy())}
    limits = context.broadcast(limit)

    def other_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, most = Best(negatives), limits.value
        for number, own, label, s, ids, labels in _sorted_scores(batches, shared.value):
            at = np.flatnonzero((labels != label) & (ids != own))
            s, ids = s[at], ids[at]
            for slot in range(number * positives, (number + 1) * positives):
                if (p := most.get(slot)) is None:
                    break
                upper, lower = high * p // 100, -(-low * p // 100)  # whole numbers within the limits
                first = len(s) - np.searchsorted(s[::-1], min(max(upper, LONG[0]), LONG[1]), "right") if upper >= LONG[0] else len(s)
                last = first + negatives
                keep = s[first:last] >= max(lower, LONG[0]) if lower <= LONG[1] else np.zeros(len(s[first:last]), bool)
                best.add(np.full(int(keep.sum()), slot), s[first:last][keep], ids[first:last][keep])
        yield from _found(best)

    names = rows.sparkSession.createDataFrame(
        pa.table({"slot": pa.array(slots, pa.int64()), "anchor_id": pa.array(owner[chosen["slot"].to_numpy()], pa.int64()), "positive_id": chosen["id"], "positive_score": chosen["score"]})
    )
    mined = _merged(rows.mapInArrow(other_label, found), negatives).join(names, "slot")
    return mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
