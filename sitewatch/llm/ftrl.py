"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")
SLOTS = 1 << 18
#: The score from which a document is predicted to be good.
THRESHOLD = 0.7
#: Largest expected number of labelled rows that a model is fitted on.
SAMPLE = 20_000


def features(texts: list[str | None], slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all words and word pairs of all texts, where each text's start, plus the end)."""
    found = [TOKENS.findall(t) if t else [] for t in texts]
    lengths = np.array([len(f) for f in found], np.int64)
    codes, words = pd.factorize(np.array([w for f in found for w in f], object))
    table = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words], np.uint64)
    one = table[codes] if len(codes) else np.zeros(0, np.uint64)
    mixed = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(29)
    doc = np.repeat(np.arange(len(texts)), lengths)
    same = doc[:-1] == doc[1:]
    both = np.concatenate((one % np.uint64(slots), mixed[same] % np.uint64(slots))).astype(np.int64)
    owner = np.concatenate((doc, doc[1:][same]))
    order = np.argsort(owner, kind="stable")
    return both[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))


def fit_ftrl(texts: list[str | None], labels: np.ndarray, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, slots: int = SLOTS) -> np.ndarray:
    """Weights (the last one the bias) by FTRL-proximal; a text's value in a slot is the slot's share of its n-grams, times 8."""
    z, n = np.zeros(slots + 1), np.zeros(slots + 1)
    rows = []
    for at in range(0, len(texts), 500):
        slot, ends = features(texts[at : at + 500], slots)
        for a, b in zip(ends[:-1], ends[1:]):
            i, count = np.unique(slot[a:b], return_counts=True)
            rows.append((np.append(i, slots).astype(np.int32), np.append(8.0 * count / max(1, b - a), 1.0).astype(np.float32)))

    def weights(i: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, x = rows[k]
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[k]) * x
            more = n[i] + g * g
            z[i] += g - (np.sqrt(more) - np.sqrt(n[i])) / alpha * w
            n[i] = more
    return weights(slice(None))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> DataFrame:
    """(text, y) of labelled training rows: those whose crc32(doc_id as text) mod 4 is not 2.

    Of more than ``most`` rows a hash of doc_id picks about that many, so the side that is broadcast
    has a proven bound. Null labels teach nothing. Of rows that share a doc_id the one of the smallest text teaches.
    """
    rows = labels.where(F.col(label).isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, most / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 16) -> np.ndarray:
    """Mean of the weights that ``parts`` tasks learn, each from its share of the sample; a slot is one row, so at most 2^18 + 1 of them come back.

    Without a labelled row all weights are zero and every score is one half.
    """
    sample = labelled_sample(docs, labels, label).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(parts)).cast("int"))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        w = fit_ftrl(rows["text"].tolist(), rows["y"].to_numpy(float))
        i = np.flatnonzero(w)
        return pd.DataFrame({"slot": np.append(i, -1), "w": np.append(w[i], 1.0)})

    got = sample.groupBy("part").applyInPandas(learn, "slot int, w double").groupBy("slot").agg(F.sum("w").alias("w")).toPandas()
    weights, at = np.zeros(SLOTS + 1), got[got["slot"] >= 0]
    if len(at):
        weights[at["slot"]] = at["w"] / float(got.loc[got["slot"] < 0, "w"].iloc[0])
    return weights


def scored(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted): each text's sparse dot product with the weights; an empty or null text has the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 MB

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = scores_of(b.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def scores_of(texts: list[str | None], w: np.ndarray) -> np.ndarray:
    scores = [np.zeros(0)]
    for at in range(0, len(texts), 500):
        slot, ends = features(texts[at : at + 500])
        sums = np.concatenate(([0.0], np.cumsum(w[slot])))
        mean = 8.0 * (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(1, np.diff(ends))
        scores.append(1 / (1 + np.exp(-np.clip(mean + w[-1], -35, 35))))
    return np.concatenate(scores)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels teach only where crc32(doc_id as text) mod 4 is not 2.

    A row for each row of ``docs``, scored by its own text; an empty or null text has the bias alone, a null doc_id is not held out.
    """
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return scored(docs, train(docs, labels)).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows predicted to be good, with all their columns; rows are scored where they lie, without a shuffle.

    Each row is scored by its own text, also an empty or null one; of repeated rows all stay or go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # 2 MB

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array(scores_of(texts, shared.value) >= threshold))

    return docs.mapInArrow(each, docs.schema)
