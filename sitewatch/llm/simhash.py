"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, numbered

BITS = 64


def simhash(text: str | bytes | None, words: int = 4, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 of all shingles of ``words`` words, 0 without a word."""
    if not text:
        return 0
    tokens = (text.encode() if isinstance(text, str) else text).lower().split()  # bytes: A-Z and ASCII space alone
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + 65_536], ends[at : at + 65_536])], ">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the signed 64-bit SimHash of each text; a null text counts as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(each, f"doc_id {kind}, fp bigint")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how many have both bits set for each pair of bits; 4,096 sums leave each task."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            bits = np.unpackbits(np.asarray(b.column(0)).astype(">i8").view(np.uint8)).reshape(-1, BITS)[:, ::-1].astype(np.float32)
            both, n = both + (bits.T @ bits).astype(np.int64), n + len(bits)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(-1, BITS * BITS), "n": np.concatenate(([n], both.ravel()))})

    rows = fps.select("fp").mapInArrow(sums, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    got = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        got[r["cell"] + 1] = r["n"]
    return int(got[0]), got[1:].reshape(BITS, BITS)


def bit_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Bits in ``m`` groups of near equal size; each starts from a free bit and takes the most correlated ones."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr, free, groups = np.abs(cov / np.outer(sd, sd)), set(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, groups))) // (m - k)
        group = [max(free, key=lambda i: (corr[i, sorted(free)].sum(), -i))]
        free -= set(group)
        while len(group) < size:
            best = max(free, key=lambda i: (corr[i, group].sum(), -i))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1: no probe) that sum to ``total`` at the least cost; costs[i][r + 1] is group i's at r."""
    best = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for r1, x in enumerate(c):
                new = (cost + x, [*chosen, r1 - 1])
                if used + r1 not in step or new < step[used + r1]:
                    step[used + r1] = new
        best = step
    return best[total + len(costs)]


def plan_probes(fps: DataFrame, radius: int, group_counts: tuple[int, ...] = (2, 3, 4), probe_cost: float = 20.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group that is probed.

    Correlated bits share a group. The candidates of a group at radius 0 are counted over all
    fingerprints; farther radii follow from the bits' set shares. Dynamic programming allots
    thresholds summing to radius - groups + 1, so a pair within ``radius`` meets in some group.
    """
    n, both = bit_statistics(fps)
    if not n:
        return []
    layouts = {m: bit_groups(n, both, m) for m in group_counts}
    keys = [(m, i, _mask(g)) for m, groups in layouts.items() for i, g in enumerate(groups)]
    spread = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.lit(k).alias("mask")) for m, i, k in keys])).alias("g"))
    same = spread.groupBy("g.m", "g.i", F.expr("fp & g.mask").alias("key")).count().groupBy("m", "i").agg(F.sum(F.col("count") * F.col("count")).alias("s")).collect()
    share = {(r["m"], r["i"]): r["s"] / n / n for r in same}
    q = np.diag(both) / n
    plans = []
    for m, groups in layouts.items():
        costs = []
        for i, g in enumerate(groups):
            law = np.array([1.0])
            for bit in g:
                differ = 2 * q[bit] * (1 - q[bit])
                law = np.convolve(law, [1 - differ, differ])
            near = np.cumsum(law) / max(law[0], 1e-30) * share[m, i]
            c = [0.0]
            for r in range(radius - m + 1 + m):
                c.append(n * probe_cost * sum(comb(len(g), x) for x in range(r + 1)) + n * n * min(1.0, near[min(r, len(near) - 1)]) / 2)
            costs.append(c)
        cost, chosen = allocate(costs, radius - m + 1)
        plans.append((cost, m, [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(plans, key=lambda x: x[:2])[2]


def _mask(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def near_pairs(fps: DataFrame, radius: int) -> DataFrame:
    """Pairs (u < v) of the distinct ``fp`` that differ in 1 to ``radius`` bits; a pair may come twice.

    Every fingerprint is indexed once a probed group, under its masked value, and probes that value
    with up to the group's threshold of bits flipped; the join verifies the distance itself.
    """
    plan = plan_probes(fps, radius)
    if not plan:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    index = probes = None
    for i, (bits, threshold) in enumerate(plan):
        mask = F.lit(_mask(bits))
        flips = [_mask(c) for r in range(threshold + 1) for c in combinations(bits, r)]
        one = fps.select(F.lit(i).alias("g"), F.col("fp").bitwiseAND(mask).alias("key"), F.col("fp").alias("u"))
        many = fps.select(F.lit(i).alias("g"), F.explode(F.array(*map(F.lit, flips))).alias("flip"), F.col("fp").alias("v"))
        many = many.select("g", F.col("v").bitwiseAND(mask).bitwiseXOR(F.col("flip")).alias("key"), "v")
        index, probes = (index.unionByName(one), probes.unionByName(many)) if index is not None else (one, many)
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    return index.join(probes, ["g", "key"]).where(near).select("u", "v")


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints link at ``radius`` bits or fewer.

    Equal fingerprints are one class with its smallest doc_id; only classes are joined, so copies
    never become pairs. Texts without a word have fingerprint zero and link like any other. A row for each row of ``docs``;
    a null doc_id names a component only where it has no other.
    """
    prints = checkpointed(fingerprints(docs))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(near_pairs(classes, radius))  # by fingerprint value
    first = linked.join(classes, linked.node == classes.fp).groupBy("component").agg(F.min("first").alias("component_id"))
    named = linked.join(first, "component").select(F.col("node").alias("fp"), "component_id")
    # a table of its own: the last join then shuffles both sides, and Spark can split a hot fingerprint's rows
    classes = checkpointed(classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with all its columns.

    Rows of the same doc_id and text are one document and one of them stays. Other texts of that doc_id
    are documents of their own. A null doc_id comes after all others, so such a row stays only if its
    group has no row with a doc_id, and then one of them does.
    """
    rows = numbered(docs)
    if rows is not None:
        rows = rows.dropDuplicates(["_n"])
        groups = near_duplicates(rows.select(F.col("_n").alias("doc_id"), "text"), radius)
        return rows.join(groups.where("doc_id = component_id").select(F.col("doc_id").alias("_n")), "_n", "left_semi").select(docs.columns)
    groups = near_duplicates(docs, radius)
    return docs.join(groups.where("doc_id = component_id").select("doc_id").distinct(), "doc_id", "left_semi")
