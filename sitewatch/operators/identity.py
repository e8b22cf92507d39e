"""Identities over time: observations under several keys that look alike are one identity, and share their alerts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.operators.similarity import FACE
from sitewatch.sources.store import checkpointed
from sitewatch.sources.views import safety_events, table

#: How long a look lives, in seconds; two of one identity are at least as similar as a known face.
LIVES, ALIKE = 2 * 86_400, FACE
#: Rows of a block, about: a task compares two blocks at a time. Each row goes to as many tasks as its slice has blocks, so large blocks
#: are what keeps the shuffle small; two of them are some 20 MB of looks of 64 numbers.
BLOCK = 32_768
#: Numbers of single precision differ from the cosine by less than this.
MARGIN = 1e-4
ROUNDS = 60


def observations(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, at, key, matched, violation, embedding): every vector as the look of the event of its number.

    A third of them is matched to a person; the key of the others is what their camera calls them.
    """
    e = safety_events(spark, d)
    matched = F.when(F.col("k") % 3 == 0, F.concat(F.lit("person:"), F.col("user_id").cast("string")))
    base = F.concat(F.lit("unmatched:"), "camera_id", F.lit(":"), F.col("user_id").cast("string"))
    looks = table(spark, d, "embeddings").select(F.col("vec_id").alias("event_id"), "embedding")
    e = e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.coalesce(matched, base).alias("key"), matched.isNotNull().alias("matched"), F.when(F.col("is_violation"), F.col("event_type")).alias("violation"))
    return e.join(looks, "event_id")


def _blocked(rows: DataFrame, lives: int, block: int) -> DataFrame:
    """Rows with their slice of time, their block in it, and the number of blocks there."""
    rows = rows.withColumn("slice", F.floor(F.col("at") / (lives * 1_000_000)))
    sizes = rows.groupBy("slice").agg(F.ceil(F.count("*") / block).alias("blocks"))
    return rows.join(sizes, "slice").withColumn("block", F.pmod(F.xxhash64("event_id"), F.col("blocks")))


def _units(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    x = column.flatten().to_numpy().reshape(len(column), -1).astype(float)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _best(own: pa.Table, earlier: pa.Table, lives: int, alike: float) -> Iterator[tuple[int, float, int, int]]:
    """(row, score, time, id) of the best earlier looks of each row of ``own`` in a block of earlier ones, one a stretch of these.

    Products in single precision leave out all pairs that are clearly not alike; the others' cosines are exact.
    """
    if not own.num_rows or not earlier.num_rows:
        return
    at, ids = (own[c].to_numpy() for c in ("at", "event_id"))
    b_at, b_ids = (earlier[c].to_numpy() for c in ("at", "event_id"))
    mine, looks = _units(own["embedding"]), _units(earlier["embedding"])
    # by time, so that only stretches in which an earlier look lives meet
    order, rank = np.lexsort((ids, at)), np.lexsort((b_ids, b_at))
    at, ids, mine, b_at, b_ids, looks = at[order], ids[order], mine[order], b_at[rank], b_ids[rank], looks[rank]
    rough, rough_looks = mine.astype(np.float32), looks.astype(np.float32)
    for lo in range(0, len(at), 512):
        hi = min(lo + 512, len(at))
        first, end = np.searchsorted(b_at, at[lo] - lives * 1_000_000), np.searchsorted(b_at, at[hi - 1], "right")
        for a in range(first, end, 4_096):
            b = min(a + 4_096, end)
            i, j = np.nonzero(rough[lo:hi] @ rough_looks[a:b].T >= alike - MARGIN)
            i, j = i + lo, j + a
            before = ((b_at[j] < at[i]) | ((b_at[j] == at[i]) & (b_ids[j] < ids[i]))) & (b_at[j] >= at[i] - lives * 1_000_000)
            i, j = i[before], j[before]
            for part in range(0, len(i), 65_536):
                x, y = i[part : part + 65_536], j[part : part + 65_536]
                scores = np.round(np.einsum("nd,nd->n", mine[x], looks[y]), 9)
                # of a row's best scores the first by time and id; earlier parts come first
                best = np.lexsort((y, -scores, x))
                best = best[np.concatenate(([True], x[best][1:] != x[best][:-1]))]
                best = best[scores[best] >= alike]
                yield from zip(ids[x[best]].tolist(), scores[best].tolist(), b_at[y[best]].tolist(), b_ids[y[best]].tolist())


def links(rows: DataFrame, lives: int = LIVES, alike: float = ALIKE, block: int = BLOCK) -> DataFrame:
    """(event_id, score, seen_id): each observation's most similar earlier one that is still alive.

    ``rows``: event_id, at in microseconds, embedding. A look lives ``lives`` seconds, so only two neighbouring slices of time meet. A slice is cut
    into blocks of about ``block`` rows, and a task compares one block with one block, however many rows a slice holds; the best of a row's
    blocks is one aggregation. Scores are cosines to nine places; of equal ones the earliest by (at, event_id) stands. Rows without id or
    time, and vectors that are null, of no length or with a null or non-finite component, have and are no link. Vectors of
    different lengths aren't compared. An id has one row; an empty table has no links.
    """
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sound = F.col("event_id").isNotNull() & F.col("at").isNotNull() & (F.sqrt(square) > 1e-8) & (square < float("inf"))
    rows = _blocked(rows.where(sound).select("event_id", "at", "embedding", F.size("embedding").alias("width")), lives, block)
    sizes = rows.select("slice", "blocks").distinct()
    meets = F.explode(F.array("slice", F.col("slice") + 1))
    seen = rows.select("event_id", "at", "embedding", "width", F.col("block").alias("b"), F.col("slice").alias("from"), meets.alias("slice"))
    # each block of earlier rows for every block of its own slice and of the next one, and the other way round
    seen = seen.join(sizes, "slice").select("event_id", "at", "embedding", "width", "from", "b", "slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("a"))
    source = sizes.select(F.col("slice").alias("from"), F.col("blocks").alias("many"))
    own = rows.select("event_id", "at", "embedding", "width", "slice", F.col("block").alias("a"), F.explode(F.array("slice", F.col("slice") - 1)).alias("from"))
    own = own.join(source, "from").select("event_id", "at", "embedding", "width", "from", "slice", "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("many") - 1)).alias("b"))
    names = ["event_id", "score", "seen_at", "seen_id"]

    def pairs(both: pa.Table) -> pa.Table:
        mine = both["mine"]
        found = list(_best(both.filter(mine), both.filter(pc.invert(mine)), lives, alike))
        kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names)

    group = ["from", "b", "slice", "a", "width"]
    both = own.withColumn("mine", F.lit(True)).unionByName(seen.withColumn("mine", F.lit(False)))
    found = both.groupBy(*group).applyInArrow(pairs, "event_id bigint, score double, seen_at bigint, seen_id bigint")
    best = F.max_by(F.struct("score", "seen_id"), F.struct("score", (-F.col("seen_at")).alias("at"), (-F.col("seen_id")).alias("id")))
    return found.groupBy("event_id").agg(best.alias("x")).select("event_id", "x.score", "x.seen_id")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b): the smallest node that can be reached.

    Large and small stars in turn: a node's larger neighbours, then its smaller ones, are hung on its smallest one, until nothing
    changes; about the logarithm of the longest chain in rounds. A minimum is an aggregation with partial sums before the shuffle, and goes
    back by a join that Spark splits where one node has many neighbours; no node's neighbours are gathered.
    """
    edges = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    known = state(edges)
    for _ in range(ROUNDS):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("b")).where("m <> b").select(F.col("m").alias("a"), "b").distinct()
        edges = checkpointed(small)
        if (now := state(edges)) == known:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())
        known = now
    raise RuntimeError(f"components are not settled after {ROUNDS} rounds")


def resolved(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, identity) of all keys of ``rows``, given the links of their observations.

    Keys with a link between their observations are one identity. Its name is the key of the latest observation that was matched to a person,
    else that of its first observation, by (at, event_id); a null time comes first.
    """
    keys = rows.select("event_id", "key")
    ends = found.join(keys.withColumnRenamed("key", "a"), "event_id").join(keys.select(F.col("event_id").alias("seen_id"), F.col("key").alias("b")), "seen_id")
    roots = components(ends.select("a", "b"))
    order = F.struct("at", "event_id")
    # of a key's rows only the first and the latest can name its identity
    ranges = rows.groupBy("key", "matched").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    ranges = ranges.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    person = F.max_by("key", F.when(F.col("matched"), F.col("last")))
    named = ranges.groupBy("root").agg(F.coalesce(person, F.min_by("key", "first")).alias("identity"))
    return ranges.select("key", "root").distinct().join(named, "root").select("key", "identity")


def st07_identities(spark: SparkSession, d: str) -> DataFrame:
    """Each observation with the earlier one it was linked to, and its identity once all links are known.

    Every live look is compared, not only the latest one of each identity; so a link that depends on the order of aliases isn't lost, and the
    aliases need no state that one task would have to hold.
    """
    rows = observations(spark, d)
    found = checkpointed(links(rows))
    return rows.select("event_id", "key").join(found, "event_id", "left").join(resolved(rows, found), "key").select("event_id", "key", "identity", "seen_id", F.round("score", 6).alias("score"))


def st07_merged_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Last alert of each identity and violation over all keys it had, and how many of them raised one."""
    rows = observations(spark, d)
    names = resolved(rows, checkpointed(links(rows)))
    alerts = rows.where("violation is not null").groupBy("key", "violation").agg(F.max("at").alias("at"))
    return alerts.join(names, "key").groupBy("identity", "violation").agg(F.max("at").alias("last_at"), F.count("*").alias("keys"))
