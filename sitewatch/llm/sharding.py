"""Balanced label propagation: linked rows move to one shard under byte quotas."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, running_total


#: A shard's capacity holds this many of the units that are placed one by one; so there are at most GRAIN for each shard.
GRAIN = 200


def balanced_shards(nodes: DataFrame, n_shards: int, rounds: int = 20, rows_per_bucket: int = 50_000) -> DataFrame:
    """Put ``nodes`` (size long, hub, further columns) into shards of near equal bytes.

    Rows of one hub are linked with each other (a star, so no pair is ever written). Labels start
    from a hash. In each round a hub's rows look at the shards of their neighbours, counted per
    (hub, shard), and those outside the hub's strongest shards ask to move there; a hub larger than
    a shard's capacity keeps as many shards as it fills. A shard accepts requests, closest hubs
    first, while they fit what its linked rows leave of its capacity. The rounds end when nobody moves (or
    after ``rounds``: the last step holds all the same). Then shards are evened by whole hubs, see
    ``_evened``: a shard's bytes differ from the mean by about a half percent where no row
    and no hub is larger than that. Adds ``shard`` and ``slot`` (0, 1, ... within a shard).

    Null hubs are links of nobody. Repeated rows are rows of their own. Equal sizes are ordered by hash. An
    empty table stays empty.
    """
    names = nodes.columns
    nodes = nodes.withColumn("_hub", F.coalesce(F.col("hub").cast("string"), F.concat(F.lit("alone "), F.monotonically_increasing_id())))
    nodes = nodes.withColumn("_tie", F.xxhash64(*[c for c in names if nodes.schema[c].dataType.typeName() != "map"]))
    nodes = checkpointed(nodes.withColumn("shard", F.pmod(F.col("_tie"), F.lit(n_shards)).cast("int")))
    count, total = nodes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    capacity = total / n_shards
    buckets = max(2, -(-count // (n_shards * rows_per_bucket)))

    for _ in range(rounds if count else 0):
        moves = _accepted_moves(nodes, capacity, buckets)
        moves = checkpointed(moves)
        if moves.isEmpty():
            break
        nodes = checkpointed(
            nodes.join(moves, ["_hub", "shard"], "left").withColumn("shard", F.coalesce("_to", "shard")).drop("_to")
        )
    return _evened(nodes, names, n_shards, capacity, buckets)


def _accepted_moves(nodes: DataFrame, capacity: float, buckets: int) -> DataFrame:
    """Cells (hub, shard) whose rows move, with the shard that takes them."""
    cells = nodes.groupBy("_hub", "shard").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    hub = Window.partitionBy("_hub")
    ranked = hub.orderBy(F.desc("n"), F.xxhash64("_hub", "shard"))
    cells = (
        cells.withColumn("hub_n", F.sum("n").over(hub))
        .withColumn("k", F.greatest(F.lit(1), F.ceil(F.sum("b").over(hub) / F.lit(max(capacity, 1.0)))).cast("int"))
        .where("hub_n > 1")
        .withColumn("rank", F.row_number().over(ranked))
        .withColumn("best", F.collect_list(F.when(F.col("rank") <= F.col("k"), F.col("shard"))).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    cells = checkpointed(cells)
    staying = cells.where("rank <= k").groupBy(F.col("shard").alias("_to")).agg(F.sum("b").alias("held"))
    asking = cells.where("rank > k").withColumn("_to", F.expr("best[cast(pmod(xxhash64(_hub, shard), size(best)) as int)]"))
    asking = asking.withColumn("_bucket", F.lit(64) - F.least(F.lit(63), F.log2(F.col("hub_n"))).cast("int")).withColumn(
        "_bucket", F.col("_bucket") * F.lit(buckets) + F.pmod(F.xxhash64("_hub"), F.lit(buckets)))
    asking = running_total(asking, ["_to"], "_bucket", ["_hub", "shard"], F.col("b"), "_asked")
    return (
        asking.join(F.broadcast(staying), "_to", "left")  # one row a shard
        .where(F.col("_asked") + F.coalesce("held", F.lit(0)) <= F.lit(capacity))
        .select("_hub", "shard", "_to")
    )


def _evened(nodes: DataFrame, names: list[str], n_shards: int, capacity: float, buckets: int) -> DataFrame:
    """Even the shards' bytes by units, then number the rows.

    A unit is a hub with all its rows, whose label is the shard that holds most of it; a hub larger than a shard's
    capacity is taken row by row. Units over 1 / ``GRAIN`` of the capacity, at most ``GRAIN`` for each
    shard, are placed one by one on the driver, the largest first: by their label if they fit, else where most is
    free. The small ones keep their label up to the capacity, and what is over is dealt to the free
    space that is left, so a shard misses its share by about one small unit.
    """
    cells = nodes.groupBy("_hub", "shard").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    hubs = cells.groupBy("_hub").agg(
        F.sum("n").alias("_n"), F.sum("b").alias("_b"), F.max_by("shard", F.struct("b", (-F.col("shard")).alias("s"))).alias("_label"))
    whole = F.col("_b") <= F.lit(capacity)
    nodes = nodes.join(hubs, "_hub")
    nodes = nodes.withColumn("_unit", F.when(whole, F.col("_hub")).otherwise(F.concat_ws(" ", "_hub", F.col("_tie").cast("string"), F.monotonically_increasing_id().cast("string"))))
    nodes = nodes.withColumn("shard", F.when(whole, F.col("_label")).otherwise(F.col("shard"))).withColumn("_b", F.when(whole, F.col("_b")).otherwise(F.col("size")))
    nodes = checkpointed(nodes.withColumn("_n", F.when(whole, F.col("_n")).otherwise(F.lit(1))))
    units = nodes.groupBy("_unit").agg(F.first("_b").alias("_b"), F.first("_n").alias("_n"), F.first("shard").alias("shard"), F.min("_tie").alias("_tie"))
    grain = max(1.0, capacity / GRAIN)
    large = units.where(F.col("_b") > F.lit(grain)).collect()  # at most total / grain
    load = np.zeros(n_shards)
    places = []
    for u in sorted(large, key=lambda u: (-u["_b"], u["_tie"], u["_unit"])):
        to = u["shard"] if load[u["shard"]] + u["_b"] <= capacity else int(load.argmin())
        load[to] += u["_b"]
        places.append((u["_unit"], to))
    places = nodes.sparkSession.createDataFrame(places, "_unit string, _place int")

    small = units.where(F.col("_b") <= F.lit(grain))
    size_class = F.lit(40) - F.least(F.lit(40), F.log2(F.col("_b") + 1).cast("int"))
    salted = F.pmod(F.xxhash64("_unit"), F.lit(buckets))
    small = small.withColumn("_bucket", (F.when(F.col("_n") > 1, 0).otherwise(41) + size_class) * F.lit(buckets) + salted)
    order = [F.desc("_b"), "_unit"]
    small = checkpointed(running_total(small, ["shard"], "_bucket", order, F.col("_b"), "_upto"))
    room = F.element_at(F.array(*[F.lit(float(capacity - x)) for x in load]), F.col("shard") + 1)
    kept, over = small.where(F.col("_upto") <= room), small.where(F.col("_upto") > room)
    held = {r["shard"]: r["b"] for r in kept.groupBy("shard").agg(F.sum("_b").alias("b")).collect()}  # one row a shard
    ends, at = [], 0.0
    for s in range(n_shards):
        at += max(0.0, capacity - load[s] - held.get(s, 0))
        ends.append(at)
    due = max(1.0, capacity * n_shards - load.sum() - sum(held.values()))
    over = running_total(over.withColumn("_one", F.lit(0)), ["_one"], "_bucket", order, F.col("_b"), "_upto").drop("_one")
    middle = (F.col("_upto") - F.col("_b") / 2) * F.lit(at / due)
    free = F.array(*[F.lit(x) for x in ends])
    over = over.withColumn("shard", F.least(F.lit(n_shards - 1), F.size(F.filter(free, lambda e: e <= middle))).cast("int"))
    moved = checkpointed(over.select("_unit", F.col("shard").alias("_dealt")))
    rows = nodes.join(F.broadcast(places), "_unit", "left").join(moved, "_unit", "left")
    rows = rows.withColumn("shard", F.coalesce("_place", "_dealt", "shard")).withColumn("_bucket", F.pmod("_tie", F.lit(buckets)))
    rows = running_total(rows, ["shard"], "_bucket", ["_tie"], F.lit(1).cast("long"), "slot")
    return rows.select(*names, "shard", (F.col("slot") - 1).alias("slot"))


def document_shards(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Documents in shards of near equal bytes; equal texts are linked.

    A null text counts no bytes and is equal to other null texts, not to the empty text. Repeated rows, and rows
    without a doc_id, are rows of their own.
    """
    text = F.col("text")
    nodes = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("hub"),
    )
    return balanced_shards(nodes, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
