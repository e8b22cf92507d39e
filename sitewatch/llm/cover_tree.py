"""Exact cosine threshold join by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components

#: Most pivots; with 64 to 1,024 components they stay within 256 MB.
PIVOTS = 32_768
LEAF = 256
#: Components of vectors on one side of a task: 16,384 rows of 64 components, 1,024 of 1,024.
SIDE = 1 << 20
#: More than the rounding of a distance that comes from a dot product.
SLACK = 1e-6


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of unit vectors ``x`` from the unit vector ``c``."""
    return np.sqrt(np.maximum(2 - 2 * (x @ c), 0))


class CoverTree:
    """Nested levels whose radii halve: every point of a node lies within the node's radius of its centre.

    Nodes are slices of one permuted matrix of unit vectors. A node's centre is also the centre of its first child.
    """

    def __init__(self, x: np.ndarray):
        self.order, self.lo, self.hi, self.center, self.radius, self.children = np.arange(len(x)), [], [], [], [], []
        if len(x):
            d = _distances(x, x[0])
            self._node(x, np.arange(len(x)), x[0], d, float(d.max()), 0)
        self.x = x[self.order]

    def _node(self, x: np.ndarray, rows: np.ndarray, center: np.ndarray, d: np.ndarray, scale: float, at: int) -> int:
        me, radius = len(self.lo), float(d.max())
        self.lo.append(at)
        self.hi.append(at + len(rows))
        self.center.append(center)
        self.radius.append(radius)
        self.children.append([])
        self.order[at : at + len(rows)] = rows
        if len(rows) <= LEAF or radius < SLACK:
            return me
        half = scale / 2
        while half >= radius:
            half /= 2
        owner, nearest, centers = np.zeros(len(rows), np.int64), d.copy(), [center]
        while nearest.max() > half and len(centers) < 64 and LEAF * len(centers) < 2 * len(rows):  # the farthest point is a centre of the next level
            centers.append(x[int(nearest.argmax())])
            new = _distances(x, centers[-1])
            closer = new < nearest
            owner[closer], nearest[closer] = len(centers) - 1, new[closer]
        for k, c in enumerate(centers):
            own = np.flatnonzero(owner == k)
            if len(own):
                self.children[me].append(self._node(x[own], rows[own], c, nearest[own], half, at))
                at += len(own)
        return me


def node_pairs(a: CoverTree, b: CoverTree, limit: float) -> Iterator[tuple[int, int, bool]]:
    """(node, node, all): pairs that may hold points within ``limit``; all others are pruned by the covering radii.

    all: the radii prove that every point of one is within ``limit`` of every point of the other. Where
    they don't, the nodes are leaves. Of one tree with itself, each unordered pair comes once.
    """
    stack = [(0, 0)] if a.lo and b.lo else []
    while stack:
        i, j = stack.pop()
        if a is b and a.lo[i] >= b.hi[j]:
            continue
        apart, radii = float(_distances(a.center[i][None, :], b.center[j])[0]), a.radius[i] + b.radius[j]
        if apart > limit + radii + SLACK:
            continue
        if apart + radii < limit - SLACK and (a is not b or i == j or a.hi[i] <= b.lo[j]):
            yield i, j, True
        elif a.children[i] and (not b.children[j] or a.radius[i] >= b.radius[j]):
            stack += [(c, j) for c in a.children[i]]
        elif b.children[j]:
            stack += [(i, c) for c in b.children[j]]
        else:
            yield i, j, False


def _unit(batch: pa.RecordBatch, name: str) -> np.ndarray:
    x = np.stack(batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)).astype(float)
    return x / np.sqrt((x * x).sum(1))[:, None]


def links(vectors: DataFrame, threshold: float = 0.9, rows_per_block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(per vector number of direct links, edges that span the components) among ``vectors``.

    ``vectors``: rep long, weight long, v array<double> of one length, all different as lists. The
    pivots, about one for every half block of rows, are the centres of the first level. A vector goes
    to the cell of its nearest pivot and visits the cells that a hyperplane bound can't exclude, but of
    two cells only one's vectors visit the other. Cells larger than ``rows_per_block`` (``SIDE``
    components unless given) are cut into blocks by hash. One task joins a block of a cell's
    own vectors with a block of its own or visiting vectors: it builds a cover tree on each side,
    walks both at once and checks what remains by cosine in double precision.
    """
    spark, limit = vectors.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    rows_per_block = rows_per_block or max(64, SIDE // width)
    share = min(1.0, min(PIVOTS, 2.0 * n / rows_per_block) / max(1, n))
    pivots = vectors.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("v").limit(2 * PIVOTS).collect()
    centres = np.array([r["v"] for r in pivots], float)
    if len(centres):
        centres = np.unique(centres / np.sqrt((centres * centres).sum(1))[:, None], axis=0)
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = _unit(part, "v")
                if not len(c):
                    row, cell, home = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
                else:
                    d2 = np.maximum(2 - 2 * x @ c.T, 0)
                    own = d2.argmin(1)
                    gap = d2 - d2[np.arange(len(x)), own][:, None]
                    apart = 2 * np.sqrt(np.maximum(2 - 2 * c[own] @ c.T, 0))
                    row, cell = np.nonzero(gap <= limit * apart + 1e-9)
                    home = cell == own[row]
                    visits = home | (((cell + own[row]) % 2 == 1) == (cell > own[row]))  # half of the cells, whichever the own one is
                    row, cell, home = row[visits], cell[visits], home[visits]
                took = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([took.column(0), took.column(1), took.column(2), pa.array(cell.astype(np.int32)), pa.array(home)], ["rep", "weight", "v", "cell", "home"])

    placed = checkpointed(vectors.select("rep", "weight", "v").mapInArrow(place, "rep bigint, weight bigint, v array<double>, cell int, home boolean"))
    sizes = placed.groupBy("cell", "home").agg(F.count("*").alias("n")).groupBy("cell").agg(
        F.ceil(F.sum(F.when(F.col("home"), F.col("n")).otherwise(0)) / rows_per_block).cast("int").alias("own"),
        F.ceil(F.sum(F.when(~F.col("home"), F.col("n")).otherwise(0)) / rows_per_block).cast("int").alias("guest"))
    rows = placed.join(F.broadcast(sizes.where("own > 0")), "cell")  # a row a cell, at most twice PIVOTS
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("own")).otherwise(F.col("guest"))).cast("int")
    own_tasks = F.expr("transform(sequence(0, own - 1), o -> struct(least(o, block) as a, 0 as guests, greatest(o, block) as b))")
    if_home = F.when(F.col("guest") > 0, F.concat(own_tasks, F.expr("transform(sequence(0, guest - 1), g -> struct(block as a, 1 as guests, g as b))"))).otherwise(own_tasks)
    if_guest = F.expr("transform(sequence(0, own - 1), o -> struct(o as a, 1 as guests, block as b))")
    rows = rows.withColumn("block", block).withColumn("task", F.explode(F.when(F.col("home"), if_home).otherwise(if_guest)))
    rows = rows.select("cell", "task.*", "block", "home", "rep", "weight", "v")
    found = checkpointed(rows.groupBy("cell", "a", "guests", "b").applyInPandas(lambda g: _task(g, threshold, limit), "u bigint, w bigint, n bigint"))
    counts = found.where("n > 0").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    return counts, found.where("w is not null").select("u", F.col("w").alias("v"))


def _task(g: pd.DataFrame, threshold: float, limit: float) -> pd.DataFrame:
    """Links between the two blocks of a task: n for u from its links here, or w: the next one of u's component here."""
    guests, a, b = int(g["guests"].iloc[0]), int(g["a"].iloc[0]), int(g["b"].iloc[0])
    left = g[g["home"] & (g["block"] == a)]
    right = g[~g["home"]] if guests else g[g["home"] & (g["block"] == b)]
    same = not guests and a == b
    sides = [left] if same else [left, right]
    raw = [np.stack(s["v"].to_numpy()).astype(float) if len(s) else np.zeros((0, 1)) for s in sides]
    norm = [np.sqrt((x * x).sum(1)) for x in raw]
    trees = [CoverTree(x / m[:, None]) if len(x) else CoverTree(x) for x, m in zip(raw, norm)]
    ids = [s["rep"].to_numpy() for s in sides]
    weights = [s["weight"].to_numpy() for s in sides]
    ta, tb = trees[0], trees[-1]
    base = len(ids[0]) if not same else 0
    reps, weight = np.concatenate(ids), np.concatenate(weights)
    got, parent, top = np.zeros(len(reps), np.int64), np.arange(len(reps)), np.arange(len(reps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j, whole in node_pairs(ta, tb, limit):
        ra, rb = ta.order[ta.lo[i] : ta.hi[i]], tb.order[tb.lo[j] : tb.hi[j]]
        if whole:
            got[ra] += weight[rb + base].sum()
            if same and i == j:
                got[ra] -= weight[ra]
            else:
                got[rb + base] += weight[ra].sum()
            p, q = np.concatenate((ra, np.repeat(ra[:1], len(rb)))), np.concatenate((np.repeat(rb[:1], len(ra)), rb)) + base
        else:
            p, q = np.nonzero(ta.x[ta.lo[i] : ta.hi[i]] @ tb.x[tb.lo[j] : tb.hi[j]].T >= threshold - SLACK)
            p, q = ra[p], rb[q]
            if same and i == j:
                p, q = p[p < q], q[p < q]
            sure = np.concatenate([np.zeros(0, bool), *(  # cosine in double precision from the vectors as they are
                (raw[0][p[k : k + 65_536]] * raw[-1][q[k : k + 65_536]]).sum(1) / norm[0][p[k : k + 65_536]] / norm[-1][q[k : k + 65_536]] >= threshold
                for k in range(0, len(p), 65_536))])
            p, q = p[sure], q[sure] + base
            np.add.at(got, p, weight[q])
            np.add.at(got, q, weight[p])
        if len(p):
            for k in np.unique(np.concatenate((p, q))).tolist():
                top[k] = root(k)
            apart = top[p] != top[q]
            for u, v in np.unique(np.stack((top[p[apart]], top[q[apart]])), axis=1).T.tolist():
                x, y = root(u), root(v)
                parent[max(x, y)] = min(x, y)
    tops = np.array([root(i) for i in range(len(reps))], np.int64)
    moved = np.flatnonzero(tops != np.arange(len(reps)))
    counted = np.flatnonzero(got)
    return pd.DataFrame({
        "u": np.concatenate((reps[counted], reps[moved])),
        "w": pd.array([None] * len(counted) + reps[tops[moved]].tolist(), dtype="Int64"),
        "n": np.concatenate((got[counted], np.zeros(len(moved), np.int64))),
    })


def near_vectors(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``rows`` (vec_id, embedding).

    Links are pairs of other rows with a cosine of ``threshold`` or more. Equal vectors are one class
    that is joined once, known by a number of its own and named by its smallest vec_id at the end, so an
    id that stands on two vectors links neither with the other's. A repeated row is a row of its own, and
    its copies are links. A null vec_id comes after all others: it names a component that has no other. A
    vector that is null, empty, zero or not finite links with nothing; vectors of another length than
    most are compared among their own length.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.size("embedding") > 0
    fine &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    fine &= F.exists("embedding", lambda x: x != 0)
    rows = checkpointed(rows.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), v).alias("v")))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    classes = checkpointed(checkpointed(classes).withColumn("rep", F.monotonically_increasing_id()))
    sizes = [r["k"] for r in classes.select(F.size("v").alias("k")).distinct().collect()]
    counts = edges = None
    for k in sorted(sizes):
        c, e = links(classes.where(F.size("v") == k), threshold)
        counts, edges = (counts.unionByName(c), edges.unionByName(e)) if counts is not None else (c, e)
    if counts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    named = checkpointed(components(edges).select(F.col("node").alias("rep"), "component"))
    first = named.join(classes.select("rep", "first"), "rep").groupBy("component").agg(F.min("first").alias("smallest"))
    named = named.join(first, "component").select("rep", "smallest", F.lit(True).alias("linked"))
    # a class of copies is the component of its smallest id
    classes = classes.join(counts, "rep", "left").join(named, "rep", "left")
    classes = classes.select(
        "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.when(F.col("linked"), F.col("smallest")).otherwise(F.col("first")).alias("component_id"))
    out = rows.join(classes, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
