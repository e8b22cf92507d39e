"""Joins of boxes within a frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewatch.functions.geometry import area, bottom_centre, centre_inside, containment, inside_polygon, iou
from sitewatch.sources.views import boxes


#: Least confidence of a body point, sides of a lying box, angle of a bent back, share of a crouching body, reach of a hand.
LEAST_CONFIDENCE, LYING, BENT, CROUCHING, REACH = 0.35, 1.25, 35.0, 0.45, 0.18
ZONE = [(100.0, 100.0), (500.0, 120.0), (450.0, 400.0), (80.0, 350.0)]


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Persons and items of a frame: one shuffle brings a frame's few boxes together, and its pairs are unrolled from there."""
    one = F.struct("obj", "box", "score", "k")
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, one))
    both = boxes(spark, d).groupBy("frame").agg(of("person").alias("ps"), of("item").alias("is"))
    rows = both.select("frame", F.explode("ps").alias("a"), "is").select("frame", "a", F.explode("is").alias("b"))
    return rows.select("frame", F.col("a.obj").alias("person"), F.col("a.box").alias("p"), F.col("b.obj").alias("item"), F.col("b.box").alias("i"), F.col("b.score").alias("score"), F.col("a.k").alias("pk"), F.col("b.k").alias("ik"))


def j03_item_person(spark: SparkSession, d: str) -> DataFrame:
    """Items with the persons they lie on: centre inside, or enough containment or overlap."""
    touch = centre_inside("i", "p") | (F.greatest(containment("i", "p"), containment("p", "i")) >= 0.1) | (iou("p", "i") >= 0.1)
    return _pairs(spark, d).where(touch).select("frame", "person", "item", F.round(iou("p", "i"), 6).alias("iou"))


def j05_best_person(spark: SparkSession, d: str) -> DataFrame:
    """The person of largest overlap for each item, from 0.3 on; the first keeps ties."""
    w = Window.partitionBy("frame", "item").orderBy(F.desc("overlap"), "person")
    rows = _pairs(spark, d).withColumn("overlap", F.round(iou("p", "i"), 9)).where("overlap >= 0.3")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("frame", "item", "person")


def j04_first_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """For each person the first item, by its number, of which three tenths lie on the person."""
    rows = _pairs(spark, d).where(containment("i", "p") >= 0.3)
    return rows.groupBy("frame", "person").agg(F.min("item").alias("item"))


def j06_greedy_matches(spark: SparkSession, d: str) -> DataFrame:
    """Items and persons one to one, by falling score: of a frame's sorted pairs each is taken whose person and item are both free."""
    inside = centre_inside("i", "p", 0.08)
    score = F.when(inside, 1.5).otherwise(0.0) + 2 * containment("i", "p") + iou("p", "i") + 0.2 * F.col("score")
    rows = _pairs(spark, d).where(inside | (containment("i", "p") >= 0.6) | (iou("p", "i") > 0))
    rows = rows.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct((-F.round(score, 9)).alias("s"), "item", "person"))).alias("pairs"))
    none = F.array().cast("array<struct<s:double,item:bigint,person:bigint>>")
    free = lambda taken, x: ~F.exists(taken, lambda t: (t["item"] == x["item"]) | (t["person"] == x["person"]))
    taken = F.aggregate("pairs", none, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return rows.select("frame", F.explode(taken).alias("t")).select("frame", "t.item", "t.person", (-F.col("t.s")).alias("score"))


def assigned(cost: np.ndarray) -> list[int]:
    """The column of each row in an assignment of least total cost (rows up to columns): shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v, row_of, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while row_of[j]:
            used[j] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[row_of[j] - 1, free - 1] - u[row_of[j]] - v[free]
            closer = slack < least[free]
            least[free[closer]], way[free[closer]] = slack[closer], j
            step, to = least[free].min(), int(free[least[free].argmin()])
            u[row_of[used]] += step
            v[used] -= step
            least[free] -= step
            j = to
        while j:
            row_of[j], j = row_of[way[j]], int(way[j])
    out = [0] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def j07_assignments(spark: SparkSession, d: str, gate: float = 0.7) -> DataFrame:
    """Persons and items of a frame, assigned at the least total cost of place and looks; pairs above the gate are none."""
    cost = 0.4 * (1 - iou("p", "i")) + 0.6 * F.abs(F.col("pk") - F.col("ik")) / 100
    rows = _pairs(spark, d).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("person", "item", cost.alias("cost")))).alias("pairs"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for frame, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ps, its = sorted({x["person"] for x in pairs}), sorted({x["item"] for x in pairs})
                c = np.array([x["cost"] for x in pairs]).reshape(len(ps), len(its))
                turned = len(ps) > len(its)
                for i, j in enumerate(assigned(c.T if turned else c)):
                    i, j = (j, i) if turned else (i, j)
                    out.append((frame, ps[i], its[j], float(c[i, j]), bool(c[i, j] <= gate)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], ["frame", "person", "item", "cost", "matched"])

    return rows.mapInArrow(each, "frame bigint, person bigint, item bigint, cost double, matched boolean")


def j07_assignment_costs(spark: SparkSession, d: str) -> DataFrame:
    """The least total cost of each frame."""
    return j07_assignments(spark, d).groupBy("frame").agg(F.round(F.sum("cost"), 6).alias("cost"))


def point(i: int) -> Column:
    """A body point that is sure enough, or null; the test tables' points follow from the box and the event."""
    w, h = F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1")
    x, y = F.col("box.x1") + (i * 37 + F.col("k") * 13) % w, F.col("box.y1") + (i * 53 + F.col("k") * 7) % h
    return F.when(((F.col("k") * 3 + i * 17) % 100 >= 100 * LEAST_CONFIDENCE) & (x > 0) & (y > 0), F.struct(x.alias("x"), y.alias("y")))


def midpoint(a: Column, b: Column) -> Column:
    """Between two points; of one point alone, that."""
    both = F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))
    return F.when(a.isNotNull() & b.isNotNull(), both).otherwise(F.coalesce(a, b))


def _persons(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).where("kind = 'person'")


def s19_pose_status(spark: SparkSession, d: str) -> DataFrame:
    """Fallen by the box, bent by the back's angle, crouching by the body's span, else standing."""
    w, h = F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1")
    rows = _persons(spark, d).select("frame", "obj", w.alias("w"), h.alias("h"), midpoint(point(5), point(6)).alias("s"), midpoint(point(11), point(12)).alias("hip"), midpoint(point(15), point(16)).alias("a"))
    angle = F.degrees(F.atan2(F.abs(F.col("s.x") - F.col("hip.x")), F.greatest(F.abs(F.col("s.y") - F.col("hip.y")), F.lit(1.0))))
    status = F.when(F.col("w") / F.col("h") >= LYING, "fallen").when(angle >= BENT, "bending").when(F.abs(F.col("a.y") - F.col("s.y")) < F.col("h") * CROUCHING, "crouching").otherwise("standing")
    return rows.select("frame", "obj", status.alias("status"))


def s20_hand_near_mouth(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("box.y2") - F.col("box.y1")
    near = lambda p: F.hypot(p["x"] - F.col("nose.x"), p["y"] - F.col("nose.y")) <= REACH * F.col("h")
    rows = _persons(spark, d).select("frame", "obj", h.alias("h"), point(0).alias("nose"), point(9).alias("l"), point(10).alias("r"))
    return rows.select("frame", "obj", (F.coalesce(near(F.col("l")), F.lit(False)) | F.coalesce(near(F.col("r")), F.lit(False))).alias("near"))


def s21_midpoints(spark: SparkSession, d: str) -> DataFrame:
    return _persons(spark, d).select("frame", "obj", midpoint(point(5), point(6)).alias("m")).where("m is not null").select("frame", "obj", "m.x", "m.y")


def zone_anchor() -> Column:
    """Where a person stands: between both ankles if both are sure, else the middle of the box's lower side."""
    left, right = point(15), point(16)
    x, y = bottom_centre("box")
    return F.when(left.isNotNull() & right.isNotNull(), midpoint(left, right)).otherwise(F.struct(x.alias("x"), y.alias("y")))


def s18_zone_anchors(spark: SparkSession, d: str) -> DataFrame:
    return _persons(spark, d).select("frame", "obj", zone_anchor().alias("a")).select("frame", "obj", "a.x", "a.y")


def r02_overcrowded(spark: SparkSession, d: str, limit: int = 2) -> DataFrame:
    """Persons inside a zone that holds more than its limit: all that are inside are flagged."""
    # the anchor as a lambda's variable: as a column it would be written out at every use, and outgrow what Spark compiles
    inside = F.exists(F.array(zone_anchor()), lambda a: inside_polygon(a["x"], a["y"], ZONE))
    rows = _persons(spark, d).where(inside).select("frame", "obj")
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("frame"))).where(F.col("n") > limit).select("frame", "obj", "n")


def f13_sure_detections(spark: SparkSession, d: str) -> DataFrame:
    """Detections above the least confidence of their class."""
    least = F.when(F.col("kind") == "person", 0.8).when(F.col("k") % 3 == 0, 0.55).otherwise(0.7)
    return boxes(spark, d).where(F.col("score") >= least).select("frame", "obj")


def p08_overlays(spark: SparkSession, d: str) -> DataFrame:
    """What is drawn on a frame: its boxes with their kind, each place once, those without an area left out."""
    wide = lambda n: (F.floor(F.col(f"box.{n}") / 50) * 50).cast("bigint").alias(n)
    drawn = F.struct("kind", wide("x1"), wide("y1"), wide("x2"), wide("y2"))
    rows = boxes(spark, d).groupBy("frame").agg(F.array_distinct(F.flatten(F.collect_list(F.array(drawn, drawn)))).alias("boxes"))
    kept = F.filter("boxes", lambda b: (b["x2"] > b["x1"] + 100) & (b["y2"] > b["y1"] + 100))
    return rows.select("frame", kept.alias("kept")).where(F.size("kept") > 0).select("frame", F.size("kept").alias("n"), F.aggregate("kept", F.lit(0).cast("bigint"), lambda s, b: s + b["x1"] * 3 + b["y2"]).alias("mixed"))


def f12_large_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Persons that are large enough; where a frame has none, those sure and upright enough."""
    rows = boxes(spark, d).where("kind = 'person'").withColumn("large", area("box") >= 30_000)
    any_large = F.max("large").over(Window.partitionBy("frame"))
    upright = (F.col("box.y2") - F.col("box.y1")) / (F.col("box.x2") - F.col("box.x1"))
    return rows.withColumn("any", any_large).where(F.col("large") | (~F.col("any") & (F.col("score") >= 0.7) & (upright >= 1.3))).select("frame", "obj")


def a34_enclosing_box(spark: SparkSession, d: str) -> DataFrame:
    """The box around a frame's items, widened by fifty and cut at the picture; around its persons if there is no item."""
    one = lambda kind: F.when(F.col("kind") == kind, F.col("box"))
    low = lambda kind, c: F.greatest(F.lit(0.0), F.min(one(kind)[c]) - 50)
    high = lambda kind, c, most: F.least(F.lit(most), F.max(one(kind)[c]) + 50)
    box = lambda kind: [low(kind, "x1"), low(kind, "y1"), high(kind, "x2", 700.0), high(kind, "y2", 500.0)]
    there = F.count_if(F.col("kind") == "item") > 0
    return boxes(spark, d).groupBy("frame").agg(*[F.when(there, a).otherwise(b).alias(n) for n, a, b in zip(("x1", "y1", "x2", "y2"), box("item"), box("person"))])


def r02_zone_counts(spark: SparkSession, d: str) -> DataFrame:
    """Persons whose bottom centre is in a zone, and whether the frame is over its limit."""
    x, y = bottom_centre("box")
    rows = boxes(spark, d).where("kind = 'person'").groupBy("frame").agg(F.count_if(inside_polygon(x, y, ZONE)).alias("inside"))
    return rows.select("frame", "inside", (F.col("inside") > 2).alias("over"))


def w09_suppressed(spark: SparkSession, d: str) -> DataFrame:
    """Non-maximum suppression within a frame and kind: a box falls if a better kept one overlaps it by 0.3 or more."""
    one = F.struct((-F.col("score")).alias("s"), "obj", "box.x1", "box.y1", "box.x2", "box.y2")
    rows = boxes(spark, d).groupBy("frame", "kind").agg(F.array_sort(F.collect_list(one)).alias("all"))

    def falls(k: Column, b: Column) -> Column:
        w, h = F.least(k["x2"], b["x2"]) - F.greatest(k["x1"], b["x1"]), F.least(k["y2"], b["y2"]) - F.greatest(k["y1"], b["y1"])
        both = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
        size = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
        return both >= 0.3 * (size(k) + size(b) - both)

    none = F.slice("all", 1, 0)
    kept = F.aggregate("all", none, lambda kept, b: F.when(F.exists(kept, lambda k: falls(k, b)), kept).otherwise(F.concat(kept, F.array(b))))
    return rows.select("frame", "kind", F.explode(kept).alias("b")).select("frame", "kind", "b.obj")


def j03_equipment_of_persons(spark: SparkSession, d: str) -> DataFrame:
    """Whether a person wears a helmet, lacks one, or is said to lack one since none was seen.

    An item that shows the helmet counts with half of it on the person, one that shows it missing by
    its centre or a tenth of overlap either way. What is worn outweighs what is missing; where neither is seen the helmet is
    held to be missing, with a low confidence.
    """
    worn = (F.col("ik") % 3 == 0) & (containment("i", "p") >= 0.5)
    lacking = (F.col("ik") % 3 == 1) & (centre_inside("i", "p") | (F.greatest(containment("i", "p"), containment("p", "i")) >= 0.1) | (iou("p", "i") >= 0.1))
    rows = _pairs(spark, d).groupBy("frame", "person").agg(F.max(worn).alias("worn"), F.max(lacking).alias("lacking"))
    rows = rows.withColumn("missing", F.col("lacking") & ~F.col("worn"))
    return rows.select("frame", "person", "worn", "missing", F.when(~F.col("worn") & ~F.col("missing"), 0.45).otherwise(0.0).alias("supposed"))


def s16_box_shapes(spark: SparkSession, d: str) -> DataFrame:
    x, y = bottom_centre("box")
    w, h = F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1")
    return boxes(spark, d).select("obj", x.alias("x"), ((F.col("box.y1") + F.col("box.y2")) / 2).alias("y"), y.alias("bottom"), area("box").alias("area"), (h / w).alias("aspect"))


def scaled(polygon: list[tuple[float, float]], width: float, height: float) -> list[tuple[float, float]]:
    """A polygon in pixels; one with all corners within the unit square is in shares of the picture."""
    return [(x * width, y * height) for x, y in polygon] if all(0 <= v <= 1 for p in polygon for v in p) else polygon


def s17_in_scaled_zone(spark: SparkSession, d: str) -> DataFrame:
    """Boxes whose bottom centre is in a zone that is given in shares of the picture."""
    zone = scaled([(0.1, 0.2), (0.8, 0.25), (0.75, 0.9), (0.2, 0.8)], 640.0, 480.0)
    x, y = bottom_centre("box")
    return boxes(spark, d).where(inside_polygon(x, y, zone)).select("obj")
