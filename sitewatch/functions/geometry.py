"""Box and polygon expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: str) -> Column:
    return F.greatest(F.lit(0), F.col(f"{b}.x2") - F.col(f"{b}.x1")) * F.greatest(F.lit(0), F.col(f"{b}.y2") - F.col(f"{b}.y1"))


def intersection(a: str, b: str) -> Column:
    w = F.least(F.col(f"{a}.x2"), F.col(f"{b}.x2")) - F.greatest(F.col(f"{a}.x1"), F.col(f"{b}.x1"))
    h = F.least(F.col(f"{a}.y2"), F.col(f"{b}.y2")) - F.greatest(F.col(f"{a}.y1"), F.col(f"{b}.y1"))
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def iou(a: str, b: str) -> Column:
    """Intersection over union, 0 where the union is empty."""
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(F.lit(0.0))


def containment(inner: str, outer: str) -> Column:
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(F.lit(0.0))


def centre_inside(inner: str, outer: str, padding: float = 0.0) -> Column:
    """The centre of a box lies in another one that is widened by a share of its sides."""
    x, y = (F.col(f"{inner}.x1") + F.col(f"{inner}.x2")) / 2, (F.col(f"{inner}.y1") + F.col(f"{inner}.y2")) / 2
    a, b, c, d = (F.col(f"{outer}.{k}") for k in ("x1", "x2", "y1", "y2"))
    wide, high = (b - a) * F.lit(padding), (d - c) * F.lit(padding)
    return x.between(a - wide, b + wide) & y.between(c - high, d + high)


def bottom_centre(box: str) -> tuple[Column, Column]:
    return (F.col(f"{box}.x1") + F.col(f"{box}.x2")) / 2, F.col(f"{box}.y2")


def inside_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Ray casting over the polygon's edges."""
    inside = F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        if ay == by:
            continue
        crosses = (F.lit(float(ay)) > y) != (F.lit(float(by)) > y)
        at = F.lit(float(bx - ax)) * (y - F.lit(float(ay))) / F.lit(float(by - ay)) + F.lit(float(ax))
        inside = inside != (crosses & (x < at))
    return inside
