"""Plane geometry as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Whether a point is in a polygon; points on its edge count as inside."""
    edges = list(zip(polygon, polygon[1:] + polygon[:1], strict=True))
    crossings = [F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / ((y2 - y1) or 1.0) + x1), 1).otherwise(0) for (x1, y1), (x2, y2) in edges]
    on_edge = [((x - x1) * (y2 - y1) == (y - y1) * (x2 - x1)) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)) for (x1, y1), (x2, y2) in edges]
    return (reduce(lambda a, b: a + b, crossings) % 2 == 1) | reduce(lambda a, b: a | b, on_edge)


def project(x: Column, y: Column, h: list[list[float]]) -> tuple[Column, Column]:
    """A point through a 3x3 homography."""
    u, v, w = (r[0] * x + r[1] * y + r[2] for r in h)
    return u / w, v / w


def ratio(width: Column, height: Column) -> Column:
    """Width over height; 0 where one of them is."""
    return F.when((width > 0) & (height > 0), width / height).otherwise(0.0)


def box_corners(a: Column, b: Column, c: Column, d: Column) -> Column:
    """A box given as (x1, y1, x2, y2) or (x, y, width, height), as corners: the valid reading of lesser area."""
    corners = F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    sizes = F.struct(a.alias("x1"), b.alias("y1"), (a + c).alias("x2"), (b + d).alias("y2"))
    first, second = (c > a) & (d > b), (c > 0) & (d > 0)
    return F.when(first & second, F.when((c - a) * (d - b) <= c * d, corners).otherwise(sizes)).when(first, corners).when(second, sizes)


def overlap(a: str, b: str) -> Column:
    """Intersection over union of two boxes (structs x1, y1, x2, y2)."""
    c = lambda s, k: F.col(f"{s}.{k}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")))
    area = lambda s: (c(s, "x2") - c(s, "x1")) * (c(s, "y2") - c(s, "y1"))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)
