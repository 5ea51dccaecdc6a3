"""Box arithmetic as Column expressions.

A box is four DOUBLE columns; everything here stays inside generated code and
its comparisons against literals reach the Parquet scan.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance of the filter step's comparisons.
EPSILON = 1e-5


class Box(NamedTuple):
    xmin: Column
    ymin: Column
    xmax: Column
    ymax: Column

    @property
    def sides(self) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
        return (self.xmin, self.xmax), (self.ymin, self.ymax)


def box(prefix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{c}") for c in Box._fields))


def literal_box(xmin: float, ymin: float, xmax: float, ymax: float) -> Box:
    return Box(*(F.lit(float(v)) for v in (xmin, ymin, xmax, ymax)))


def below(a: Column, b: Column, eps: float = EPSILON) -> Column:
    """a < b by more than the tolerance."""
    return b - a > eps


def at_most(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return a - b <= eps


def same(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return F.abs(a - b) <= eps


def area(b: Box) -> Column:
    return (b.xmax - b.xmin) * (b.ymax - b.ymin)


def margin(b: Box) -> Column:
    return (b.xmax - b.xmin) + (b.ymax - b.ymin)


def union(a: Box, b: Box) -> Box:
    return Box(F.least(a.xmin, b.xmin), F.least(a.ymin, b.ymin), F.greatest(a.xmax, b.xmax), F.greatest(a.ymax, b.ymax))


def expansion(node: Box, entry: Box) -> Column:
    """Area that the node would gain by taking the entry."""
    return area(union(node, entry)) - area(node)


def overlap_area(a: Box, b: Box) -> Column:
    w = F.least(a.xmax, b.xmax) - F.greatest(a.xmin, b.xmin)
    h = F.least(a.ymax, b.ymax) - F.greatest(a.ymin, b.ymin)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def center(b: Box) -> tuple[Column, Column]:
    return (b.xmin + b.xmax) / 2, (b.ymin + b.ymax) / 2


def center_distance2(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def enclosing() -> list[Column]:
    """Aggregates for the box of a set of boxes."""
    return [F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")]


def to_wkt(b: Box) -> Column:
    """A point, a line of two points, or a ring, whichever the box is."""
    t = [c.cast("string") for c in b]
    x0, y0, x1, y1 = t
    sp = F.lit(" ")
    flat_x, flat_y = b.xmin == b.xmax, b.ymin == b.ymax
    point = F.concat(F.lit("POINT("), x0, sp, y0, F.lit(")"))
    line = F.concat(F.lit("LINESTRING("), x0, sp, y0, F.lit(","), x1, sp, y1, F.lit(")"))
    corners = [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]
    ring = F.concat(F.lit("POLYGON(("), F.concat_ws(",", *[F.concat(x, sp, y) for x, y in corners]), F.lit("))"))
    return F.when(flat_x & flat_y, point).when(flat_x | flat_y, line).otherwise(ring)


def node_capacity(page_bytes: int, entry_bytes: int = 36, max_fill: float = 1.0, min_fill: float = 0.4, header_bytes: int = 4) -> tuple[int, int]:
    """(least, most) entries of a node of the given page size."""
    import math

    most = math.ceil((page_bytes - header_bytes) // entry_bytes * max_fill)
    return max(2, math.ceil(most * min_fill)), most
