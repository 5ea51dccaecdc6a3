"""Spatial selections: filter and refine, single and in batches, with the complement for DISJOINT."""

from __future__ import annotations

import math
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import EPSILON, Box, area, box, literal_box
from ..functions.geometry import POINT, Shape, box_wkb, refine_udf
from ..functions.predicates import FILTER_TEST, Predicate, box_test, exact


class QueryType(IntEnum):
    SELECTION = 1
    RANGE = 2
    POINT = 3


class Option(IntEnum):
    FILTER_AND_REFINE = 1
    FILTER_ONLY = 2


#: The tolerant tests of CONTAINS and COVERS would drop objects near the border that the exact ones keep.
REFINED_TEST = {Predicate.CONTAINS: Predicate.CONTAINS_OR_COVERS, Predicate.COVERS: Predicate.CONTAINS_OR_COVERS}
#: Cells a side of the finest grid, and its levels (each twice as coarse as the one before).
GRID_CELLS, GRID_LEVELS = 64, 7
#: Rows of queries and cells (some 60 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_CELLS = 100_000


def _check(kind: QueryType, p: Predicate, window: tuple[float, float, float, float]) -> None:
    if p not in FILTER_TEST:
        raise ValueError(f"predicate {p} can't be queried")
    if any(v is None or math.isnan(v) for v in window) or window[0] > window[2] or window[1] > window[3]:
        raise ValueError("the search object is empty")
    if kind == QueryType.POINT and (window[0] != window[2] or window[1] != window[3]):
        raise ValueError("a point query needs a point")


def candidates(data: DataFrame, window: Box, p: Predicate, eps: float = EPSILON) -> DataFrame:
    """The filter step."""
    return data.where(box_test(window, box(), FILTER_TEST[p], eps))


def spatial_query(
    data: DataFrame, kind: QueryType, window: tuple[float, float, float, float], predicate: Predicate,
    option: Option = Option.FILTER_AND_REFINE, eps: float = EPSILON,
) -> DataFrame:
    """Ids of the objects that the query relates to (query *predicate* object).

    A range query with CONTAINS or COVERS is answered by its box test alone;
    filter-only queries return candidates, for DISJOINT those that intersect.
    Everything is one scan with column predicates; DISJOINT is the negated exact
    test in the same scan, which is the complement of the intersecting objects.
    """
    kind, p, option = QueryType(kind), Predicate(predicate), Option(option)
    _check(kind, p, window)
    w = literal_box(*window)
    if option == Option.FILTER_ONLY:
        return candidates(data, w, p, eps)
    if kind == QueryType.RANGE and p in (Predicate.CONTAINS, Predicate.COVERS):
        return candidates(data, w, p, eps)
    if p == Predicate.DISJOINT:
        met = box_test(w, box(), Predicate.INTERSECTS, eps) & exact(w, box(), Predicate.INTERSECTS)
        return data.where(~met)
    return data.where(box_test(w, box(), REFINED_TEST.get(p, FILTER_TEST[p]), eps) & exact(w, box(), p))


def geometry_query(data: DataFrame, kind: QueryType, search: bytes, predicate: Predicate, option: Option = Option.FILTER_AND_REFINE, eps: float = EPSILON, shortcut: bool = True) -> DataFrame:
    """The objects (with a column wkb beside their boxes) that the search geometry relates to (search *predicate* object).

    The box test is a column predicate in the scan; only what passes it reaches
    the exact test on the geometries. A range query takes the search object's
    box, and is answered by the box test for CONTAINS and COVERS. With
    ``shortcut`` a point and a polygon are compared by one point location, in
    which the border counts as in. DISJOINT is the complement of what
    intersects; objects without a geometry are in no result.
    """
    kind, p, option = QueryType(kind), Predicate(predicate), Option(option)
    shape = Shape.of(search)
    ends = shape.bounds()
    if ends is None:
        raise ValueError("the search object is empty")
    if kind == QueryType.POINT and shape.kind != POINT:
        raise ValueError("a point query needs a point")
    if kind == QueryType.RANGE:
        search = box_wkb(*ends)
    w = literal_box(*ends)
    if option == Option.FILTER_ONLY or (kind == QueryType.RANGE and p in (Predicate.CONTAINS, Predicate.COVERS)):
        return candidates(data, w, p, eps)
    if p == Predicate.DISJOINT:
        met = candidates(data, w, Predicate.INTERSECTS, eps).where(refine_udf(search, Predicate.INTERSECTS, shortcut)("wkb"))
        return complement(data.where(F.col("wkb").isNotNull()), met)
    test = REFINED_TEST.get(p, FILTER_TEST[p])
    return data.where(box_test(w, box(), test, eps)).where(refine_udf(search, p, shortcut)("wkb"))


def complement(data: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """The objects that are not among those found."""
    return data.join(found.select(key).distinct(), key, "left_anti")


def fetch(data: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The objects of a list of candidate ids."""
    return data.join(ids.select(key).distinct(), key, "left_semi")


def batch_query(data: DataFrame, queries: DataFrame, predicate: Predicate = Predicate.INTERSECTS, eps: float = EPSILON, refine: bool = True, flag: bool = False) -> DataFrame:
    """Pairs (qid, id) for a table of query windows (qid, xmin, ymin, xmax, ymax); with ``flag`` all candidates, and whether each is a result.

    Each object lies in one cell of the grid level that fits its size (the cell
    of its lower corner), each query in the cells of every level that can hold
    an object it meets, so the two sides meet in an equi-join whose rows are
    unique, and the box test runs on those rows only. A level has at most
    (GRID_CELLS + 2)^2 cells, which bounds a query's rows whatever the data. The
    queries' cells are counted: few go to the objects, which then stay where
    they are; many meet them in a shuffle.
    """
    p = Predicate(predicate)
    if p == Predicate.DISJOINT:
        raise ValueError("DISJOINT relates almost all pairs; take the complement of each query")
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    ends = data.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax"), F.min(w), F.min(h), F.max(w), F.max(h)).first()
    if ends[0] is None:
        ends = (0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0)
    x0, y0, x1, y1 = ends[:4]
    sx, sy = max((x1 - x0) / GRID_CELLS, 1e-9), max((y1 - y0) / GRID_CELLS, 1e-9)
    # the levels that can occur, with one to spare on either side for rounding
    low, high = (math.ceil(math.log2(max(1.0, a / sx, b / sy))) for a, b in (ends[4:6], ends[6:8]))
    used = range(max(0, min(low, GRID_LEVELS - 1) - 1), min(high + 1, GRID_LEVELS - 1) + 1)

    extent = F.greatest(w / sx, h / sy)
    level = F.when(extent <= 1, 0).otherwise(F.least(F.ceil(F.log2(extent)), F.lit(GRID_LEVELS - 1))).cast("int")

    def at(v: Column, low: float, size: float, lv: Column) -> Column:
        return F.floor((v - low) / (size * F.pow(F.lit(2.0), lv))).cast("int")

    objects = data.withColumn("level", level).withColumn("cx", at(F.col("xmin"), x0, sx, F.col("level"))).withColumn("cy", at(F.col("ymin"), y0, sy, F.col("level")))
    q = queries.select("qid", *[F.col(c).alias(f"q_{c}") for c in Box._fields])
    q = q.where((F.col("q_xmin") <= x1 + eps) & (F.col("q_xmax") >= x0 - eps) & (F.col("q_ymin") <= y1 + eps) & (F.col("q_ymax") >= y0 - eps))
    q = q.withColumn("level", F.explode(F.array(*[F.lit(v) for v in used])))
    clip = lambda v, low, high: F.least(F.greatest(v, F.lit(low)), F.lit(high))
    lv = F.col("level")
    q = q.withColumn("cx", F.explode(F.sequence(at(clip(F.col("q_xmin") - eps, x0, x1), x0, sx, lv) - 1, at(clip(F.col("q_xmax") + eps, x0, x1), x0, sx, lv))))
    q = q.withColumn("cy", F.explode(F.sequence(at(clip(F.col("q_ymin") - eps, y0, y1), y0, sy, lv) - 1, at(clip(F.col("q_ymax") + eps, y0, y1), y0, sy, lv))))
    if q.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        q = F.broadcast(q)
    refine = refine and not flag
    pairs = objects.join(q, ["level", "cx", "cy"]).where(box_test(box("q_"), box(), REFINED_TEST.get(p, FILTER_TEST[p]) if refine else FILTER_TEST[p], eps))
    if refine:
        pairs = pairs.where(exact(box("q_"), box(), p))
    return pairs.select("qid", "id", exact(box("q_"), box(), p).alias("result")) if flag else pairs.select("qid", "id")


def covered_area(data: DataFrame) -> DataFrame:
    """Objects, their joint box and the sum of their areas."""
    return data.agg(F.count("*").alias("objects"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.sum(area(box())).alias("area"))
