"""Topological predicates: the tolerant box tests of the filter step and exact tests of the refinement step.

Read as *query predicate object*: INSIDE means that the query lies in the object.
"""

from __future__ import annotations

from enum import IntEnum
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import EPSILON, Box, at_most, below, same


class Predicate(IntEnum):
    INTERSECTS = 1
    OVERLAP = 2
    DISJOINT = 3
    MEET = 4
    INSIDE = 5
    COVEREDBY = 6
    CONTAINS = 7
    COVERS = 8
    EQUAL = 9
    INSIDE_OR_COVEREDBY = 10
    CONTAINS_OR_COVERS = 11


#: Which box test the filter step runs for each predicate.
FILTER_TEST = {
    Predicate.INTERSECTS: Predicate.INTERSECTS, Predicate.OVERLAP: Predicate.INTERSECTS, Predicate.DISJOINT: Predicate.INTERSECTS,
    Predicate.MEET: Predicate.INTERSECTS, Predicate.INSIDE: Predicate.INSIDE_OR_COVEREDBY, Predicate.COVEREDBY: Predicate.INSIDE_OR_COVEREDBY,
    Predicate.CONTAINS: Predicate.CONTAINS, Predicate.COVERS: Predicate.COVERS, Predicate.EQUAL: Predicate.EQUAL,
}


def _both(a: Box, b: Box, test) -> Column:
    """A test of (a.min, a.max, b.min, b.max) in both dimensions."""
    return reduce(and_, (test(*x, *y) for x, y in zip(a.sides, b.sides)))


def box_test(a: Box, b: Box, p: Predicate, eps: float = EPSILON) -> Column:
    """Does ``a p b`` hold for boxes, within the tolerance?"""
    lt = lambda x, y: below(x, y, eps)
    le = lambda x, y: at_most(x, y, eps)
    eq = lambda x, y: same(x, y, eps)
    within = lambda u, v: _both(u, v, lambda a0, a1, b0, b1: le(b0, a0) & le(a1, b1))
    match p:
        case Predicate.INTERSECTS:
            return _both(a, b, lambda a0, a1, b0, b1: ~(lt(a1, b0) | lt(b1, a0)))
        case Predicate.DISJOINT:
            return ~box_test(a, b, Predicate.INTERSECTS, eps)
        case Predicate.INSIDE:
            return _both(a, b, lambda a0, a1, b0, b1: lt(b0, a0) & lt(a1, b1))
        case Predicate.INSIDE_OR_COVEREDBY:
            return within(a, b)
        case Predicate.COVEREDBY:  # contained, with a shared edge in either dimension
            return within(a, b) & _both(a, b, lambda a0, a1, b0, b1: eq(a0, b0) | eq(a1, b1))
        case Predicate.CONTAINS | Predicate.COVERS | Predicate.CONTAINS_OR_COVERS:
            back = {Predicate.CONTAINS: Predicate.INSIDE, Predicate.COVERS: Predicate.COVEREDBY, Predicate.CONTAINS_OR_COVERS: Predicate.INSIDE_OR_COVEREDBY}
            return box_test(b, a, back[p], eps)
        case Predicate.EQUAL:
            return _both(a, b, lambda a0, a1, b0, b1: eq(a0, b0) & eq(a1, b1))
        case Predicate.OVERLAP:
            return _both(a, b, lambda a0, a1, b0, b1: lt(a0, b1) & lt(b0, a1)) & ~within(a, b) & ~within(b, a)
        case Predicate.MEET:
            return box_test(a, b, Predicate.INTERSECTS, eps) & ~box_test(a, b, Predicate.OVERLAP, eps)
    raise ValueError(f"no box test for {p!r}")


def exact(a: Box, b: Box, p: Predicate) -> Column:
    """Does ``a p b`` hold exactly, for boxes, axis-parallel segments and points as point sets?"""
    if p == Predicate.CONTAINS:
        return exact(b, a, Predicate.INSIDE)
    if p == Predicate.COVERS:
        return exact(b, a, Predicate.COVEREDBY)
    touch = _both(a, b, lambda a0, a1, b0, b1: (a0 <= b1) & (b0 <= a1))
    covered = lambda u, v: _both(u, v, lambda a0, a1, b0, b1: (b0 <= a0) & (a1 <= b1))

    def meet_inside(a0, a1, b0, b1):
        # relative interiors: a flat side is its own interior
        open_open = F.greatest(a0, b0) < F.least(a1, b1)
        return F.when((a0 < a1) & (b0 < b1), open_open).when(a0 < a1, (a0 < b0) & (b0 < a1)).when(b0 < b1, (b0 < a0) & (a0 < b1)).otherwise(a0 == b0)

    interiors = _both(a, b, meet_inside)
    match p:
        case Predicate.INTERSECTS:
            return touch
        case Predicate.DISJOINT:
            return ~touch
        case Predicate.EQUAL:
            return _both(a, b, lambda a0, a1, b0, b1: (a0 == b0) & (a1 == b1))
        case Predicate.COVEREDBY:
            return covered(a, b)
        case Predicate.INSIDE:
            return _both(a, b, lambda a0, a1, b0, b1: ((b0 < a0) & (a1 < b1)) | ((b0 == b1) & (a0 == b0) & (a1 == b1)))
        case Predicate.MEET:
            return touch & ~interiors
        case Predicate.OVERLAP:
            alike = _both(a, b, lambda a0, a1, b0, b1: (a0 < a1) == (b0 < b1))
            return alike & interiors & ~covered(a, b) & ~covered(b, a)
    raise ValueError(f"no exact test for {p!r}")
