"""Connected components of an edge list, by alternating star contractions.

Each round joins every node to the least node around it, once among its larger
and once among its smaller neighbours, with aggregations and equi-joins only;
rounds are cut by reliable checkpoints. Nodes with more than HUB_EDGES edge ends
and 1/HUBS of all, of which there are fewer than HUBS whatever the input, meet
their edges by a broadcast, so that no key holds more of a join than a task can
well take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

HUBS = 1000
#: Edge ends of one node that a task can well take (some 50 bytes each).
HUB_EDGES = 200_000


def _to_least(edges: DataFrame, ends: int) -> DataFrame:
    """edges (a, b) with m, the least b of each a, not above a's own."""
    if ends <= HUB_EDGES:  # no node can have more
        return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a").select("a", "b", "m")
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("d"))
    many = max(HUB_EDGES, ends // HUBS)
    hubs = F.broadcast(low.where(F.col("d") > many).drop("d"))
    rest = edges.join(hubs.select("a"), "a", "left_anti").join(low.where(F.col("d") <= many).drop("d"), "a")
    return edges.join(hubs, "a").select("a", "b", "m").unionByName(rest.select("a", "b", "m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b of one orderable type. Returns node, root (the least node reachable), for nodes with an edge.

    Nulls are left out, loops and repeated edges count once, no edges give no rows.
    """
    e = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = F.least("a", "m")
        large = cut(_to_least(both, 2 * now[0]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), m.alias("b")).where("a != b").distinct())
        # b is below a throughout; the least neighbour takes a itself and all the others
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), "m")
        small = _to_least(large, 2 * now[0]).select(F.col("b").alias("x"), "m").unionByName(least)
        e = cut(small.where(F.col("x") != F.col("m")).select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct())
    return e.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
