"""Packed Hilbert trees as tables of node entries, built level by level with aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import area, box, center, enclosing, overlap_area
from ..functions.hilbert import cell, hilbert


def ranked(df: DataFrame, key: str, bits: int, tie: str = "id", coarse_bits: int = 12) -> DataFrame:
    """A gapless rank from 0 by (key, tie), key in [0, 2^bits).

    Rows are numbered inside the ranges of the key's leading bits, and shifted by
    the running count of the ranges before: at most 2^coarse_bits counts.
    """
    part = F.shiftright(F.col(key), max(0, bits - coarse_bits))
    rows = df.withColumn("range", part)
    counts = rows.groupBy("range").agg(F.count("*").alias("n"))
    running = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.select("range", (F.sum("n").over(running) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(key, tie))
    return rows.withColumn("inside", inside).join(before, "range").withColumn("rank", (F.col("before") + F.col("inside") - 1).cast("long")).drop("range", "inside", "before")


def with_hilbert(data: DataFrame, domain: tuple[float, float, float, float], bits: int = 16) -> DataFrame:
    cx, cy = center(box())
    return data.withColumn("lhv", hilbert(cell(cx, domain[0], domain[2], bits), cell(cy, domain[1], domain[3], bits), bits))


def domain_of(data: DataFrame) -> tuple[float, float, float, float]:
    r = data.agg(*enclosing()).first()
    if r[0] is None:
        return 0.0, 0.0, 1.0, 1.0
    x0, y0, x1, y1 = r
    return x0, y0, x1 if x1 > x0 else x0 + 1, y1 if y1 > y0 else y0 + 1


def packed_tree(data: DataFrame, capacity: int, domain: tuple[float, float, float, float] | None = None, bits: int = 16) -> DataFrame:
    """Node entries of a packed tree: height, node_id, elem_position, pointer, box, lhv.

    Height 0 is the leaves, whose pointers are object ids; a pointer above is
    the number of a node one level below.
    """
    if capacity < 2:
        raise ValueError("a node holds two entries at least")
    domain = domain or domain_of(data)
    level = ranked(with_hilbert(data, domain, bits), "lhv", 2 * bits).select("rank", F.col("id").alias("pointer"), "xmin", "ymin", "xmax", "ymax", "lhv")
    n, height, out = data.count(), 0, None
    while True:
        entries = level.select(
            F.lit(height).alias("height"), F.floor(F.col("rank") / capacity).cast("long").alias("node_id"), (F.col("rank") % capacity).cast("int").alias("elem_position"),
            "pointer", "xmin", "ymin", "xmax", "ymax", "lhv",
        )
        out = entries if out is None else out.unionByName(entries)
        n = -(-n // capacity)
        if n <= 1:
            return out
        level = entries.groupBy("node_id").agg(*enclosing(), F.max("lhv").alias("lhv")).select(
            F.col("node_id").alias("rank"), F.col("node_id").alias("pointer"), "xmin", "ymin", "xmax", "ymax", "lhv"
        )
        height += 1


def nodes_per_height(tree: DataFrame) -> DataFrame:
    return tree.groupBy("height").agg(F.count_distinct("node_id").alias("nodes"), F.count("*").alias("entries"))


def node_metrics(tree: DataFrame) -> DataFrame:
    """For each node: entries, coverage area and margin of its box."""
    return tree.groupBy("height", "node_id").agg(F.count("*").alias("entries"), *enclosing()).select(
        "height", "node_id", "entries", area(box()).alias("coverage_area"), ((F.col("xmax") - F.col("xmin")) + (F.col("ymax") - F.col("ymin"))).alias("margin")
    )


def node_overlap(tree: DataFrame) -> DataFrame:
    """For each node, the overlap area of its entries, every pair counted in both orders."""
    a = tree.select("height", "node_id", F.col("elem_position").alias("i"), *[F.col(c).alias(f"a_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    b = tree.select("height", "node_id", F.col("elem_position").alias("j"), *[F.col(c).alias(f"b_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    # a node has at most ``capacity`` entries, which bounds the pairs of each row
    pairs = a.join(b, ["height", "node_id"]).where("i <> j")
    return pairs.groupBy("height", "node_id").agg(F.sum(overlap_area(box("a_"), box("b_"))).alias("overlap_area"))


def dead_space(tree: DataFrame) -> DataFrame:
    """For each node, the area of its box that no entry covers; 0 below two entries."""
    from itertools import groupby, islice

    import numpy as np
    import pyarrow as pa

    from ..functions.sweep import union_area

    def one(b: list[tuple]) -> float:
        if len(b) < 2:
            return 0.0
        x0, y0, x1, y1 = zip(*b)
        return max(0.0, (max(x1) - min(x0)) * (max(y1) - min(y0)) - float(union_area(np.array(b))))

    def run(batches):
        # the rows of a node follow each other; a group for each node would cost more than its area does
        rows = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns]))
        found = ((*key, one([r[2:] for r in part])) for key, part in groupby(rows, key=lambda r: r[:2]))
        while some := list(islice(found, 10_000)):
            h, n, d = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int32()), pa.array(n, pa.int64()), pa.array(d, pa.float64())], ["height", "node_id", "dead_space"])

    nodes = tree.select("height", "node_id", "xmin", "ymin", "xmax", "ymax").repartition("height", "node_id").sortWithinPartitions("height", "node_id")
    return nodes.mapInArrow(run, "height int, node_id long, dead_space double")


def structure_snapshot(tree: DataFrame) -> DataFrame:
    """The averages of a tree's nodes: one row."""
    m = node_metrics(tree).join(node_overlap(tree), ["height", "node_id"], "left")
    return m.agg(
        F.count("*").alias("nodes"), F.sum("entries").alias("entries"), (F.max("height") + 1).alias("tree_height"),
        F.sum(F.when(F.col("height") == 0, 1).otherwise(0)).alias("leaf_nodes"), F.sum(F.when(F.col("height") > 0, 1).otherwise(0)).alias("internal_nodes"),
        F.avg("entries").alias("avg_entries"), F.avg("coverage_area").alias("avg_coverage_area"), F.avg(F.coalesce("overlap_area", F.lit(0.0))).alias("avg_overlap_area"),
    )


def tree_query(tree: DataFrame, window: tuple[float, float, float, float], eps: float = 1e-5) -> DataFrame:
    """Leaf entries that a window meets, found from the root down by one join for each level."""
    from ..functions.boxes import literal_box
    from ..functions.predicates import Predicate, box_test

    met = box_test(literal_box(*window), box(), Predicate.INTERSECTS, eps)
    top = tree.agg(F.max("height")).first()[0]
    if top is None:
        return tree.select(F.col("pointer").alias("id"))
    live = tree.where((F.col("height") == top) & met).select("pointer")
    for h in range(top - 1, -1, -1):
        live = tree.where((F.col("height") == h) & met).join(live.select(F.col("pointer").alias("node_id")), "node_id", "left_semi").select("pointer")
    return live.select(F.col("pointer").alias("id"))
