"""Maintenance of a dataset by an ordered log of inserts, deletes and updates.

Log rows: seq, op (INSERT, DELETE, UPDATE), p, box; an UPDATE also has old_p and
an old box (prefix ``old_``), and inserts only if it found what it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BOX = ["xmin", "ymin", "xmax", "ymax"]


def live_entries(log: DataFrame) -> DataFrame:
    """Entries (id, box, copies) after a log of inserts and deletes only.

    A delete takes one entry of equal pointer and box away, if there is one, so
    the copies left are the final sum less the lowest running sum below 0.
    """
    key = ["p", *_BOX]
    step = F.when(F.col("op") == "INSERT", 1).when(F.col("op") == "DELETE", -1)
    w = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = log.where(F.col("op").isin("INSERT", "DELETE")).select(*key, "seq", step.alias("step")).withColumn("run", F.sum("step").over(w))
    left = run.groupBy(*key).agg((F.sum("step") - F.least(F.min("run"), F.lit(0))).alias("copies")).where("copies > 0")
    return left.select(F.col("p").alias("id"), *_BOX, F.col("copies").cast("long").alias("copies"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable by links (a, b), for all nodes that have a link to another.

    Alternating star contractions: every node's larger neighbours, then its
    smaller ones, are joined to the least of them, until nothing changes.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().localCheckpoint()
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    least = F.min("v").over(Window.partitionBy("u"))
    now = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.select("u", "v", F.least(least, F.col("u")).alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.select("u", "v", least.alias("m"))
        out = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = out.distinct().localCheckpoint()
        before, now = now, state(edges)
        if now == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def replay(log: DataFrame) -> DataFrame:
    """Entries (idx_id, id, box) after a log with updates.

    Only entries that updates link, directly or by others, depend on each other.
    Each such component is replayed in order, in a stream of its rows that keeps
    its live entries alone; entries are linked by hashes, of which equal ones
    make components larger, not results different.
    """
    old_box = [f"old_{c}" for c in _BOX]
    names = ["op", "idx_id", "p", *_BOX, "old_p", *old_box]
    rows = log.where(F.col("op").isin("INSERT", "DELETE", "UPDATE")).select(*names, "seq", F.xxhash64("idx_id", "p", *_BOX).alias("key"))
    links = rows.where("op = 'UPDATE'").select(F.xxhash64("idx_id", "old_p", *old_box).alias("a"), F.col("key").alias("b"))
    rows = rows.join(components(links), F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "key"))
    ordered = rows.select("component", "seq", *names).repartition("component").sortWithinPartitions("component", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live: dict[tuple, int] = {}
        last = None
        schema = pa.schema([("idx_id", pa.int32()), ("id", pa.int64()), *[(c, pa.float64()) for c in _BOX]])

        def found() -> list[tuple]:
            return [k for k, n in live.items() for _ in range(n)]

        for batch in batches:
            done: list[tuple] = []
            c = [x.to_pylist() for x in batch.columns]
            for component, op, new, old in zip(c[0], c[2], zip(*c[3:9]), zip(c[3], *c[9:])):
                if component != last:
                    done += found()
                    live.clear()
                    last = component
                if op == "INSERT":
                    live[new] = live.get(new, 0) + 1
                    continue
                gone = new if op == "DELETE" else old
                n = live.get(gone, 0)
                if n:
                    if n > 1:
                        live[gone] = n - 1
                    else:
                        del live[gone]
                    if op == "UPDATE":
                        live[new] = live.get(new, 0) + 1
            yield from _batches(done, schema)
        yield from _batches(found(), schema)

    return ordered.mapInArrow(run, "idx_id int, id long, xmin double, ymin double, xmax double, ymax double")


def _batches(rows: list[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i : i + size]), schema)], schema=schema)
