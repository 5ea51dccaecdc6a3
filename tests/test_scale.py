"""Operators whose work must not meet in one task or grow with the square of what waits."""

import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions.predicates import Predicate
from gridloom.operators import flash, oplog, packing, splits, traces, trees, tuned_buffers, write_buffers
from gridloom.operators.selection import QueryType
from gridloom.plans import catalogue
from gridloom.plans.catalog import Catalog


def _sequential(rows):
    live = {}
    for _, _, op, p, *rest in sorted(rows, key=lambda r: r[1]):
        new, old = (p, *rest[:4]), tuple(rest[4:])
        gone = {"INSERT": None, "DELETE": new, "UPDATE": old}[op]
        if gone is not None:
            if not live.get(gone):
                continue
            live[gone] -= 1
        if op != "DELETE":
            live[new] = live.get(new, 0) + 1
    return sorted(k for k, n in live.items() for _ in range(n))


def test_replay_of_one_log_is_dealt_out(spark):
    """Chains, circles and repeated entries, as one after the other would leave them, in more than one task."""
    rng = random.Random(5)
    box = lambda p: (float(p % 3), 0.0, float(p % 3) + 1, 1.0)
    rows = []
    for seq in range(3000):
        p, q = rng.randrange(200), rng.randrange(200)
        op = rng.choice(["INSERT", "INSERT", "DELETE", "UPDATE"])
        if op == "UPDATE":
            q = p + 1 if p % 10 < 6 else p - p % 10  # circles of tens, cut in some places
            q, p = p, q
        rows.append((1, seq, op, p, *box(p), *((q, *box(q)) if op == "UPDATE" else (None,) * 5)))
    schema = "idx_id int, seq long, op string, p long, xmin double, ymin double, xmax double, ymax double, old_p long, old_xmin double, old_ymin double, old_xmax double, old_ymax double"
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = oplog.replay(spark.createDataFrame(rows, schema)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sorted(tuple(r)[1:6] for r in got) == _sequential(rows)
    assert len({r["task"] for r in got}) > 1
    assert oplog.replay(spark.createDataFrame([], schema)).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in oplog.components(links).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


class _Plain(write_buffers.WriteBuffer):
    """Flushes as they are defined, one unit after the other."""

    def flush(self):
        c = self.config
        live = sorted(sorted(self.pages, key=lambda i: (self.pages[i].first, i))[: max(1, math.ceil(len(self.pages) * c.oldest))])
        top = [max((getattr(p, x) for p in self.pages.values()), default=0) or 1.0 for x in ("area", "overlap")]

        def worth(unit):
            total = 0.0
            for p in (self.pages[i] for i in unit):
                v = float(p.changes) * (p.height + 1 if c.value != "changes" else 1)
                v *= p.area / top[0] if c.value in ("area", "overlap") else 1.0
                total += v * (p.overlap / top[1] if c.value == "overlap" else 1.0)
            return total

        units = [live[i : i + c.unit_pages] for i in range(0, len(live), c.unit_pages)]
        chosen = max(units, key=lambda u: (worth(u), [-i for i in u]))
        for i in chosen:
            self.used -= self.pages.pop(i).bytes
        self.written.append(chosen)
        return chosen


def test_flushes_by_value_as_defined():
    for value in ("changes", "height", "area", "overlap"):
        config = write_buffers.BufferConfig(capacity=4096, policy="value", value=value, oldest=0.6)
        a, b = write_buffers.WriteBuffer(config), _Plain(config)
        rng = random.Random(3)
        for _ in range(2000):
            p = rng.randrange(300)
            for x in (a, b):
                x.change(p, p % 3, (p * 7919 % 101) / 3, (p * 31 % 17) / 5)
        assert a.written == b.written and len(a.written) > 50


def test_kinds_of_writes_as_defined():
    rng = random.Random(4)
    h = write_buffers.WriteHistory(near=2)
    h.recent = [rng.randrange(400) for _ in range(64)]
    pages = list(range(400))
    assert h.nearby(pages) == [p for p in pages if any(0 < abs(p - q) <= 2 for q in h.recent)]
    assert h.strided(pages) == [p for p in pages if any(abs(p - q) >= 16 and (p - q) % 16 == 0 for q in h.recent)]


def test_a_flush_looks_at_each_waiting_page_once():
    """20,000 writes of different pages through a buffer of some 1,300, in time that does not grow with units times pages."""
    b = tuned_buffers.TunedBuffer(131_072, 0.5, "LRU")
    start = time.process_time()
    for k in range(20_000):
        b.change(k * 7919 % 1_000_003)
    b.flush_all()
    assert b.device_writes == 20_000
    assert time.process_time() - start < 15


def _log(spark, n=400):
    rng = random.Random(9)
    rows = [(k, "INSERT", k, x, y, x, y) for k in range(n) for x, y in [(float(rng.randrange(50)), float(rng.randrange(2000)))]]
    rows += [(r[0] + 1000, "DELETE", *r[2:]) for r in rows if r[0] % 8 == 3] + [(5000 + k, "QUERY", k, 5.0 * k, 0.0, 5.0 * k + 9, 900.0) for k in range(5)]
    log = spark.createDataFrame(rows, "seq long, op string, p long, xmin double, ymin double, xmax double, ymax double")
    return lambda kinds: log.withColumn("idx_id", F.explode(F.array(*[F.lit(i) for i in kinds])))


def test_runs_without_their_traces(spark):
    """Counts, answers and cache totals of a run, made as its requests come, are those of its trace."""
    log = _log(spark)
    rows = lambda df: sorted(map(tuple, df.collect()))
    trees_, buffered = {k: catalogue.TREES[k] for k in (2, 7, 8, 9)}, {k: catalogue.BUFFERED[k] for k in (1, 8, 11, 16, 25)}
    for kinds in (trees_, buffered):
        trace = trees.run_workload(log(kinds), kinds).cache()
        asked = trace.where("page_id >= 0").groupBy("pe_id", "op_type", "height").count()
        assert rows(trees.requests(log(kinds), kinds)) == rows(asked)
        assert rows(trees.answers(log(kinds), kinds)) == rows(trace.where("results is not null").select("pe_id", "seq", "results"))
        if kinds is trees_:
            assert rows(trees.cached(log(kinds), kinds, "HLRU", 16)) == rows(traces.replay(trace, "HLRU", 16))
        trace.unpersist()


def test_each_index_is_a_task(spark):
    kinds = {k: catalogue.TREES[2] for k in range(3, 11)}
    got = trees.answers(_log(spark, 40)(kinds), kinds).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 40 and len({(r["idx_id"], r["task"]) for r in got}) == len({r["task"] for r in got}) == 8


def test_splits_take_lists():
    rng = random.Random(2)
    for _ in range(50):
        boxes = [(x, y, x + rng.randrange(3), y + rng.randrange(3)) for x, y in [(float(rng.randrange(5)), float(rng.randrange(5))) for _ in range(7)]]
        for split in splits.SPLITS.values():
            a, b = split(boxes, 2)
            assert (a, b) == split(np.array(boxes), 2) and sorted([*a, *b]) == list(range(7)) and min(len(a), len(b)) >= 2


def test_stored_runs_are_replayed_in_one_job(spark, monkeypatch):
    """Runs and snapshots of all indices wait for their tables, and come from one replay of each log."""
    calls = []
    for name in ("measures_of_runs", "grow_at"):
        real = getattr(trees, name)
        monkeypatch.setattr(trees, name, lambda *a, real=real, name=name: (calls.append(name), real(*a))[1])
    c = Catalog(spark)
    c.add_source(1, spark.createDataFrame([(k, float(k % 7), float(k), float(k % 7), float(k)) for k in range(60)], "id long, xmin double, ymin double, xmax double, ymax double"))
    c.add_basic(1, 4096)
    c.add_special(1, 2, 6)
    for path in ("/a", "/b"):
        c.create(1, path, 1, 1, 1, option=2)
    c.a_insert("/a", 1000, (1, 1, 2, 2), 2)
    c.a_query("/b", QueryType.RANGE, (0.0, 0.0, 3.0, 20.0), Predicate.INTERSECTS)
    assert not calls
    got = {r["pe_id"]: r for r in c.table("execution").collect()}
    s = {r["pe_id"]: r["num_entries_leaf_nodes"] for r in c.table("snapshot").collect()}
    assert sorted(calls) == ["grow_at", "measures_of_runs"] and sorted(got) == [1, 2, 3, 4] and s == {1: 60, 2: 60, 3: 61}
    for pe, path, since in ((1, "/a", 1), (3, "/a", 121), (4, "/b", 122)):
        index = c.indices[path]
        log = c.log(path).where(F.col("seq") <= {1: 60, 3: 121, 4: 122}[pe])
        alone = trees.measures(log, {index.idx_id: c.tree_config(index)}, since).first()
        assert all(got[pe][x] == alone[x] for x in ("reads_num", "writes_num", "split_leaf_num", "mods_pheight", "accesses_pheight"))


def test_wear_levelling_of_many_blocks():
    """Thousands of blocks that were never erased, beside few that are written all the time, are moved one after the other."""
    d = flash.Device(flash.DeviceConfig(blocks=3000, pages_per_block=2, wear_gap=4))
    for page in range(5800):
        d.write(page)
    for k in range(6000):
        d.write(k % 20)
    assert d.live_pages() == 5800 and max(d.erases) - min(d.erases) <= 6


def test_dead_space_of_many_nodes(spark, monkeypatch):
    """Nodes that lie across batches, each computed once, and no pandas group for each."""
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInPandas", None)
    rows = [(k % 2, k, float(j), float(k % 5), float(j) + 1 + k % 3, float(k % 5) + 1) for k in range(12_000) for j in (0, 4)] + [(0, 99_999, 0.0, 0.0, 2.0, 2.0)]
    got = {(r["height"], r["node_id"]): r["dead_space"] for r in packing.dead_space(spark.createDataFrame(rows, "height int, node_id long, xmin double, ymin double, xmax double, ymax double")).collect()}
    assert got == {(k % 2, k): float(4 + 1 + k % 3 - 2 * (1 + k % 3)) for k in range(12_000)} | {(0, 99_999): 0.0}
