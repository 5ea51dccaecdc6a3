"""The trees on the JVM do what the Python trees do."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom import native
from gridloom.operators import flash, trees
from gridloom.plans import catalogue

SF = "/root/testdata/sf0.001"
DOMAIN = (0.0, 0.0, 64.0, 2200.0)


def _rows(n, seed):
    """Inserts, deletes, updates, queries and flushes; some points again and again, some pointers twice, some deletes of what is not there."""
    rng, rows, live = random.Random(seed), [], []
    for s in range(n):
        u, old = rng.random(), (None,) * 5
        x, y = float(rng.randrange(50)), rng.random() * 2000
        b = rng.choice([(x, y, x, y), (5.0, 7.0, 5.0, 7.0), (x, y, x + rng.random() * 3, y + rng.random() * 30)])
        if u < 0.6 or not live:
            op, p = "INSERT", s if rng.random() < 0.95 else max(0, s - 9)
            live.append((p, b))
        elif u < 0.8:
            op = "DELETE"
            p, b = live.pop(rng.randrange(len(live))) if rng.random() < 0.9 else (-5, b)
        elif u < 0.9:
            op, p, old = "UPDATE", s, live.pop(rng.randrange(len(live)))
            old = (old[0], *old[1])
            live.append((p, b))
        elif u < 0.98:
            op, p, b = "QUERY", None, (x, y, x + 5, y + 100)
        else:
            op, p, b = "FLUSH", None, (None,) * 4
        rows.append((s, op, p, *b, *old))
    return rows


@pytest.mark.parametrize("kinds", [catalogue.TREES, catalogue.BUFFERED], ids=["trees", "buffered"])
def test_jvm_trees_are_the_python_ones(spark, monkeypatch, kinds):
    kinds = {k: c | ({"domain": DOMAIN} if c["kind"] == "hilbert" else {}) for k, c in kinds.items()}
    log = spark.createDataFrame(_rows(700, 5), "seq long, op string, p long, xmin double, ymin double, xmax double, ymax double, old_p long, old_xmin double, old_ymin double, old_xmax double, old_ymax double")
    log = log.withColumn("idx_id", F.explode(F.array(*[F.lit(i) for i in kinds])))
    device = flash.DeviceConfig(blocks=8, pages_per_block=8, wear_gap=2)

    def every():
        made = (
            trees.grow(log, kinds), trees.grow_at(log, kinds, {k: [(100 + k, 300), (200 + k, None)] for k in kinds}), trees.answers(log, kinds), trees.requests(log, kinds),
            trees.cached(log, kinds, "HLRU", 16), trees.cached(log, kinds, "LRU", 30), trees.run_workload(log, kinds, 500), trees.device_totals(log, kinds, device, 4096),
        )
        return [sorted(map(str, df.collect())) for df in made]

    jvm = every()
    monkeypatch.setattr(native, "run", lambda *_: None)
    assert jvm == every() and all(jvm)


#: Queries whose trees are grown without a Python worker.
NATIVE = ["buffered_tree_entries", "grown_tree_entries", "grown_tree_window_counts", "buffered_tree_window_counts", "buffered_tree_requests"]


@pytest.mark.parametrize("name", NATIVE)
def test_trees_grow_on_the_jvm(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "MapPartitions" in plan and "InArrow" not in plan and "InPandas" not in plan
