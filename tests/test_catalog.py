"""The catalog's rules, buffered trees against plain ones, and generators in regions."""

import random

import pytest

from gridloom.functions import geometry as g
from gridloom.functions.hilbert import domain_of_srid
from gridloom.operators import flash, workloads
from gridloom.operators.splits import SPLITS
from gridloom.operators.trees import make_tree
from gridloom.operators.write_buffers import BufferConfig, WriteBuffer
from gridloom.plans import schema
from gridloom.plans.catalog import KINDS, OPTIONS, Catalog, Keep


@pytest.fixture()
def catalog(spark):
    c = Catalog(spark)
    r = random.Random(1)
    rows = [(i, x, y, x + r.random(), y + r.random()) for i in range(120) for x, y in [(r.uniform(0, 50), r.uniform(0, 50))]]
    c.add_source(1, spark.createDataFrame(rows, "id long, xmin double, ymin double, xmax double, ymax double"))
    c.add_basic(1, 2048, device=flash.DeviceConfig(blocks=8, pages_per_block=4))
    c.add_special(1, 2, 6, domain=(0, 0, 100, 100))
    c.add_special(2, 2, 6, domain=(0, 0, 100, 100), buffer={"design": "fast"})
    c.add_buffer(2, "2Q(25%, 50%)", 8192)
    return c


def test_create_checks_its_arguments(catalog):
    for bad in ((11, "/a", 1, 1, 1), (1, "/a", 9, 1, 1), (1, "/a", 1, 9, 1), (1, "/a", 1, 1, 9), (1, "/a", 1, 1, 1, 9), (4, "/a", 1, 1, 1), (8, "/a", 1, 1, 2), (1, "/a", 1, 1, 2)):
        with pytest.raises(ValueError):
            catalog.create_empty(*bad)
    assert catalog.create_empty(1, "/a", 1, 1, 1) and catalog.indices["/a"].buf_id == 1
    first = catalog.process("/a", 1, 1, 1, 1)
    assert catalog.process("/a", 1, 1, 1, 1) == first != catalog.process("/b", 1, 1, 1, 1)
    with pytest.raises(KeyError):
        catalog.insert("/none", 1, (0, 0, 1, 1))


def test_nulls_and_names(catalog):
    catalog.create_empty(1, "/a", 1, 1, 1)
    box = (1.0, 1.0, 2.0, 2.0)
    assert catalog.insert("/a", None, box) is None and catalog.delete("/a", 1, None) is None and catalog.update("/a", 1, box, 2, None) is None
    assert catalog.query("/a", 1, None, 1).count() == 0 and catalog.entries("/a").count() == 0
    assert catalog.insert("/a", 1, box) and catalog.insert("/a", 1, box) and catalog.delete("/a", 7, box)
    assert catalog.entries("/a").count() == 2
    with pytest.raises(ValueError):
        catalog.store("/a")
    catalog.set_execution_name("always")
    catalog.set_execution_name("once", 2)
    one, two = catalog.a_query("/a", 2, (0, 0, 9, 9), 1), catalog.a_query("/a", 2, (0, 0, 9, 9), 1, store=99)
    runs = {r["pe_id"]: r for r in catalog.table("execution").collect()}
    assert runs[one]["execution_name"] == "once" and runs[two]["execution_name"] == "always" and runs[one]["result_num"] == runs[one]["cand_num"] == 2
    assert runs[one]["visited_leaf_nodes_num"] == 1 and runs[one]["accesses_pheight"][0]["nofreads"] == 1 and runs[one]["written_leaf_nodes_num"] == 0
    assert len(runs[one]) == len(schema.T._parse_datatype_string(schema.EXECUTION).fields) == 80
    assert catalog.query("/a", 1, (0, 0, 9, 9), 1, 2).where("geo is not null").count() == 0


def test_options_keep_what_they_say(catalog, spark, tmp_path):
    catalog.create(4, "/a", 1, 1, 2, flush=True, option=8)
    assert {t: catalog.table(t).count() for t in ("execution", "snapshot", "flash")} == {"execution": 1, "snapshot": 1, "flash": 1}
    assert catalog.table("print_index").where("node_height = 0").count() == 120 and catalog.table("print_index").where("parent_node = -1").count() > 0
    assert OPTIONS[3] & Keep.SNAPSHOT and not OPTIONS[1] and OPTIONS[5] == Keep.DEVICE
    catalog.start(trace=True)
    catalog.insert("/a", 500, (1, 1, 2, 2))
    pe = catalog.store("/a", 1, location=2)
    lines = [r["statement"] for s in catalog.scripts for r in s.collect()]
    assert sum(x.startswith("INSERT INTO execution (pe_id") for x in lines) == 1
    run = catalog.table("execution").where(f"pe_id = {pe}").first()
    assert run["mod_node_buffer_num"] >= 1 and run["flushing_num"] == 0
    catalog.save(str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept/execution")).count() == 2
    with pytest.raises(ValueError):
        catalog.snapshot("/a", 99)


def test_register_gives_each_number_once(spark, tmp_path):
    r = schema.Register(spark, str(tmp_path))
    assert [r.next_id("execution", schema.EXECUTION, "pe_id") for _ in range(3)] == [1, 2, 3]
    with pytest.raises(RuntimeError):
        with r.run("fails", 1):
            raise RuntimeError("inside")
    assert r.read("execution", schema.EXECUTION).first()["execution_name"] == "fails"


@pytest.mark.parametrize("kind", [k for k, (_, design) in KINDS.items() if design])
def test_buffered_trees_are_the_plain_ones(kind):
    """The same random operations with and without buffers: answers during, entries after."""
    base, design = KINDS[kind]
    more = {"domain": (0.0, 0.0, 100.0, 100.0)} if base == "hilbert" else {}
    buffers = {
        "fast": ({"policy": "all"}, {"policy": "random", "capacity": 900}, {"policy": "most_and_oldest", "capacity": 1500}),
        "cold": ({}, {"capacity": 900, "warm": 0.5}, {"capacity": 600, "warm": 1.0}),
        "tuned": ({"value": "overlap", "read_policy": "2Q"}, {"value": "area", "capacity": 2000}),
    }
    for buffer in buffers[design]:
        r = random.Random(kind)
        plain, behind = make_tree(base, 2, 5, **more), make_tree(base, 2, 5, **more, buffer={"design": design, **buffer})
        live = {}
        for k in range(500):
            if live and r.random() < 0.35:
                p = r.choice(sorted(live))
                b = live.pop(p)
                assert plain.delete(p, b) == behind.delete(p, b) is True
            else:
                x, y = r.uniform(0, 90), r.uniform(0, 90)
                live[k] = b = (x, y, x + r.random() * 5, y + r.random() * 5)
                plain.insert(k, b)
                behind.insert(k, b)
            if k % 20 == 0:
                w = (x := r.uniform(0, 90), y := r.uniform(0, 90), x + 15, y + 15)
                want = sorted(p for p, c in live.items() if not (c[0] > w[2] or c[2] < w[0] or c[1] > w[3] or c[3] < w[1]))
                assert sorted(behind.search(w)) == sorted(plain.search(w)) == want
        behind.flush()
        leaves = lambda t: sorted((e[4], *e[5:9]) for e in t.entries() if e[1] == 0)
        assert leaves(behind) == leaves(plain) == sorted((p, *b) for p, b in live.items())
        s = behind.store
        assert not s.pending and s.device_writes > 0 and s.merged_reads > 0
        assert all(s.content(n)[i][:2] == s.device[n.id][i][:2] for n in behind.nodes.values() for i in range(len(n.pointers)))


def test_cold_units_go_first():
    b = WriteBuffer(BufferConfig(policy="cold", capacity=10_000, unit_pages=2, warm=0.5))
    for page in (1, 2, 3, 4, 5, 6, 1, 1, 1, 5, 5, 2):
        b.change(page)
    assert list(b.warm) == [5, 5, 2] and b.flush() == [3, 4]  # 1 and 2 have most changes, but 2 and 5 are warm
    assert b.flush() == [1, 2]  # no unit is cold: the first


def test_domains_and_least_entries():
    assert domain_of_srid(3857)[0] == -20037508.3427892
    with pytest.raises(ValueError):
        domain_of_srid(31370)
    with pytest.raises(ValueError):
        make_tree("hilbert", 2, 5, domain=(0.0, 0.0, 1.0, 1.0)).insert(1, (5, 5, 6, 6))
    import numpy as np

    b = np.array([[i * i, 0, i * i + 1, 1] for i in range(9)], float)
    left, right = SPLITS["angtan"](b, 4)
    assert sorted(left + right) == list(range(9)) and min(len(left), len(right)) >= 4


def test_generators_in_a_region(spark):
    ring = [(0.0, 0.0), (100.0, 0.0), (0.0, 100.0), (0.0, 0.0)]
    region = g.encode(g.POLYGON, [ring])
    points = workloads.random_points(spark, region, 40).collect()
    assert len(points) == 40 and all(p["xmin"] + p["ymin"] <= 100 for p in points)
    windows = workloads.random_windows(spark, region, 4.0, 30).collect()
    assert len(windows) == 30 and all(w["xmin"] + w["ymin"] < 100 for w in windows)
    data = spark.createDataFrame([(i, float(i), float(i), i + 1.0, i + 1.0) for i in range(100)], "id long, xmin double, ymin double, xmax double, ymax double")
    near = workloads.correlated_windows(data, region, 1.0, 500).collect()
    assert 0 < len(near) < 100 and all(w["xmin"] + w["ymin"] <= 100 for w in near)
    assert workloads.correlated_points(data, 500, region=region).count() == 50
    with pytest.raises(ValueError):
        workloads.random_points(spark, g.encode(g.POLYGON, []), 5)
