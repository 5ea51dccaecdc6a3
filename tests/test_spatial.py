"""Spatial operators against brute force and their own laws."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as g
from gridloom.functions.boxes import box, node_capacity, to_wkt
from gridloom.functions.hilbert import cell_of, hilbert, hilbert_array
from gridloom.functions.predicates import Predicate, box_test, exact
from gridloom.functions.sweep import union_area
from gridloom.operators import flash, oplog, packing, selection, traces, workloads, write_buffers
from gridloom.operators.splits import SPLITS
from gridloom.operators.trees import make_tree, run_workload
from gridloom.plans import schema
from gridloom.sources import datasets

E = 1e-5
PAIRS = [
    (0, 0, 2, 2, 0, 0, 2, 2), (0, 0, 2, 2, 2, 2, 3, 3), (0, 0, 2, 2, 2, 0, 3, 2), (0, 0, 2, 2, 2 + E / 2, 0, 3, 2), (0, 0, 2, 2, 2 + 2 * E, 0, 3, 2),
    (1, 1, 2, 2, 0, 0, 3, 3), (0, 0, 2, 2, 0, 0, 3, 3), (0, 1, 3, 2, 0, 0, 3, 3), (1, 1, 1, 1, 0, 0, 3, 3), (3, 3, 3, 3, 0, 0, 3, 3), (0, 0, 4, 4, 1, 1, 6, 6),
    (0, 0, 0, 5, 0, 0, 2, 5), (5, 5, 6, 6, 0, 0, 1, 1), (1, 1, 1, 1, 1, 1, 1, 1), (0, 1, 4, 1, 2, 1, 6, 1), (0, 1, 4, 1, 2, 0, 2, 3),
]


@pytest.fixture(scope="module")
def pairs(spark):
    cols = [f"{s}_{c}" for s in "ab" for c in ("xmin", "ymin", "xmax", "ymax")]
    return spark.createDataFrame([tuple(map(float, p)) for p in PAIRS + [(*p[4:], *p[:4]) for p in PAIRS]], cols)


def test_box_laws(pairs):
    a, b = box("a_"), box("b_")
    t = {p.name: box_test(a, b, p) for p in Predicate}
    back = {p.name: box_test(b, a, p) for p in Predicate}
    rows = pairs.select(*[c.alias(n) for n, c in t.items()], *[c.alias(f"back_{n}") for n, c in back.items()]).collect()
    for r in rows:
        assert r["DISJOINT"] != r["INTERSECTS"]
        assert not r["INSIDE"] or r["INSIDE_OR_COVEREDBY"]
        assert not r["COVEREDBY"] or r["INSIDE_OR_COVEREDBY"]
        assert r["CONTAINS"] == r["back_INSIDE"] and r["COVERS"] == r["back_COVEREDBY"]
        assert not r["EQUAL"] or (r["COVERS"] and r["COVEREDBY"])
        assert r["INTERSECTS"] == (r["MEET"] or r["OVERLAP"])
    assert [r["INTERSECTS"] for r in rows[:5]] == [True, True, True, True, False]


def test_exact_boxes_agree_with_geometries(pairs):
    """The column tests and the vertex-based ones are written apart and must agree."""

    def shape(x0, y0, x1, y1):
        if x0 == x1 and y0 == y1:
            return g.Shape(g.POINT, (x0, y0))
        if x0 == x1 or y0 == y1:
            return g.Shape(g.LINE, [(x0, y0), (x1, y1)])
        return g.Shape(g.POLYGON, [[(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]])

    tests = [p for p in Predicate if p <= 9 and p != Predicate.OVERLAP]
    rows = pairs.select("*", *[exact(box("a_"), box("b_"), p).alias(p.name) for p in tests]).collect()
    for r in rows:
        a, b = shape(*r[:4]), shape(*r[4:8])
        for p in tests:
            assert r[p.name] == g.relate(a, b, int(p)), (p, tuple(r[:8]))


def test_polygons():
    ring = [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)]
    hole = [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
    donut = g.Shape(g.POLYGON, [ring, hole])
    assert donut.locate((2, 2)) == 1 and donut.locate((5, 5)) == -1 and donut.locate((4, 5)) == 0 and donut.locate((0, 3)) == 0
    sq = lambda a, b: g.Shape(g.POLYGON, [[(a, a), (a, b), (b, b), (b, a), (a, a)]])
    assert not g.intersects(sq(4.5, 5.5), donut) and g.intersects(sq(3, 5), donut)
    assert g.covered_by(sq(1, 3), donut) and not g.covered_by(sq(3, 7), donut) and g.inside(sq(1, 3), donut) and not g.inside(sq(0, 3), donut)
    assert g.relate(sq(4, 6), donut, 4)  # fills the hole: borders touch
    two = g.Shape(g.MULTIPOLYGON, [[ring], [[(20, 20), (20, 30), (30, 30), (30, 20), (20, 20)]]])
    assert g.intersects(g.Shape(g.POINT, (25, 25)), two) and not g.intersects(g.Shape(g.POINT, (15, 15)), two)
    wkb = g.encode(g.POLYGON, [ring, hole], srid=3857)
    kind, parts, srid = g.decode(wkb)
    assert (kind, srid) == (g.POLYGON, 3857) and [[tuple(map(float, p)) for p in r] for r in parts] == [[tuple(map(float, p)) for p in r] for r in (ring, hole)]


def test_wkb_column(spark):
    from gridloom.sources.datasets import from_frame

    df = spark.createDataFrame([(1, g.encode(g.POINT, (1.0, 2.0))), (2, g.encode(g.LINE, [(0, 0), (4, 4)])), (3, None)], "k long, geo binary")
    d = from_frame(df, "k", "geo")
    assert [tuple(r) for r in d.orderBy("id").select("xmin", "ymax").collect()] == [(1.0, 2.0), (0.0, 4.0), (None, None)]
    test = g.refine_udf(g.encode(g.POLYGON, [[(0, 0), (0, 3), (3, 3), (3, 0), (0, 0)]]), int(Predicate.INTERSECTS))
    assert [r[0] for r in d.orderBy("id").select(test("wkb")).collect()] == [True, True, None]


def test_wkt(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 2.0, 1.0), (0.0, 0.0, 2.0, 1.0)], "xmin double, ymin double, xmax double, ymax double")
    assert [r[0].split("(")[0] for r in df.select(to_wkt(box())).collect()] == ["POINT", "LINESTRING", "POLYGON"]


def test_capacity():
    assert node_capacity(4096) == (46, 113)
    assert node_capacity(4096, max_fill=0.01)[0] >= 2


def test_hilbert(spark):
    n = 16
    x, y = np.meshgrid(np.arange(n), np.arange(n))
    d = hilbert_array(x.ravel(), y.ravel(), 4)
    assert sorted(d.tolist()) == list(range(n * n))
    at = [cell_of(int(i), 4) for i in range(n * n)]
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(at, at[1:]))
    assert all(cell_of(int(v), 4) == (a, b) for v, a, b in zip(d, x.ravel().tolist(), y.ravel().tolist()))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x.ravel(), y.ravel())], "x long, y long")
    assert [r[0] for r in df.select(hilbert(F.col("x"), F.col("y"), 4)).collect()] == d.tolist()


def test_union_area():
    r = random.Random(4)
    b = np.array([(x, y, x + r.randint(1, 4), y + r.randint(1, 4)) for x, y in ((r.randint(0, 12), r.randint(0, 12)) for _ in range(30))], float)
    cells = {(i, j) for x0, y0, x1, y1 in b.astype(int).tolist() for i in range(x0, x1) for j in range(y0, y1)}
    assert union_area(b) == len(cells)


def boxes(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, s = r.uniform(0, 100), r.uniform(0, 100), r.choice([0, 0.5, 3, 30])
        rows.append((i, x, y, x + s * r.random(), y + s * r.random()))
    return spark.createDataFrame(rows, "id long, xmin double, ymin double, xmax double, ymax double"), rows


def meets(w, b):
    return w[0] <= b[2] and b[0] <= w[2] and w[1] <= b[3] and b[1] <= w[3]


@pytest.mark.parametrize("few", [0, 100_000])
def test_batch_is_every_single_query(spark, monkeypatch, few):
    """With the queries' cells in a shuffle, and sent to the objects."""
    monkeypatch.setattr(selection, "BROADCAST_CELLS", few)
    data, rows = boxes(spark)
    q = [(1, 10, 10, 40, 40), (2, -5, -5, 200, 200), (3, 50, 50, 50, 50), (4, 99, 0, 300, 4), (5, 300, 300, 301, 301)]
    got = {tuple(r) for r in selection.batch_query(data, workloads.windows(spark, q)).collect()}
    assert got == {(k, i) for k, *w in q for i, *b in rows if meets(w, b)}
    assert selection.batch_query(data.limit(0), workloads.windows(spark, q)).count() == 0
    # objects of one size only, small and large: the levels between are none's
    for size in (1.0, 25.0):
        same = data.withColumns({"xmax": F.col("xmin") + size, "ymax": F.col("ymin") + size})
        got = {tuple(r) for r in selection.batch_query(same, workloads.windows(spark, q)).collect()}
        assert got == {(k, i) for k, *w in q for i, x, y, *_ in rows if meets(w, (x, y, x + size, y + size))}


def test_disjoint_is_the_complement(spark):
    data, rows = boxes(spark)
    w = (20.0, 20.0, 60.0, 60.0)
    ids = lambda p: {r["id"] for r in selection.spatial_query(data, 1, w, p).collect()}
    assert ids(Predicate.DISJOINT) | ids(Predicate.INTERSECTS) == {r[0] for r in rows} and not ids(Predicate.DISJOINT) & ids(Predicate.INTERSECTS)
    none = (500.0, 500.0, 501.0, 501.0)
    assert selection.spatial_query(data, 1, none, Predicate.DISJOINT).count() == len(rows)
    with pytest.raises(ValueError):
        selection.spatial_query(data, 3, w, Predicate.INTERSECTS)
    with pytest.raises(ValueError):
        selection.spatial_query(data, 1, (2, 2, 1, 1), Predicate.INTERSECTS)


def test_packed_tree(spark):
    data, rows = boxes(spark, 300)
    tree = packing.packed_tree(data, 5).cache()
    e = tree.collect()
    assert sorted(r["pointer"] for r in e if r["height"] == 0) == list(range(300))
    parts = {(r["height"], r["node_id"]): [] for r in e}
    for r in e:
        parts[r["height"], r["node_id"]].append(r)
    for r in e:
        if r["height"]:
            below = parts[r["height"] - 1, r["pointer"]]
            assert (r["xmin"], r["ymax"]) == (min(x["xmin"] for x in below), max(x["ymax"] for x in below))
    w = (20.0, 20.0, 60.0, 60.0)
    assert {r["id"] for r in packing.tree_query(tree, w).collect()} == {i for i, *b in rows if meets(w, b)}
    s = packing.structure_snapshot(tree).first()
    assert s["nodes"] == len(parts) and s["leaf_nodes"] == 60
    assert packing.dead_space(tree).where("dead_space < 0").count() == 0


@pytest.mark.parametrize("kind,split", [("rtree", s) for s in SPLITS] + [("rstar", ""), ("hilbert", ""), ("overflow", "linear")])
def test_grown_tree_is_brute_force(kind, split):
    r = random.Random(len(kind) + len(split))
    t = make_tree(kind, 2, 5, split or "quadratic", domain=(0.0, 0.0, 100.0, 100.0))
    live = {}
    for s in range(600):
        if live and r.random() < 0.4:
            p = r.choice(list(live))
            assert t.delete(p, live.pop(p))
            assert not t.delete(p, (0, 0, 1, 1))
        else:
            x, y = r.uniform(0, 95), r.choice([r.uniform(0, 95), 50.0])
            live[s] = (x, y, x + r.uniform(0, 5), y)
            t.insert(s, live[s])
        if s % 40 == 0:
            assert sorted(t.search((20, 20, 60, 70), 0)) == sorted(p for p, b in live.items() if meets((20, 20, 60, 70), b))
    assert sorted(e[4] for e in t.entries() if e[1] == 0) == sorted(live)
    assert all(len(n.boxes) <= 5 for n in t.nodes.values())


def test_workload_trace(spark):
    data, _ = boxes(spark, 60)
    log = data.select(F.lit(1).alias("idx_id"), F.col("id").alias("seq"), F.lit("INSERT").alias("op"), F.col("id").alias("p"), "xmin", "ymin", "xmax", "ymax")
    trace = run_workload(log, {1: {"kind": "rtree", "least": 2, "most": 5}})
    r = trace.agg(F.count("*").alias("n"), F.max("rw_order").alias("m")).first()
    assert r["n"] == r["m"] > 60


def a_trace(spark, pages, writes=None):
    rows = [(1, i + 1, "WRITE" if writes and writes[i] else "READ", p) for i, p in enumerate(pages)]
    return spark.createDataFrame(rows, "pe_id int, rw_order int, op_type string, page_id int")


def test_lru_by_distance_is_lru_by_replay(spark):
    r = random.Random(5)
    t = a_trace(spark, [int(r.paretovariate(0.7)) % 40 for _ in range(500)])
    curve = {x["slots"]: x["hits"] for x in traces.lru_curve(t, [1, 3, 10, 30]).collect()}
    assert [curve[n] for n in (1, 3, 10, 30)] == [traces.replay(t, "LRU", n).first()["hits"] for n in (1, 3, 10, 30)]
    assert sorted(curve.values()) == [curve[n] for n in (1, 3, 10, 30)]
    for policy in traces.POLICIES:
        x = traces.replay(t, policy, 8).first()
        assert x["hits"] + x["faults"] == 500


def test_two_touches():
    c = traces.SimplifiedTwoQueue(4, 4)
    assert [c.request(1, False), c.request(1, False), c.request(1, False)] == [False, False, True]
    h = traces.HeightLRU(1)
    assert [h.request(1, False, 2), h.request(2, False, 0), h.request(1, False, 2)] == [False, False, True]


def test_runs(spark):
    t = a_trace(spark, [1, 2, 3, 7, 8, 3, 4], [0, 0, 0, 0, 0, 0, 1])
    assert sorted(r["pages"] for r in traces.coalesced_runs(t).collect()) == [1, 1, 2, 3]


def test_flash_keeps_every_page():
    r = random.Random(3)
    d = flash.Device(flash.DeviceConfig(blocks=6, pages_per_block=4, wear_gap=2))
    live = set()
    for _ in range(600):
        p = r.randrange(12)
        d.write(p)
        live.add(p)
        if r.random() < 0.05:
            q = r.choice(sorted(live))
            d.release(q)
            live.discard(q)
        assert d.live_pages() == len(live) == len(d.map)
    assert d.erased == sum(d.erases) > 0 and max(d.erases) - min(d.erases) < d.erased
    assert d.writes == 600 + d.moved


@pytest.mark.parametrize("policy", ["all", "random", "most", "most_and_oldest", "value"])
def test_write_buffer(policy):
    r = random.Random(6)
    b = write_buffers.WriteBuffer(write_buffers.BufferConfig(capacity=600, policy=policy, oldest=0.6))
    out = []
    for _ in range(300):
        out += b.change(r.randrange(40), r.randrange(3), r.random(), r.random())
        assert b.used <= 600 and b.used == sum(9 + 40 * p.changes for p in b.pages.values())
    out += b.flush_all()
    assert not b.pages and b.used == 0 and len(out) == b.flushed_pages


def test_oplog(spark):
    r = random.Random(9)
    rows, live = [], {}
    for s in range(400):
        p = r.randrange(20)
        op = r.choice(["INSERT", "DELETE"])
        rows.append((1, s, op, p, 0.0, 0.0, 1.0, 1.0, None, None, None, None, None))
        live[p] = live.get(p, 0) + 1 if op == "INSERT" else max(0, live.get(p, 0) - 1)
    box4 = "xmin double, ymin double, xmax double, ymax double"
    log = spark.createDataFrame(rows, f"idx_id int, seq long, op string, p long, {box4}, old_p long, old_xmin double, old_ymin double, old_xmax double, old_ymax double")
    want = {p: n for p, n in live.items() if n}
    assert {x["id"]: x["copies"] for x in oplog.live_entries(log).collect()} == want
    assert {x["id"]: x["n"] for x in oplog.replay(log).groupBy("id").agg(F.count("*").alias("n")).collect()} == want


def test_generators(spark):
    region = (0.0, 0.0, 100.0, 50.0)
    w = workloads.random_windows(spark, region, 1.0, 50).collect()
    assert len(w) == 50 and all(math.isclose((r["xmax"] - r["xmin"]) * (r["ymax"] - r["ymin"]), 50.0, rel_tol=1e-6) for r in w)
    data, rows = boxes(spark)
    c = workloads.correlated_windows(data, (0.0, 0.0, 100.0, 100.0), 1.0, 20, containment=True).collect()
    assert len(c) == 20 and all(any(q["xmin"] < b[0] and b[2] < q["xmax"] and q["ymin"] < b[1] and b[3] < q["ymax"] for _, *b in rows) for q in c)
    assert workloads.random_points(spark, region, 10).collect() == workloads.random_points(spark, region, 10).collect()


def test_schema(spark, tmp_path):
    assert schema.parse_buffer("s2q(50%)") == ("S2Q", (0.5,)) and schema.parse_buffer("HLRU") == ("HLRU", ())
    for bad in ("2Q(10%)", "S2Q(0%)", "MRU", "2Q(1%,2%"):
        with pytest.raises(ValueError):
            schema.parse_buffer(bad)
    assert schema.index_path("/a/b/c") == ("/a/b/", "c")
    reg = schema.Register(spark, str(tmp_path))
    for k in range(2):
        with reg.run("test", 7) as row:
            row["cand_num"] = 10 + k
    got = reg.read("execution", schema.EXECUTION).orderBy("pe_id").collect()
    assert [(r["pe_id"], r["idx_id"], r["cand_num"]) for r in got] == [(1, 7, 10), (2, 7, 11)] and got[0]["total_time"] >= 0
    line = schema.as_script(spark.createDataFrame([(1, "it's", None)], "a int, b string, c double"), "t").first()[0]
    assert line == "INSERT INTO t (a, b, c) VALUES (1, 'it''s', NULL);"


def test_stream(spark, tmp_path):
    from gridloom.streaming.caches import cache_stream

    pages = [1, 2, 1, 3, 2, 1, 4, 1]
    a_trace(spark, pages).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("pe_id int, rw_order int, op_type string, page_id int").parquet(str(tmp_path / "in"))
    q = cache_stream(s, "LRU", 2).writeStream.format("memory").queryName("cached").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = traces.replay(a_trace(spark, pages), "LRU", 2).first()
    assert [tuple(r) for r in spark.table("cached").select("hits", "faults").collect()] == [(want["hits"], want["faults"])]


def test_split_report_names_what_it_skips(spark):
    from gridloom.operators import trees

    nodes = spark.createDataFrame([(k, float(i), 0.0, i + 1.0, 1.0) for k, n in ((1, 12), (2, 13)) for i in range(n)], "node_id long, xmin double, ymin double, xmax double, ymax double")
    got = {(x["node_id"], x["split"]): x for x in trees.split_report(nodes, 2).collect()}
    assert set(got) == {(k, name) for k in (1, 2) for name in trees.SPLITS}
    assert all((x["n_left"] is None) == (x["area"] is None) == (x["overlap"] is None) == (key == (2, "exponential")) for key, x in got.items())
    assert got[1, "exponential"]["n_left"] + got[1, "exponential"]["n_right"] == 12


def test_multiple_and_empty_geometries(spark):
    """Multi-points, multi-lines, collections and empty geometries against tests on their parts."""
    sh = lambda k, p: g.Shape.of(g.encode(k, p))
    square = [[(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]]
    many = sh(g.MULTIPOINT, [(1, 1), (9, 9)])
    assert g.relate(many, sh(g.POLYGON, square), 1) and not g.relate(many, sh(g.POLYGON, square), 6) and many.bounds() == (1, 1, 9, 9)
    assert g.relate(sh(g.MULTIPOINT, [(1, 1), (2, 2)]), sh(g.POLYGON, square), 5)
    lines = sh(g.MULTILINE, [[(0, 0), (2, 0)], [(2, 0), (4, 0)], [(9, 0), (9, 5)]])
    assert lines.locate((2, 0)) == 1 and lines.locate((0, 0)) == 0 and lines.locate((9, 2)) == 1 and lines.locate((5, 5)) == -1
    mixed = sh(g.COLLECTION, [(g.POINT, (20.0, 20.0)), (g.POLYGON, square), (g.LINE, [(5, 5), (6, 6)])])
    assert mixed.dimension == 2 and mixed.locate((1, 1)) == 1 and mixed.locate((20, 20)) == 1 and mixed.locate((5, 5)) == 0
    assert g.relate(mixed, sh(g.POINT, (20.0, 20.0)), 1) and g.relate(sh(g.POINT, (7.0, 7.0)), mixed, 3)
    nothing = [sh(g.POLYGON, []), sh(g.COLLECTION, []), sh(g.MULTILINE, []), sh(g.POINT, (float("nan"), float("nan")))]
    assert all(x.empty and x.bounds() is None and g.relate(x, mixed, 3) and not g.relate(x, mixed, 6) for x in nothing)
    rows = [(1, g.encode(g.POLYGON, square)), (2, g.encode(g.POLYGON, [])), (3, None), (4, g.encode(g.MULTIPOINT, [(1.0, 1.0), (8.0, 8.0)]))]
    data = datasets.from_frame(spark.createDataFrame(rows, "id long, geom binary"), "id", "geom")
    ask = lambda p, **k: {r["id"] for r in selection.geometry_query(data, 1, g.encode(g.POINT, (1.0, 1.0)), p, **k).collect()}
    assert ask(1) == {1, 4} and ask(3) == {2} and ask(5) == {1, 4} and ask(1, option=2) == {1, 4}
    for kind, wkb in ((3, g.encode(g.LINE, [(0, 0), (1, 1)])), (1, g.encode(g.POLYGON, []))):
        with pytest.raises(ValueError):
            selection.geometry_query(data, kind, wkb, 1)
    assert {r["id"] for r in selection.geometry_query(data, 2, g.encode(g.LINE, [(3.0, 3.0), (9.0, 9.0)]), 1).collect()} == {1, 4}


def test_page_bridge_and_fitted_device():
    from gridloom.operators.flash import Device, DeviceConfig, PageBridge, fitted

    c = fitted(DeviceConfig(blocks=4, pages_per_block=4), 100)
    assert c.blocks == 35 and fitted(DeviceConfig(), 10).blocks == 1024
    large = PageBridge(Device(c), 8192)
    large.write(3)
    large.read(3)
    assert list(large.pages(3)) == [12, 13, 14, 15] and (large.device.writes, large.device.reads) == (4, 4)
    large.release(3)
    assert large.device.live_pages() == 0
    small = PageBridge(Device(c), 512)
    small.write(5)
    small.write(6)
    assert list(small.pages(5)) == list(small.pages(6)) == [1] and (small.device.writes, small.device.reads) == (2, 1)
    with pytest.raises(ValueError):
        PageBridge(Device(c), 3000)
    d = Device(c)
    for k in range(2000):
        d.write(k % 100)
    assert d.live_pages() == 100 and d.erased
