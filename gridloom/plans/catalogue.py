"""All spatial queries by name, with the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.boxes import EPSILON, area, box, center_distance2, expansion, literal_box, margin, node_capacity, overlap_area, to_wkt, union
from ..functions.predicates import Predicate
from . import catalog, schema
from ..operators import flash, oplog, packing, selection, traces, trees, tuned_buffers, workloads, write_buffers
from ..operators.splits import SPLITS
from ..sources import datasets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The boxes of each dataset in SQL.
SQL_DATA = {
    "part_pts": "SELECT p_partkey::BIGINT AS id, p_size::DOUBLE AS xmin, p_retailprice AS ymin, p_size::DOUBLE AS xmax, p_retailprice AS ymax FROM part",
    "cust_pts": "SELECT c_custkey AS id, c_nationkey::DOUBLE AS xmin, c_acctbal AS ymin, c_nationkey::DOUBLE AS xmax, c_acctbal AS ymax FROM customer",
    "order_pts": "SELECT o_orderkey AS id, o_custkey::DOUBLE AS xmin, o_totalprice AS ymin, o_custkey::DOUBLE AS xmax, o_totalprice AS ymax FROM orders",
    "order_rects": "SELECT o_orderkey AS id, o_custkey::DOUBLE AS xmin, o_totalprice AS ymin, (o_custkey + 1 + o_orderkey % 7)::DOUBLE AS xmax, o_totalprice + 10 * (1 + o_orderkey % 11) AS ymax FROM orders",
    "emb_pts": "SELECT vec_id AS id, embedding[1]::DOUBLE AS xmin, embedding[2]::DOUBLE AS ymin, embedding[1]::DOUBLE AS xmax, embedding[2]::DOUBLE AS ymax FROM embeddings",
    "event_pts": "SELECT event_id AS id, user_id::DOUBLE AS xmin, value AS ymin, user_id::DOUBLE AS xmax, value AS ymax FROM events",
}

def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


#: Windows over the orders' rectangles: an edge touch, a point, a line, one apart, one around all, and ordinary ones.
WINDOWS = [
    (1, 100, 50000, 300, 150000), (2, 10, 100000, 20, 101000), (3, 500, 200000, 900, 200500), (4, 50, 60000, 50, 60000), (5, 700, 90000, 700, 240000),
    (6, -100, -100, -50, -50), (7, -10, -10, 1e6, 1e7), (8, 0, 120000, 100.00002, 130000), (9, 250.000005, 1000, 260, 90000), (10, 1, 1, 2, 500000),
]
PART_WINDOW = (10.0, 920.0, 30.0, 960.0)
ORDER_WINDOW = (100.0, 100000.0, 300.0, 180000.0)


def _both(test: str, a: str = "q", b: str = "o") -> str:
    """A test in both dimensions; {a0} {a1} {b0} {b1} stand for the ends."""
    return " AND ".join("(" + test.format(a0=f"{a}{d}min", a1=f"{a}{d}max", b0=f"{b}{d}min", b1=f"{b}{d}max") + ")" for d in "xy")


def sql_box(p: Predicate, a: str, b: str, e: float = EPSILON) -> str:
    P = Predicate
    match p:
        case P.INTERSECTS:
            return _both(f"NOT (({{b0}} - {{a1}} > {e}) OR ({{a0}} - {{b1}} > {e}))", a, b)
        case P.INSIDE:
            return _both(f"({{a0}} - {{b0}} > {e}) AND ({{b1}} - {{a1}} > {e})", a, b)
        case P.INSIDE_OR_COVEREDBY:
            return _both(f"({{b0}} - {{a0}} <= {e}) AND ({{a1}} - {{b1}} <= {e})", a, b)
        case P.COVEREDBY:
            return sql_box(P.INSIDE_OR_COVEREDBY, a, b, e) + " AND " + _both(f"(abs({{a0}} - {{b0}}) <= {e}) OR (abs({{a1}} - {{b1}}) <= {e})", a, b)
        case P.CONTAINS:
            return sql_box(P.INSIDE, b, a, e)
        case P.COVERS:
            return sql_box(P.COVEREDBY, b, a, e)
        case P.EQUAL:
            return _both(f"(abs({{a0}} - {{b0}}) <= {e}) AND (abs({{a1}} - {{b1}}) <= {e})", a, b)
    raise ValueError(p)


def sql_exact(p: Predicate, a: str, b: str) -> str:
    P = Predicate
    touch = _both("({a0} <= {b1}) AND ({b0} <= {a1})", a, b)
    inner = _both(
        "CASE WHEN {a0} < {a1} AND {b0} < {b1} THEN greatest({a0}, {b0}) < least({a1}, {b1}) WHEN {a0} < {a1} THEN {a0} < {b0} AND {b0} < {a1} WHEN {b0} < {b1} THEN {b0} < {a0} AND {a0} < {b1} ELSE {a0} = {b0} END", a, b
    )
    cover = lambda u, v: _both("({b0} <= {a0}) AND ({a1} <= {b1})", u, v)
    match p:
        case P.INTERSECTS:
            return touch
        case P.DISJOINT:
            return f"NOT ({touch})"
        case P.MEET:
            return f"({touch}) AND NOT ({inner})"
        case P.COVEREDBY:
            return cover(a, b)
        case P.COVERS:
            return cover(b, a)
        case P.INSIDE:
            return _both("(({b0} < {a0}) AND ({a1} < {b1})) OR ({b0} = {b1} AND {a0} = {b0} AND {a1} = {b1})", a, b)
        case P.CONTAINS:
            return sql_exact(P.INSIDE, b, a)
        case P.EQUAL:
            return _both("({a0} = {b0}) AND ({a1} = {b1})", a, b)
        case P.OVERLAP:
            return _both("({a0} < {a1}) = ({b0} < {b1})", a, b) + f" AND ({inner}) AND NOT ({cover(a, b)}) AND NOT ({cover(b, a)})"
    raise ValueError(p)


#: Windows made of an object's box: strictly inside it, its lower quarter, itself, itself and more above, its centre, its corner.
MADE = {
    "inner": ("xmin + (xmax - xmin) * 0.25", "ymin + (ymax - ymin) * 0.25", "xmax - (xmax - xmin) * 0.25", "ymax - (ymax - ymin) * 0.25"),
    "quarter": ("xmin", "ymin", "xmin + (xmax - xmin) * 0.5", "ymin + (ymax - ymin) * 0.5"),
    "same": ("xmin", "ymin", "xmax", "ymax"),
    "more": ("xmin", "ymin", "xmax + 100", "ymax + 5000"),
    "centre": ("(xmin + xmax) * 0.5", "(ymin + ymax) * 0.5", "(xmin + xmax) * 0.5", "(ymin + ymax) * 0.5"),
    "corner": ("xmax", "ymax", "xmax", "ymax"),
}


def made_windows(data: DataFrame, rule: str, first: int, base: int = 0) -> DataFrame:
    """Windows (qid, box) made of the objects with the least ids."""
    return data.orderBy("id").limit(first).select((F.col("id") + base).cast("int").alias("qid"), *[F.expr(e).cast("double").alias(c) for e, c in zip(MADE[rule], ("xmin", "ymin", "xmax", "ymax"))])


def made_sql(data: str, rule: str, first: int, base: int = 0) -> str:
    cols = ", ".join(f"({e})::DOUBLE AS q{c}" for e, c in zip(MADE[rule], ("xmin", "ymin", "xmax", "ymax")))
    return f"SELECT (id + {base})::INTEGER AS qid, {cols} FROM (SELECT * FROM ({SQL_DATA[data]}) ORDER BY id LIMIT {first})"


def _window_sql(w: tuple) -> str:
    return "SELECT " + ", ".join(f"{float(v)!r}::DOUBLE AS q{c}" for c, v in zip(("xmin", "ymin", "xmax", "ymax"), w))


def _objects_sql(data: str) -> str:
    return f"SELECT id, xmin AS oxmin, ymin AS oymin, xmax AS oxmax, ymax AS oymax FROM ({SQL_DATA[data]})"


def _add_selection(name: str, data: str, kind: selection.QueryType, window: tuple | str, p: Predicate, option: selection.Option = selection.Option.FILTER_AND_REFINE) -> None:
    """window: a box, or a rule of MADE for the object with the least id."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        objects = datasets.load(spark, folder, data)
        w = tuple(made_windows(objects, window, 1).first())[1:] if isinstance(window, str) else window
        return selection.spatial_query(objects, kind, w, p, option).select("id")

    P = Predicate
    filt = {P.OVERLAP: P.INTERSECTS, P.MEET: P.INTERSECTS, P.DISJOINT: P.INTERSECTS, P.INSIDE: P.INSIDE_OR_COVEREDBY, P.COVEREDBY: P.INSIDE_OR_COVEREDBY}.get(p, p)
    if option == selection.Option.FILTER_ONLY or (kind == selection.QueryType.RANGE and p in (P.CONTAINS, P.COVERS)):
        test = sql_box(filt, "q", "o")
    else:
        test = sql_exact(p, "q", "o")
    QUERIES[name] = run
    asked = made_sql(data, window, 1) if isinstance(window, str) else _window_sql(window)
    ORACLE_SQL[name] = f"SELECT id FROM ({_objects_sql(data)}), ({asked}) WHERE {test}"


#: Where an ordinary window would find nothing, one made of an object.
_ASKED = {Predicate.INSIDE: "inner", Predicate.COVEREDBY: "quarter", Predicate.COVERS: "more", Predicate.EQUAL: "same"}
for _p in list(Predicate)[:9]:
    _w = _ASKED.get(_p, ORDER_WINDOW)
    _add_selection(f"range_{_p.name.lower()}", "order_rects", selection.QueryType.RANGE, _w, _p)
    _add_selection(f"select_{_p.name.lower()}", "order_rects", selection.QueryType.SELECTION, _w, _p)
    _add_selection(f"filter_{_p.name.lower()}", "order_rects", selection.QueryType.SELECTION, _w, _p, selection.Option.FILTER_ONLY)
for _p, _data, _w in (
    (Predicate.INTERSECTS, "part_pts", "same"), (Predicate.MEET, "order_rects", "corner"), (Predicate.INSIDE, "order_rects", "centre"), (Predicate.COVEREDBY, "order_rects", "corner"),
    (Predicate.DISJOINT, "order_rects", "centre"), (Predicate.EQUAL, "part_pts", "same"),
):
    _add_selection(f"point_{_p.name.lower()}", _data, selection.QueryType.POINT, _w, _p)
def as_geometries(data: DataFrame) -> DataFrame:
    """A dataset with its boxes as WKB beside them."""
    b = ("xmin", "ymin", "xmax", "ymax")
    return datasets.from_frame(data.select("id", *b, geometry.box_wkb_udf(*b).alias("geom")), "id", "geom", b)


@query("geometry_bounds", f"SELECT * FROM ({SQL_DATA['order_rects']} UNION ALL {SQL_DATA['part_pts']})")
def geometry_bounds(spark, folder):
    """Boxes computed from geometries."""
    both = datasets.load(spark, folder, "order_rects").unionByName(datasets.load(spark, folder, "part_pts"))
    return datasets.from_frame(both.select("id", geometry.box_wkb_udf("xmin", "ymin", "xmax", "ymax").alias("geom")), "id", "geom").drop("wkb")


def _add_geometry(name: str, kind: selection.QueryType, window: tuple | str, p: Predicate, option: selection.Option = selection.Option.FILTER_AND_REFINE) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        objects = datasets.load(spark, folder, "order_rects")
        w = tuple(made_windows(objects, window, 1).first())[1:] if isinstance(window, str) else window
        return selection.geometry_query(as_geometries(objects), kind, geometry.box_wkb(*w), p, option, shortcut=False).select("id")

    QUERIES[name] = run
    asked = made_sql("order_rects", window, 1) if isinstance(window, str) else _window_sql(window)
    test = sql_exact(p, "q", "o") if option == selection.Option.FILTER_AND_REFINE else sql_box(Predicate.INTERSECTS, "q", "o")
    ORACLE_SQL[name] = f"SELECT id FROM ({_objects_sql('order_rects')}), ({asked}) WHERE {test}"


for _p in list(Predicate)[:9]:
    _add_geometry(f"geometry_{_p.name.lower()}", selection.QueryType.SELECTION, _ASKED.get(_p, ORDER_WINDOW), _p)
_add_geometry("geometry_filter", selection.QueryType.SELECTION, ORDER_WINDOW, Predicate.OVERLAP, selection.Option.FILTER_ONLY)
for _p, _w in ((Predicate.INTERSECTS, "centre"), (Predicate.MEET, "corner"), (Predicate.INSIDE, "centre")):
    _add_geometry(f"geometry_point_{_p.name.lower()}", selection.QueryType.POINT, _w, _p)

#: Diamonds around the orders, and a diamond and a point that ask about them; all coordinates are whole, so both sides are exact.
_DIAMONDS = "SELECT o_orderkey AS id, o_custkey AS x, floor(o_totalprice / 100)::BIGINT AS y, 1 + o_orderkey % 7 AS rx, 1 + o_orderkey % 11 AS ry FROM orders"


def _diamonds(spark, folder) -> DataFrame:
    o = spark.read.parquet(f"{folder}/orders.parquet")
    y = F.floor(F.col("o_totalprice") / 100).cast("double")
    wkb = geometry.diamond_wkb_udf(F.col("o_custkey").cast("double"), y, (1 + F.col("o_orderkey") % 7).cast("double"), (1 + F.col("o_orderkey") % 11).cast("double"))
    return datasets.from_frame(o.select(F.col("o_orderkey").alias("id"), wkb.alias("geom")), "id", "geom")


def _add_diamond(name: str, p: Predicate, test: str, at: str = "x", shortcut: bool = True) -> None:
    """at: where the point lies in the diamond with the least id."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        data = _diamonds(spark, folder)
        b = data.orderBy("id").first()
        cx, cy = (b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2
        point = geometry.encode(geometry.POINT, (b["xmax"] if at == "x + rx" else cx, cy))
        return selection.geometry_query(data, selection.QueryType.SELECTION, point, p, shortcut=shortcut).select("id")

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH d AS ({_DIAMONDS}), p AS (SELECT {at} AS px, y AS py FROM d ORDER BY id LIMIT 1) SELECT id FROM (SELECT id, abs(px - x) * ry + abs(py - y) * rx AS d, rx * ry AS r FROM d, p) WHERE {test}"


_add_diamond("diamond_point_shortcut", Predicate.INTERSECTS, "d <= r", "x + rx")
_add_diamond("diamond_point_inside_shortcut", Predicate.INSIDE, "d <= r", "x + rx")
_add_diamond("diamond_point_intersects", Predicate.INTERSECTS, "d <= r", "x + rx", False)
_add_diamond("diamond_point_inside", Predicate.INSIDE, "d < r", "x", False)
_add_diamond("diamond_point_meet", Predicate.MEET, "d = r", "x + rx", False)
_add_diamond("diamond_point_disjoint", Predicate.DISJOINT, "d > r", "x", False)

#: A vertical line from (50, 500) to (50, 2500): the nearest point of it to a diamond's centre decides.
QUERIES["diamond_line_intersects"] = lambda spark, folder: selection.geometry_query(
    _diamonds(spark, folder), selection.QueryType.SELECTION, geometry.encode(geometry.LINE, [(50.0, 500.0), (50.0, 2500.0)]), Predicate.INTERSECTS
).select("id")
ORACLE_SQL["diamond_line_intersects"] = f"SELECT id FROM ({_DIAMONDS}) WHERE abs(50 - x) * ry + greatest(500 - y, y - 2500, 0) * rx <= rx * ry"

_add_selection("range_points_intersects", "part_pts", selection.QueryType.RANGE, PART_WINDOW, Predicate.INTERSECTS)
_add_selection("range_points_contains", "part_pts", selection.QueryType.RANGE, PART_WINDOW, Predicate.CONTAINS)
_add_selection("range_events", "event_pts", selection.QueryType.RANGE, (20.0, 50.0, 60.0, 100.0), Predicate.INTERSECTS)
_add_selection("range_customers", "cust_pts", selection.QueryType.RANGE, (3.0, 0.0, 12.0, 5000.0), Predicate.CONTAINS)
_add_selection("range_embeddings", "emb_pts", selection.QueryType.RANGE, (-0.1, -0.1, 0.1, 0.1), Predicate.INTERSECTS)


_Q = "SELECT * FROM (VALUES " + ", ".join(f"({q}, " + ", ".join(f"{float(v)!r}::DOUBLE" for v in b) + ")" for q, *b in WINDOWS) + ") t(qid, qxmin, qymin, qxmax, qymax)"


_Q_MADE = _Q + "".join(f" UNION ALL {made_sql('order_rects', r, 5, 1000 * (k + 1))}" for k, r in enumerate(MADE))


def _add_batch(p: Predicate) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        data = datasets.load(spark, folder, "order_rects")
        asked = workloads.windows(spark, WINDOWS)
        for k, r in enumerate(MADE):
            asked = asked.unionByName(made_windows(data, r, 5, 1000 * (k + 1)))
        return selection.batch_query(data, asked, p)

    QUERIES[f"range_{p.name.lower()}_batch"] = run
    ORACLE_SQL[f"range_{p.name.lower()}_batch"] = f"SELECT qid, id FROM ({_objects_sql('order_rects')}), ({_Q_MADE}) WHERE {sql_exact(p, 'q', 'o')}"


for _p in (Predicate.INTERSECTS, Predicate.OVERLAP, Predicate.MEET, Predicate.COVEREDBY, Predicate.INSIDE, Predicate.CONTAINS, Predicate.COVERS, Predicate.EQUAL):
    _add_batch(_p)

_COUNTS = f"""SELECT qid, (SELECT count(*) FROM ({_objects_sql('order_rects')}) WHERE {sql_box(Predicate.INTERSECTS, 'q', 'o')}) AS cand_num,
  (SELECT count(*) FROM ({_objects_sql('order_rects')}) WHERE {sql_exact(Predicate.INTERSECTS, 'q', 'o')}) AS result_num FROM ({_Q})"""


@query("query_counts", _COUNTS)
def query_counts(spark, folder):
    return workloads.measured_counts(datasets.load(spark, folder, "order_rects"), workloads.windows(spark, WINDOWS))


@query("execution_summary", f"""SELECT execution_name, count(*) AS runs, round(avg(cand_num), 6) AS avg_cand, round(stddev_samp(cand_num), 6) AS std_cand, round(avg(result_num), 6) AS avg_result, round(stddev_samp(result_num), 6) AS std_result
FROM (SELECT CASE WHEN qid % 2 = 0 THEN 'even' ELSE 'odd' END AS execution_name, cand_num, result_num FROM ({_COUNTS})) GROUP BY 1""")
def execution_summary(spark, folder):
    runs = query_counts(spark, folder).withColumn("execution_name", F.when(F.col("qid") % 2 == 0, "even").otherwise("odd"))
    return workloads.summaries(runs).withColumns({c: F.round(c, 6) for c in ("avg_cand", "std_cand", "avg_result", "std_result")})


@query("complement_fetch", f"SELECT id FROM ({_objects_sql('order_rects')}), ({_window_sql(ORDER_WINDOW)}) WHERE NOT ({sql_exact(Predicate.INTERSECTS, 'q', 'o')})")
def complement_fetch(spark, folder):
    data = datasets.load(spark, folder, "order_rects")
    found = selection.spatial_query(data, selection.QueryType.SELECTION, ORDER_WINDOW, Predicate.INTERSECTS)
    return selection.complement(data, found).select("id")


@query("candidate_fetch", f"SELECT o.* FROM ({SQL_DATA['order_rects']}) o WHERE id IN (SELECT id FROM ({_objects_sql('order_rects')}), ({_window_sql(ORDER_WINDOW)}) WHERE {sql_box(Predicate.INTERSECTS, 'q', 'o')})")
def candidate_fetch(spark, folder):
    data = datasets.load(spark, folder, "order_rects")
    return selection.fetch(data, selection.candidates(data, literal_box(*ORDER_WINDOW), Predicate.INTERSECTS))


@query("dataset_extent", f"SELECT count(*) AS objects, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, round(sum((xmax - xmin) * (ymax - ymin)), 2) AS area FROM ({SQL_DATA['order_rects']})")
def dataset_extent(spark, folder):
    return selection.covered_area(datasets.load(spark, folder, "order_rects")).withColumn("area", F.round("area", 2))


@query("box_measures", f"""SELECT id, (xmax - xmin) * (ymax - ymin) AS area, (xmax - xmin) + (ymax - ymin) AS margin,
  (greatest(xmax, 300.0) - least(xmin, 100.0)) * (greatest(ymax, 180000.0) - least(ymin, 100000.0)) AS union_area,
  (greatest(xmax, 300.0) - least(xmin, 100.0)) * (greatest(ymax, 180000.0) - least(ymin, 100000.0)) - 200.0 * 80000.0 AS expansion,
  CASE WHEN least(xmax, 300.0) > greatest(xmin, 100.0) AND least(ymax, 180000.0) > greatest(ymin, 100000.0)
    THEN (least(xmax, 300.0) - greatest(xmin, 100.0)) * (least(ymax, 180000.0) - greatest(ymin, 100000.0)) ELSE 0.0 END AS overlap,
  ((xmin + xmax) / 2 - 200.0) * ((xmin + xmax) / 2 - 200.0) + ((ymin + ymax) / 2 - 140000.0) * ((ymin + ymax) / 2 - 140000.0) AS distance2
FROM ({SQL_DATA['order_rects']})""")
def box_measures(spark, folder):
    b, w = box(), literal_box(*ORDER_WINDOW)
    return datasets.load(spark, folder, "order_rects").select(
        "id", area(b).alias("area"), margin(b).alias("margin"), area(union(b, w)).alias("union_area"), expansion(w, b).alias("expansion"),
        overlap_area(b, w).alias("overlap"), center_distance2(b, w).alias("distance2"),
    )


@query("box_geometry_kinds", f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN xmin = xmax AND ymin = ymax THEN 'POINT' WHEN xmin = xmax OR ymin = ymax THEN 'LINESTRING' ELSE 'POLYGON' END AS kind FROM ({SQL_DATA['order_rects']} UNION ALL {SQL_DATA['part_pts']})) GROUP BY kind")
def box_geometry_kinds(spark, folder):
    both = datasets.load(spark, folder, "order_rects").unionByName(datasets.load(spark, folder, "part_pts"))
    return both.select(F.regexp_extract(to_wkt(box()), "^[A-Z]+", 0).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


BITS = 8
CAPACITY = node_capacity(4096)[1]
DOMAIN = (0.0, 0.0, 65536.0, 1048576.0)


def _hilbert_sql(data: str, bits: int = BITS, domain: tuple = DOMAIN) -> str:
    x0, y0, x1, y1 = domain
    n = 2**bits
    steps = [
        f"h0 AS (SELECT *, least(floor(((xmin + xmax) / 2 - {x0}) / {x1 - x0} * {n}.0), {n - 1})::BIGINT AS x, least(floor(((ymin + ymax) / 2 - {y0}) / {y1 - y0} * {n}.0), {n - 1})::BIGINT AS y, 0::BIGINT AS d FROM ({SQL_DATA[data]}))"
    ]
    for k, i in enumerate(range(bits - 1, -1, -1)):
        flip = "ry = 0 AND rx = 1"
        steps.append(f"g{k + 1} AS (SELECT * REPLACE (CASE WHEN {flip} THEN {n - 1} - x ELSE x END AS x, CASE WHEN {flip} THEN {n - 1} - y ELSE y END AS y) FROM (SELECT *, (x >> {i}) & 1 AS rx, (y >> {i}) & 1 AS ry FROM h{k}))")
        steps.append(f"h{k + 1} AS (SELECT * EXCLUDE (rx, ry) REPLACE (CASE WHEN ry = 0 THEN y ELSE x END AS x, CASE WHEN ry = 0 THEN x ELSE y END AS y, d * 4 + xor(3 * rx, ry) AS d) FROM g{k + 1})")
    return f"WITH {', '.join(steps)}, lhv AS (SELECT id, xmin, ymin, xmax, ymax, d AS lhv FROM h{bits})"


def _tree_sql(data: str = "order_rects", levels: int = 4) -> str:
    m = CAPACITY
    parts = [
        f"l0 AS (SELECT 0 AS height, r // {m} AS node_id, (r % {m})::INTEGER AS elem_position, id AS pointer, xmin, ymin, xmax, ymax, lhv FROM (SELECT *, row_number() OVER (ORDER BY lhv, id) - 1 AS r FROM lhv))"
    ]
    for h in range(1, levels):
        parts.append(
            f"l{h} AS (SELECT {h} AS height, pointer // {m} AS node_id, (pointer % {m})::INTEGER AS elem_position, pointer, xmin, ymin, xmax, ymax, lhv FROM "
            f"(SELECT node_id AS pointer, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, max(lhv) AS lhv FROM l{h - 1} GROUP BY node_id) WHERE (SELECT count(DISTINCT node_id) FROM l{h - 1}) > 1)"
        )
    every = " UNION ALL ".join(f"SELECT * FROM l{h}" for h in range(levels))
    return f"{_hilbert_sql(data)}, {', '.join(parts)}, tree AS ({every})"


def _tree(spark, folder) -> DataFrame:
    return packing.packed_tree(datasets.load(spark, folder, "order_rects"), CAPACITY, DOMAIN, BITS)


@query("hilbert_values", f"{_hilbert_sql('order_rects')} SELECT id, lhv FROM lhv")
def hilbert_values(spark, folder):
    return packing.with_hilbert(datasets.load(spark, folder, "order_rects"), DOMAIN, BITS).select("id", "lhv")


@query("packed_tree_entries", f"{_tree_sql()} SELECT * FROM tree")
def packed_tree_entries(spark, folder):
    return _tree(spark, folder)


@query("tree_nodes_per_height", f"{_tree_sql()} SELECT height, count(DISTINCT node_id) AS nodes, count(*) AS entries FROM tree GROUP BY height")
def tree_nodes_per_height(spark, folder):
    return packing.nodes_per_height(_tree(spark, folder))


@query("tree_node_metrics", f"""{_tree_sql()} SELECT height, node_id, count(*) AS entries, (max(xmax) - min(xmin)) * (max(ymax) - min(ymin)) AS coverage_area,
  (max(xmax) - min(xmin)) + (max(ymax) - min(ymin)) AS margin FROM tree GROUP BY height, node_id""")
def tree_node_metrics(spark, folder):
    return packing.node_metrics(_tree(spark, folder))


_OVERLAP = f"""overlap AS (SELECT a.height, a.node_id, sum(CASE WHEN least(a.xmax, b.xmax) > greatest(a.xmin, b.xmin) AND least(a.ymax, b.ymax) > greatest(a.ymin, b.ymin)
  THEN (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) ELSE 0.0 END) AS overlap_area
  FROM tree a JOIN tree b USING (height, node_id) WHERE a.elem_position <> b.elem_position GROUP BY a.height, a.node_id)"""


@query("tree_node_overlap", f"{_tree_sql()}, {_OVERLAP} SELECT height, node_id, round(overlap_area, 2) AS overlap_area FROM overlap")
def tree_node_overlap(spark, folder):
    return packing.node_overlap(_tree(spark, folder)).withColumn("overlap_area", F.round("overlap_area", 2))


@query("tree_snapshot", f"""{_tree_sql()}, {_OVERLAP}, m AS (SELECT height, node_id, count(*) AS entries, (max(xmax) - min(xmin)) * (max(ymax) - min(ymin)) AS area FROM tree GROUP BY height, node_id)
SELECT count(*) AS nodes, sum(entries)::BIGINT AS entries, max(height) + 1 AS tree_height, count(*) FILTER (WHERE height = 0) AS leaf_nodes, count(*) FILTER (WHERE height > 0) AS internal_nodes,
  avg(entries) AS avg_entries, round(avg(area), 3) AS avg_coverage_area, round(avg(coalesce(overlap_area, 0.0)), 3) AS avg_overlap_area FROM m LEFT JOIN overlap USING (height, node_id)""")
def tree_snapshot(spark, folder):
    s = packing.structure_snapshot(_tree(spark, folder))
    return s.withColumns({c: F.round(c, 3) for c in ("avg_coverage_area", "avg_overlap_area")})


@query("tree_dead_space", f"""{_tree_sql()}, e AS (SELECT DISTINCT height, node_id, x FROM (SELECT height, node_id, unnest([xmin, xmax]) AS x FROM tree)),
slab AS (SELECT height, node_id, x, lead(x) OVER (PARTITION BY height, node_id ORDER BY x) AS x2 FROM e),
cut AS (SELECT s.height, s.node_id, s.x, s.x2, t.ymin, t.ymax, max(t.ymax) OVER (PARTITION BY s.height, s.node_id, s.x ORDER BY t.ymin, t.ymax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM slab s JOIN tree t ON s.height = t.height AND s.node_id = t.node_id AND t.xmin <= s.x AND t.xmax >= s.x2 WHERE s.x2 IS NOT NULL),
live AS (SELECT height, node_id, sum((x2 - x) * greatest(0, ymax - greatest(ymin, coalesce(top, ymin)))) AS area FROM cut GROUP BY height, node_id)
SELECT height, node_id, CASE WHEN count(*) < 2 THEN 0.0 ELSE round(greatest(0.0, (max(xmax) - min(xmin)) * (max(ymax) - min(ymin)) - coalesce(any_value(area), 0.0)), 1) END AS dead_space
FROM tree LEFT JOIN live USING (height, node_id) GROUP BY height, node_id""")
def tree_dead_space(spark, folder):
    return packing.dead_space(_tree(spark, folder)).withColumn("dead_space", F.round("dead_space", 1))


@query("tree_range_query", f"SELECT id FROM ({_objects_sql('order_rects')}), ({_window_sql(ORDER_WINDOW)}) WHERE {sql_box(Predicate.INTERSECTS, 'q', 'o')}")
def tree_range_query(spark, folder):
    return packing.tree_query(_tree(spark, folder), ORDER_WINDOW)


_TRACE = """t AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS pe_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS rw_order,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'WRITE' ELSE 'READ' END AS op_type, user_id::INTEGER AS page_id FROM events)"""
_RUNS = f"""{_TRACE}, m AS (SELECT *, CASE WHEN page_id = lag(page_id) OVER w + 1 AND op_type = lag(op_type) OVER w THEN 0 ELSE 1 END AS head FROM t WINDOW w AS (PARTITION BY pe_id ORDER BY rw_order)),
r AS (SELECT *, sum(head) OVER (PARTITION BY pe_id ORDER BY rw_order) AS run FROM m),
runs AS (SELECT pe_id, run::BIGINT AS run, any_value(op_type) AS op_type, min(page_id) AS first_page, max(page_id) AS last_page, count(*) AS pages FROM r GROUP BY pe_id, run)"""


@query("page_requests", f"WITH {_TRACE} SELECT pe_id, op_type, count(*) AS requests, count(DISTINCT page_id) AS pages FROM t GROUP BY 1, 2")
def page_requests(spark, folder):
    return datasets.page_trace(spark, folder).groupBy("pe_id", "op_type").agg(F.count("*").alias("requests"), F.count_distinct("page_id").alias("pages"))


@query("coalesced_runs", f"WITH {_RUNS} SELECT * FROM runs")
def coalesced_runs(spark, folder):
    return traces.coalesced_runs(datasets.page_trace(spark, folder))


@query("device_operations", f"""WITH {_RUNS}, a AS (SELECT pe_id, op_type, count(*) AS operations, max(pages) AS longest FROM runs GROUP BY 1, 2),
b AS (SELECT pe_id, op_type, count(*) AS requests, count(DISTINCT page_id) AS pages FROM t GROUP BY 1, 2) SELECT * FROM b JOIN a USING (pe_id, op_type)""")
def device_operations(spark, folder):
    return traces.operations(datasets.page_trace(spark, folder))


_DISTANCE = f"""{_TRACE}, p AS (SELECT *, lag(rw_order) OVER (PARTITION BY pe_id, page_id ORDER BY rw_order) AS prev FROM t),
dist AS (SELECT a.pe_id, a.rw_order, a.page_id, CASE WHEN a.prev IS NOT NULL THEN (SELECT count(DISTINCT b.page_id) FROM t b WHERE b.pe_id = a.pe_id AND b.rw_order > a.prev AND b.rw_order < a.rw_order) END AS distance FROM p a)"""


@query("reuse_distances", f"WITH {_DISTANCE} SELECT pe_id, rw_order::INTEGER AS rw_order, page_id, distance FROM dist")
def reuse_distances(spark, folder):
    return traces.reuse_distances(datasets.page_trace(spark, folder))


@query("lru_curve", f"""WITH {_DISTANCE} SELECT pe_id, slots, count(*) FILTER (WHERE distance < slots) AS hits, count(*) FILTER (WHERE distance IS NULL OR distance >= slots) AS faults
FROM dist, (VALUES (4), (16), (64)) s(slots) GROUP BY 1, 2""")
def lru_curve(spark, folder):
    return traces.lru_curve(datasets.page_trace(spark, folder), [4, 16, 64])


#: Replays in SQL: one step for each request of a run. m: the main pages, oldest first; a: pages seen once or new ones; g: pages that left a.
_SLOTS = 16


def _cache_sql(policy: str) -> str:
    room, ghosts = max(1, _SLOTS // 4), _SLOTS // 2
    most = {"NONE": 0, "2Q": _SLOTS - room}.get(policy, _SLOTS)
    in_m, in_a, in_g = (f"len(list_filter({x}, lambda e: e.p = page_id)) > 0" for x in "mag")
    rest = "list_filter(m, lambda e: e.p <> page_id)"
    full = f"NOT ({in_m}) AND len({rest}) >= {most}"
    touched = f"list_append(CASE WHEN {full} THEN {rest}[2:] ELSE {rest} END, {{'p': page_id, 'd': w OR coalesce(list_filter(m, lambda e: e.p = page_id)[1].d, false)}})"
    lost = f"CASE WHEN {full} AND {rest}[1].d THEN 1 ELSE 0 END"
    entry = "{'p': page_id, 'd': w}"
    one = "CASE WHEN w THEN 1 ELSE 0 END"
    if policy == "NONE":
        hit, m, a, g, writes = "false", "m", "a", "g", one
    elif policy in ("LRU", "HLRU"):  # all requests of this trace have height 0
        hit, m, a, g, writes = in_m, touched, "a", "g", lost
    elif policy == "S2Q":
        again = f"({in_m}) OR ({in_a})"
        seen = f"list_append(a, {entry})"
        hit, m, g = in_m, f"CASE WHEN {again} THEN {touched} ELSE m END", "g"
        a = f"CASE WHEN {in_m} THEN a WHEN {in_a} THEN list_filter(a, lambda e: e.p <> page_id) WHEN len(a) >= {max(1, ghosts)} THEN {seen}[2:] ELSE {seen} END"
        writes = f"CASE WHEN {again} THEN {lost} ELSE {one} END"
    else:
        main = f"({in_m}) OR (NOT ({in_a}) AND ({in_g}))"
        out = f"len(a) >= {room}"
        left = "list_append(list_filter(g, lambda e: e.p <> a[1].p), {'p': a[1].p, 'd': false})"
        hit, m = f"({in_m}) OR ({in_a})", f"CASE WHEN {main} THEN {touched} ELSE m END"
        a = f"CASE WHEN {main} THEN a WHEN {in_a} THEN list_transform(a, lambda e: {{'p': e.p, 'd': e.d OR (w AND e.p = page_id)}}) ELSE list_append(CASE WHEN {out} THEN a[2:] ELSE a END, {entry}) END"
        g = f"CASE WHEN ({main}) OR ({in_a}) OR NOT ({out}) THEN g WHEN len({left}) > {ghosts} THEN {left}[2:] ELSE {left} END"
        writes = f"CASE WHEN {main} THEN {lost} WHEN {in_a} OR NOT ({out}) THEN 0 WHEN a[1].d THEN 1 ELSE 0 END"
    dirty = "len(list_filter(m, lambda e: e.d))" + (" + len(list_filter(a, lambda e: e.d))" if policy == "2Q" else "")
    none = "[]::STRUCT(p INTEGER, d BOOLEAN)[]"
    return f"""WITH RECURSIVE {_TRACE}, o AS (SELECT pe_id, rw_order AS k, page_id, op_type = 'WRITE' AS w FROM t), last AS (SELECT pe_id, max(k) AS k FROM o GROUP BY pe_id),
s(pe_id, k, hits, writes, m, a, g) AS (SELECT pe_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, {none}, {none}, {none} FROM last
  UNION ALL SELECT s.pe_id, o.k, hits + CASE WHEN {hit} THEN 1 ELSE 0 END, writes + {writes}, {m}, {a}, {g} FROM s JOIN o ON o.pe_id = s.pe_id AND o.k = s.k + 1)
SELECT pe_id, '{policy}' AS policy, {_SLOTS}::INTEGER AS slots, hits, k - hits AS faults, writes + ({dirty}) AS writes, ({dirty})::BIGINT AS flushed FROM s JOIN last USING (pe_id, k)"""


def _add_cache(policy: str) -> None:
    QUERIES[f"cache_{policy.lower()}"] = lambda spark, folder: traces.replay(datasets.page_trace(spark, folder), policy, _SLOTS)
    ORACLE_SQL[f"cache_{policy.lower()}"] = _cache_sql(policy)


for _c in traces.POLICIES:
    _add_cache(_c)


def _log(spark, folder) -> DataFrame:
    """Inserts of all orders, then a second round of inserts, deletes and repeated deletes."""
    d = datasets.load(spark, folder, "order_rects").withColumnRenamed("id", "p")
    first = d.select(F.col("p").alias("seq"), F.lit("INSERT").alias("op"), "*")
    again = d.where("p % 7 = 0").select((F.col("p") + 10**9).alias("seq"), F.lit("INSERT").alias("op"), "*")
    gone = d.where("p % 3 = 0").select((F.col("p") + 2 * 10**9).alias("seq"), F.lit("DELETE").alias("op"), "*")
    twice = d.where("p % 9 = 0").select((F.col("p") + 3 * 10**9).alias("seq"), F.lit("DELETE").alias("op"), "*")
    return first.unionByName(again).unionByName(gone).unionByName(twice)


@query("live_entries", f"""SELECT id, xmin, ymin, xmax, ymax, copies FROM (SELECT o.*, greatest(0, 1 + (CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END) - (CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) - (CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END))::BIGINT AS copies
FROM ({SQL_DATA['order_rects']}) o) WHERE copies > 0""")
def live_entries(spark, folder):
    return oplog.live_entries(_log(spark, folder))


@query("replayed_log", f"""SELECT 1 AS idx_id, id + 5000000 AS id, xmin, ymin, xmax + 1 AS xmax, ymax FROM ({SQL_DATA['order_rects']}) WHERE id % 5 = 0
UNION ALL SELECT 1, * FROM ({SQL_DATA['order_rects']}) WHERE id % 5 <> 0""")
def replayed_log(spark, folder):
    """An update of every fifth order, and updates of orders that are not there, which insert nothing."""
    d = datasets.load(spark, folder, "order_rects")
    c = ["xmin", "ymin", "xmax", "ymax"]
    none = [F.lit(None).cast("long").alias("old_p"), *[F.lit(None).cast("double").alias(f"old_{x}") for x in c]]
    ins = d.select(F.lit(1).alias("idx_id"), F.col("id").alias("seq"), F.lit("INSERT").alias("op"), F.col("id").alias("p"), *c, *none)
    old = [F.col("id").alias("old_p"), *[F.col(x).alias(f"old_{x}") for x in c]]
    new = [(F.col("id") + 5_000_000).alias("p"), "xmin", "ymin", (F.col("xmax") + 1).alias("xmax"), "ymax"]
    upd = d.where("id % 5 = 0").select(F.lit(1).alias("idx_id"), (F.col("id") + 10**9).alias("seq"), F.lit("UPDATE").alias("op"), *new, *old)
    lost = d.where("id % 11 = 0").select(F.lit(1).alias("idx_id"), (F.col("id") + 2 * 10**9).alias("seq"), F.lit("UPDATE").alias("op"), *new, (F.col("id") + 9_000_000).alias("old_p"), *old[1:])
    return oplog.replay(ins.unionByName(upd).unionByName(lost))


def _random_sql(salt: int, seed: int = 1) -> str:
    return f"(('0x' || substr(md5(id || ':{seed}:{salt}'), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)!r}::DOUBLE)"


def _axis_sql(axis: int, salt: int) -> str:
    lo, hi = DOMAIN[axis], DOMAIN[axis + 2]
    return f"{lo!r}::DOUBLE + round({_random_sql(salt)} * {hi - lo!r}::DOUBLE, 6)"


def _window_size(percent: float) -> tuple[float, float]:
    s = (percent / 100) ** 0.5
    return (DOMAIN[2] - DOMAIN[0]) * s, (DOMAIN[3] - DOMAIN[1]) * s


def _around_sql(source: str, x: str, y: str, percent: float) -> str:
    w, h = _window_size(percent)
    return f"SELECT id, {x} - {w / 2!r}::DOUBLE AS xmin, {y} - {h / 2!r}::DOUBLE AS ymin, {x} + {w / 2!r}::DOUBLE AS xmax, {y} + {h / 2!r}::DOUBLE AS ymax FROM {source}"


_D = [f"{float(v)!r}::DOUBLE" for v in DOMAIN]
_MEETS_DOMAIN = f"xmin <= {_D[2]} AND xmax >= {_D[0]} AND ymin <= {_D[3]} AND ymax >= {_D[1]}"


@query("random_points", f"SELECT id, {_axis_sql(0, 1)} AS xmin, {_axis_sql(1, 2)} AS ymin, {_axis_sql(0, 1)} AS xmax, {_axis_sql(1, 2)} AS ymax, false AS is_correlated, 'random' AS dataset FROM range(100) r(id)")
def random_points(spark, folder):
    return workloads.random_points(spark, DOMAIN, 100)


@query("random_windows", f"""SELECT id, xmin, ymin, xmax, ymax, 0.1::DOUBLE AS percentage, 'window' AS type, false AS is_correlated, 'random' AS dataset
FROM ({_around_sql('(SELECT id, ' + _axis_sql(0, 3) + ' AS cx, ' + _axis_sql(1, 4) + ' AS cy FROM range(416) r(id))', 'cx', 'cy', 0.1)})
WHERE greatest(least(xmax, {_D[2]}) - greatest(xmin, {_D[0]}), 0) * greatest(least(ymax, {_D[3]}) - greatest(ymin, {_D[1]}), 0) > {0.2 * _window_size(0.1)[0] * _window_size(0.1)[1]!r}::DOUBLE ORDER BY id LIMIT 100""")
def random_windows(spark, folder):
    return workloads.random_windows(spark, DOMAIN, 0.1, 100)


@query("random_points_in_region")
def random_points_in_region(spark, folder):
    """In a region that is no box: a triangle with a hole."""
    return workloads.random_points(spark, REGION, 100)


@query("correlated_points", f"""SELECT id, x AS xmin, y AS ymin, x AS xmax, y AS ymax, true AS is_correlated, 'correlated' AS dataset FROM (SELECT id, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y FROM ({SQL_DATA['order_rects']}))
WHERE x BETWEEN {_D[0]} AND {_D[2]} AND y BETWEEN {_D[1]} AND {_D[3]} ORDER BY {_random_sql(5)}, id LIMIT 100""")
def correlated_points(spark, folder):
    return workloads.correlated_points(datasets.load(spark, folder, "order_rects"), 100, region=DOMAIN)


_CENTRES = f"(SELECT id, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y FROM ({SQL_DATA['order_rects']}))"


def _correlated_sql(percent: float, kind: str) -> str:
    hit = f" AND EXISTS (SELECT 1 FROM ({SQL_DATA['order_rects']}) o WHERE q.xmin < o.xmin AND o.xmax < q.xmax AND q.ymin < o.ymin AND o.ymax < q.ymax)" if kind == "containment" else ""
    return f"""SELECT id, xmin, ymin, xmax, ymax, {percent!r}::DOUBLE AS percentage, '{kind}' AS type, true AS is_correlated, 'correlated' AS dataset
FROM ({_around_sql(_CENTRES, 'x', 'y', percent)}) q WHERE {_MEETS_DOMAIN}{hit} ORDER BY {_random_sql(5)}, id LIMIT 100"""


@query("correlated_intersection_windows", _correlated_sql(0.001, "intersection"))
def correlated_intersection_windows(spark, folder):
    return workloads.correlated_windows(datasets.load(spark, folder, "order_rects"), DOMAIN, 0.001, 100)


@query("correlated_containment_windows", _correlated_sql(0.05, "containment"))
def correlated_containment_windows(spark, folder):
    return workloads.correlated_windows(datasets.load(spark, folder, "order_rects"), DOMAIN, 0.05, 100, containment=True)


REGION = geometry.encode(geometry.POLYGON, [[(0, 0), (1000, 0), (0, 1000), (0, 0)], [(100, 100), (300, 100), (100, 300), (100, 100)]])


#: Trees that are grown one insert at a time: every split, and every kind of tree.
TREES = {i + 1: {"kind": "rtree", "least": 2, "most": 6, "split": name} for i, name in enumerate(SPLITS)} | {
    7: {"kind": "rstar", "least": 2, "most": 6}, 8: {"kind": "hilbert", "least": 2, "most": 6, "domain": (0.0, 0.0, 64.0, 2048.0)}, 9: {"kind": "overflow", "least": 2, "most": 6},
}


_HILBERT = {"kind": "hilbert", "least": 2, "most": 6, "domain": (0.0, 0.0, 64.0, 2048.0)}
_BASES = ({"kind": "rtree", "least": 2, "most": 6}, {"kind": "rstar", "least": 2, "most": 6}, _HILBERT)
#: Trees behind buffers: every kind with every policy of either design.
BUFFERED = {
    i + 1: base | {"buffer": buffer}
    for i, (base, buffer) in enumerate(
        [(b, {"design": "fast", "policy": p}) for b in _BASES for p in ("all", "random", "most", "most_and_oldest")]
        + [(b, {"design": "tuned", "value": v, "read_policy": r}) for b in _BASES for v, r in (("changes", "LRU"), ("height", "HLRU"), ("area", "S2Q"), ("overlap", "2Q"))]
        + [({"kind": "overflow", "least": 2, "most": 6, "costs": {"write_cost": c}}, {"design": "cold", "warm": w}) for c, w in ((1.0, 0.1), (8.0, 0.5))]
    )
}


def _tree_log(spark, folder, with_windows: bool, kinds: dict = TREES) -> DataFrame:
    """For each tree: all parts inserted, those of an eighth deleted, then range windows asked."""
    d = datasets.load(spark, folder, "part_pts").withColumnRenamed("id", "p")
    log = d.select(F.col("p").alias("seq"), F.lit("INSERT").alias("op"), "*").unionByName(d.where("p % 8 = 3").select((F.col("p") + 10**9).alias("seq"), F.lit("DELETE").alias("op"), "*"))
    if with_windows:
        w = workloads.windows(spark, PART_WINDOWS)
        log = log.unionByName(w.select((F.col("qid") + 2 * 10**9).cast("long").alias("seq"), F.lit("QUERY").alias("op"), F.col("qid").cast("long").alias("p"), "xmin", "ymin", "xmax", "ymax"))
    return log.withColumn("idx_id", F.explode(F.array(*[F.lit(i) for i in kinds])))


PART_WINDOWS = [(1, 10, 920, 30, 960), (2, 5, 900, 5, 1000), (3, 0, 0, 60, 2000), (4, 20, 950, 20, 950), (5, 70, 0, 80, 10)]
_LIVE_PARTS = f"SELECT * FROM ({SQL_DATA['part_pts']}) WHERE id % 8 <> 3"
_IDX, _BUFFERED_IDX = ("(VALUES " + ", ".join(f"({i})" for i in k) + ") i(idx_id)" for k in (TREES, BUFFERED))


@query("grown_tree_entries", f"SELECT idx_id, id AS pointer, xmin, ymin, xmax, ymax FROM ({_LIVE_PARTS}), {_IDX}")
def grown_tree_entries(spark, folder):
    return trees.grow(_tree_log(spark, folder, False), TREES).where("node_height = 0").select("idx_id", "pointer", "xmin", "ymin", "xmax", "ymax")


def _counts_sql(idx: str) -> str:
    return f"""SELECT idx_id, (row_number() OVER (PARTITION BY idx_id ORDER BY qid))::INTEGER AS nth, n FROM (SELECT idx_id, qid, (SELECT count(*) FROM (SELECT id, xmin AS oxmin, ymin AS oymin, xmax AS oxmax, ymax AS oymax FROM ({_LIVE_PARTS})) WHERE {sql_box(Predicate.INTERSECTS, 'q', 'o')}) AS n
FROM (VALUES {', '.join(f"({q}, " + ", ".join(f"{float(v)!r}::DOUBLE" for v in b) + ")" for q, *b in PART_WINDOWS)}) t(qid, qxmin, qymin, qxmax, qymax), {idx})"""


def _window_counts(spark, folder, kinds: dict) -> DataFrame:
    from pyspark.sql import Window

    asked = trees.answers(_tree_log(spark, folder, True, kinds), kinds)
    return asked.select("idx_id", F.row_number().over(Window.partitionBy("idx_id").orderBy("seq")).alias("nth"), F.col("results").alias("n"))


@query("grown_tree_window_counts", _counts_sql(_IDX))
def grown_tree_window_counts(spark, folder):
    return _window_counts(spark, folder, TREES)


@query("buffered_tree_window_counts", _counts_sql(_BUFFERED_IDX))
def buffered_tree_window_counts(spark, folder):
    """Searches that merge what waits in the buffers."""
    return _window_counts(spark, folder, BUFFERED)


@query("buffered_tree_entries", f"SELECT idx_id, id AS pointer, xmin, ymin, xmax, ymax FROM ({_LIVE_PARTS}), {_BUFFERED_IDX}")
def buffered_tree_entries(spark, folder):
    """What the device holds after all is flushed."""
    return trees.grow(_tree_log(spark, folder, False, BUFFERED), BUFFERED).where("node_height = 0").select("idx_id", "pointer", "xmin", "ymin", "xmax", "ymax")


@query("buffered_tree_requests")
def buffered_tree_requests(spark, folder):
    """Requests that reach the device."""
    return trees.requests(_tree_log(spark, folder, True, BUFFERED), BUFFERED)


@query("grown_tree_requests_per_height")
def grown_tree_requests_per_height(spark, folder):
    return trees.requests(_tree_log(spark, folder, True), TREES)


@query("grown_tree_cache")
def grown_tree_cache(spark, folder):
    return trees.cached(_tree_log(spark, folder, True), TREES, "HLRU", 16)


@query("split_report")
def split_report(spark, folder):
    tree = packing.packed_tree(datasets.load(spark, folder, "part_pts"), 8, (0.0, 0.0, 64.0, 2048.0), BITS)
    return trees.split_report(tree.where("height = 0"), 2)


@query("flash_device")
def flash_device(spark, folder):
    return flash.simulate(datasets.page_trace(spark, folder), flash.DeviceConfig(blocks=64, pages_per_block=8))


def _add_buffer(policy: str) -> None:
    QUERIES[f"write_buffer_{policy}"] = lambda spark, folder: write_buffers.replay(datasets.page_trace(spark, folder), write_buffers.BufferConfig(capacity=2048, policy=policy))


for _w in ("all", "random", "most", "most_and_oldest", "value"):
    _add_buffer(_w)


def _add_tuned(policy: str) -> None:
    QUERIES[f"tuned_buffer_{policy.lower()}"] = lambda spark, folder: tuned_buffers.replay(datasets.page_trace(spark, folder), policy)


for _r in tuned_buffers.READ_POLICIES:
    _add_tuned(_r)


#: Kinds of indices by id in the catalog's queries, with the configuration that each needs.
_KINDS = (1, 2, 3, 4, 6, 7, 8, 10)


def _catalog(spark, folder, kinds=_KINDS, option: int = 1) -> catalog.Catalog:
    """Indices over the parts, one of each kind, built as measured runs."""
    c = catalog.Catalog(spark)
    c.add_source(1, datasets.load(spark, folder, "part_pts"))
    c.add_basic(1, 4096)
    domain = (0.0, 0.0, 64.0, 2048.0)
    c.add_special(1, 2, 6, domain=domain)
    c.add_special(2, 2, 6, domain=domain, buffer={"design": "fast", "policy": "most"})
    c.add_special(3, 2, 6, domain=domain, buffer={"design": "tuned", "value": "area", "read_policy": "2Q"})
    c.add_special(4, 2, 6, domain=domain, buffer={"design": "cold"})
    c.set_execution_name("build")
    for k in kinds:
        c.create(k, f"/indices/kind{k}", 1, 1, {None: 1, "fast": 2, "tuned": 3, "cold": 4}[catalog.KINDS[k][1]], flush=True, option=option)
    return c


_KIND_IDX = "(VALUES " + ", ".join(f"({i + 1}, {k})" for i, k in enumerate(_KINDS)) + ") i(idx_id, kind)"
_PARTS_AS_O = f"SELECT id, xmin AS oxmin, ymin AS oymin, xmax AS oxmax, ymax AS oymax FROM ({SQL_DATA['part_pts']})"


@query("catalog_runs", f"""SELECT {len(_KINDS)} + qid::INTEGER AS pe_id, 1 AS idx_id, 'window ' || qid AS execution_name, 'INTERSECTS' AS query_predicate,
  (SELECT count(*) FROM ({_PARTS_AS_O}) WHERE {sql_box(Predicate.INTERSECTS, 'q', 'o')}) AS cand_num, (SELECT count(*) FROM ({_PARTS_AS_O}) WHERE {sql_exact(Predicate.INTERSECTS, 'q', 'o')}) AS result_num
  FROM (VALUES {', '.join(f"({q}, " + ", ".join(f"{float(v)!r}::DOUBLE" for v in b) + ")" for q, *b in PART_WINDOWS)}) t(qid, qxmin, qymin, qxmax, qymax)
UNION ALL SELECT idx_id, idx_id, 'build', 'INTERSECTS', 0, 0 FROM {_KIND_IDX}""")
def catalog_runs(spark, folder):
    """Measured builds and queries, as the catalog's table of runs has them."""
    c = _catalog(spark, folder)
    for q, *w in PART_WINDOWS:
        c.set_execution_name(f"window {q}", 2)
        c.a_query("/indices/kind1", selection.QueryType.RANGE, tuple(map(float, w)), Predicate.INTERSECTS)
    return c.table("execution").select("pe_id", "idx_id", "execution_name", "query_predicate", "cand_num", "result_num")


@query("catalog_query", f"SELECT id, 'POINT' AS kind FROM ({_PARTS_AS_O}), ({_window_sql(PART_WINDOW)}) WHERE {sql_exact(Predicate.INTERSECTS, 'q', 'o')}")
def catalog_query(spark, folder):
    found = _catalog(spark, folder, (3,)).query("/indices/kind3", selection.QueryType.SELECTION, PART_WINDOW, Predicate.INTERSECTS)
    return found.select("id", F.regexp_extract("geo", "^[A-Z]+", 0).alias("kind"))


@query("catalog_changes", f"""SELECT * FROM ({SQL_DATA['part_pts']}) WHERE id NOT IN (2, 3) UNION ALL SELECT 900001, 1.0, 2.0, 3.0, 4.0 UNION ALL SELECT id + 900000, xmin, ymin, xmax, ymax + 1 FROM ({SQL_DATA['part_pts']}) WHERE id = 3""")
def catalog_changes(spark, folder):
    """Measured inserts, deletes and updates, some of what is not there: the live entries."""
    c = _catalog(spark, folder, (8,))
    path = "/indices/kind8"
    two, three = (tuple(r)[1:] for r in c.sources[1].where("id in (2, 3)").orderBy("id").collect())
    c.a_insert(path, 900001, (1, 2, 3, 4))
    c.a_delete(path, 2, two)
    c.a_delete(path, 2, two)
    c.a_update(path, 3, three, 900003, (three[0], three[1], three[2], three[3] + 1))
    c.a_update(path, 5, (7.0, 7.0, 7.0, 7.0), 900005, three)
    c.insert(path, None, two)
    c.table("execution")  # the runs are counted too, though only the entries are returned
    return c.entries(path)


@query("catalog_snapshots", f"SELECT idx_id AS pe_id, (SELECT count(*) FROM part) AS entries, true AS every_node_has_a_parent_entry, true AS arrays_fit, true AS averages_fit FROM {_KIND_IDX}")
def catalog_snapshots(spark, folder):
    """Laws that the snapshots of all kinds of trees keep."""
    s = _catalog(spark, folder, option=2).table("snapshot")
    nodes = F.col("num_int_nodes") + F.col("num_leaf_nodes")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return s.select(
        "pe_id", (F.col("num_entries_leaf_nodes") + F.col("num_entries_leaf_o_nodes")).alias("entries"), (F.col("num_entries_int_nodes") == nodes - 1).alias("every_node_has_a_parent_entry"),
        ((F.size("num_entries_pnode") == nodes + F.col("num_leaf_o_nodes")) & (F.size("dead_space_pnode") == F.size("overlap_area_pnode")) & (F.size("num_nodes_pheight") == F.col("height") + 1)).alias("arrays_fit"),
        (F.abs(total(F.transform("num_entries_pnode", lambda x: x.cast("double"))) / F.size("num_entries_pnode") - F.col("avg_num_entries_pnode")) < 1e-9).alias("averages_fit"),
    )


@query("catalog_print", f"SELECT idx_id AS pe_id, id AS pointer, xmin, ymin, xmax, ymax, kind IN (3, 6, 10) AS has_hilbert_value FROM ({SQL_DATA['part_pts']}), {_KIND_IDX}")
def catalog_print(spark, folder):
    """Leaf entries of printed indices."""
    p = _catalog(spark, folder, option=3).table("print_index").where("node_height = 0")
    return p.select("pe_id", "pointer", "xmin", "ymin", "xmax", "ymax", F.col("hilbert_value").isNotNull().alias("has_hilbert_value"))


@query("catalog_counts")
def catalog_counts(spark, folder):
    """What builds and queries do to the nodes, in the columns of runs."""
    c = _catalog(spark, folder)
    for k in _KINDS:
        c.a_query(f"/indices/kind{k}", selection.QueryType.RANGE, PART_WINDOW, Predicate.INTERSECTS)
    return c.table("execution").drop(*[x for x in c.table("execution").columns if x.endswith("_time")])


@query("catalog_requests")
def catalog_requests(spark, folder):
    """The order of a query's requests, beside its index's device totals."""
    c = _catalog(spark, folder, (1,))
    c.start(trace=True)
    c.query("/indices/kind1", selection.QueryType.RANGE, PART_WINDOW, Predicate.INTERSECTS)
    c.store("/indices/kind1", 5)
    return c.table("read_write_order").join(F.broadcast(c.table("flash")), "pe_id")  # one row of totals


@query("script_of_parts", "SELECT 'INSERT INTO part (p_partkey, p_name, p_brand, p_size) VALUES (' || p_partkey || ', ''' || replace(p_name, '''', '''''') || ''', ''' || p_brand || ''', ' || p_size || ');' AS statement FROM part")
def script_of_parts(spark, folder):
    return schema.as_script(spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size"), "part")
