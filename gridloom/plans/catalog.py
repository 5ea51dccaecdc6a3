"""The catalog of an experiment: indices, their operations, and measured runs.

Operations are rows of an index's log. Queries run over the live entries as one
DataFrame filter and refinement, whatever the kind of index, since every kind
answers alike; what a kind does to its nodes is counted by replaying the log
through its tree when a run is stored.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from enum import IntFlag

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.boxes import area, box, enclosing, to_wkt
from ..functions.hilbert import cell, hilbert
from ..functions.predicates import Predicate
from ..operators import flash, oplog, packing, selection, trees
from .schema import EXECUTION, SNAPSHOT, Register, as_script, index_path, parse_buffer

#: Fixed codes: kinds of indices, as (tree, buffer design).
KINDS = {
    1: ("rtree", None), 2: ("rstar", None), 3: ("hilbert", None), 4: ("rtree", "fast"), 5: ("rstar", "fast"), 6: ("hilbert", "fast"),
    7: ("overflow", "cold"), 8: ("rtree", "tuned"), 9: ("rstar", "tuned"), 10: ("hilbert", "tuned"),
}
_BOX = ("xmin", "ymin", "xmax", "ymax")
_OPS = "idx_id int, seq long, op string, p long, xmin double, ymin double, xmax double, ymax double, old_p long, old_xmin double, old_ymin double, old_xmax double, old_ymax double"
BoxTuple = tuple[float, float, float, float]


class Keep(IntFlag):
    """What a stored run keeps beside its row."""

    SNAPSHOT = 1
    PRINT = 2
    DEVICE = 4


#: Fixed codes: options of storing; any other is 1. Printing an index keeps its snapshot as well.
OPTIONS = {
    1: Keep(0), 2: Keep.SNAPSHOT, 3: Keep.PRINT | Keep.SNAPSHOT, 4: Keep.SNAPSHOT | Keep.PRINT,
    5: Keep.DEVICE, 6: Keep.DEVICE | Keep.SNAPSHOT, 7: Keep.DEVICE | Keep.PRINT | Keep.SNAPSHOT, 8: Keep.DEVICE | Keep.SNAPSHOT | Keep.PRINT,
}


@dataclass
class Index:
    """An index's header."""

    idx_id: int
    kind: int
    path: str
    src_id: int
    bc_id: int
    sc_id: int
    buf_id: int
    created: float
    modified: float
    batches: list[DataFrame] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)


@dataclass
class Run:
    """What is measured from start to store."""

    wall: float
    cpu: float
    since: int
    trace: bool
    counts: dict = field(default_factory=dict)


class Catalog:
    """Configurations by id, indices by path, and the tables of stored runs.

    Everything but the logs' batches is small and kept on the driver; ``save``
    writes it under a folder, which on a cluster must be a shared one.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sources: dict[int, DataFrame] = {}
        #: By id: page size, access and refinement, and whether on a flash device; node sizes, split and buffer design; page buffer.
        self.basics: dict[int, dict] = {}
        self.specials: dict[int, dict] = {}
        self.buffers: dict[int, tuple[str, int]] = {1: ("NONE", 0)}
        self.indices: dict[str, Index] = {}
        self.ids: dict[tuple, int] = {}
        self.seq = 0
        self.name = "Execution"
        self.kept_name: str | None = None
        self.run: Run | None = None
        self.tables: dict[str, list[DataFrame]] = {}
        #: Stored runs and snapshots whose indices are still to be replayed, all in one job when their tables are asked for.
        self.waiting: list[tuple[Index, int, int, dict]] = []
        self.drawn: list[tuple[Index, int, bool, int]] = []
        self.pe = 0
        self.scripts: list[DataFrame] = []

    # configurations

    def add_basic(self, bc_id: int, page_size: int, access: str = "NORMAL ACCESS", refinement: str = "GEOS AND POSTGIS", device: flash.DeviceConfig | None = None) -> None:
        if access.upper() not in ("DIRECT ACCESS", "NORMAL ACCESS") or refinement.upper() not in ("ONLY GEOS", "GEOS AND POSTGIS"):
            raise ValueError(f"{access!r}, {refinement!r}")
        self.basics[bc_id] = {"page_size": page_size, "access": access.upper(), "shortcut": refinement.upper() != "ONLY GEOS", "device": device}

    def add_special(self, sc_id: int, least: int, most: int, split: str = "quadratic", domain: BoxTuple | None = None, buffer: dict | None = None) -> None:
        self.specials[sc_id] = {"least": least, "most": most, "split": split, "domain": domain, "buffer": buffer}

    def add_buffer(self, buf_id: int, text: str, size: int) -> None:
        parse_buffer(text)
        self.buffers[buf_id] = (text.upper(), size)

    def add_source(self, src_id: int, data: DataFrame) -> None:
        """data: id and box, and wkb if geometries are to be refined."""
        self.sources[src_id] = data

    def tree_config(self, index: Index) -> dict:
        tree, design = KINDS[index.kind]
        s = self.specials[index.sc_id]
        out = {"kind": tree, "least": s["least"], "most": s["most"], "split": s["split"]}
        if s["domain"]:
            out["domain"] = s["domain"]
        return out | ({"buffer": {"design": design, **{k: v for k, v in s["buffer"].items() if k != "design"}}} if design else {})

    # indices and their operations

    def create_empty(self, kind: int, path: str, src_id: int, bc_id: int, sc_id: int, buf_id: int | None = None) -> bool:
        """An index without entries. A null page buffer is buffer 1; a buffered kind needs a configuration of its design."""
        buf_id = 1 if buf_id is None else buf_id
        if kind not in KINDS:
            raise ValueError(f"no index of kind {kind}")
        for known, i, what in ((self.sources, src_id, "source"), (self.basics, bc_id, "basic configuration"), (self.specials, sc_id, "configuration"), (self.buffers, buf_id, "buffer")):
            if i not in known:
                raise ValueError(f"no {what} {i}")
        design = (self.specials[sc_id]["buffer"] or {}).get("design")
        if design != KINDS[kind][1]:
            raise ValueError(f"configuration {sc_id} is for {design or 'no'} buffers, an index of kind {kind} has {KINDS[kind][1] or 'none'}")
        idx = self.process(path, src_id, bc_id, sc_id, buf_id)
        now = time.time()
        if path in self.indices:  # what is stored of the one that was there
            self._replay()
        self.indices[path] = Index(idx, kind, path, src_id, bc_id, sc_id, buf_id, now, now)
        return True

    def process(self, path: str, src_id: int, bc_id: int, sc_id: int, buf_id: int) -> int:
        """The id of an index with these configurations: the one it has, or a new one; the index counts as modified."""
        key = (*index_path(path), src_id, bc_id, sc_id, buf_id)
        idx = self.ids.setdefault(key, len(self.ids) + 1)
        if path in self.indices:
            self.indices[path].modified = time.time()
        return idx

    def _index(self, path: str) -> Index:
        if path not in self.indices:
            raise KeyError(f"no index at {path}")
        return self.indices[path]

    def _add(self, path: str, op: str, p: int | None, b: BoxTuple | None, old_p: int | None = None, old: BoxTuple | None = None) -> None:
        index = self._index(path)
        self.seq += 1
        index.rows.append((index.idx_id, self.seq, op, p, *(map(float, b) if b else (None,) * 4), old_p, *(map(float, old) if old else (None,) * 4)))

    def insert(self, path: str, p: int | None, b: BoxTuple | None) -> bool | None:
        """True; null if pointer or box is."""
        if p is None or b is None:
            return None
        self._add(path, "INSERT", p, b)
        return True

    def delete(self, path: str, p: int | None, b: BoxTuple | None) -> bool | None:
        """True, also if there is no such entry."""
        if p is None or b is None:
            return None
        self._add(path, "DELETE", p, b)
        return True

    def update(self, path: str, old_p: int | None, old: BoxTuple | None, p: int | None, b: BoxTuple | None) -> bool | None:
        """Replaces an entry if it is there; true in any case."""
        if None in (old_p, old, p, b):
            return None
        self._add(path, "UPDATE", p, b, old_p, old)
        return True

    def insert_all(self, path: str, data: DataFrame) -> None:
        """A batch (id, box) in the order of its ids, as one step of the log. Rows with nulls are left out."""
        index = self._index(path)
        first = self.seq + 1
        self.seq += max(1, data.count())
        rows = data.dropna(subset=["id", *_BOX])
        # the log is replayed in order; a place in it need not be dense
        seq = packing.ranked(rows.withColumn("key", F.pmod(F.col("id"), F.lit(1 << 40))), "key", 40).select("id", *_BOX, "rank")
        old = [F.lit(None).cast("long").alias("old_p"), *[F.lit(None).cast("double").alias(f"old_{c}") for c in _BOX]]
        index.batches.append(seq.select(F.lit(index.idx_id).alias("idx_id"), (F.col("rank") + first).alias("seq"), F.lit("INSERT").alias("op"), F.col("id").alias("p"), *_BOX, *old))

    def flush(self, path: str) -> bool:
        """Writes what waits in the buffers of a buffered index; nothing to do for the others."""
        if KINDS[self._index(path).kind][1]:
            self._add(path, "FLUSH", None, None)
        return True

    def flush_pages(self, path: str) -> bool:
        """Writes what waits in the page buffer: an event of the log."""
        if self.buffers[self._index(path).buf_id][0] != "NONE":
            self._add(path, "FLUSH", None, None)
        return True

    def log(self, path: str) -> DataFrame:
        return self._log(self._index(path))

    def _log(self, index: Index) -> DataFrame:
        out = self.spark.createDataFrame(index.rows, _OPS)
        for b in index.batches:
            out = out.unionByName(b)
        return out

    def entries(self, path: str) -> DataFrame:
        """The live entries (id, box)."""
        index = self._index(path)
        if all(r[2] != "UPDATE" for r in index.rows):
            live = oplog.live_entries(self.log(path))
            return live.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("id", *_BOX)
        return oplog.replay(self.log(path).where("op in ('INSERT', 'DELETE', 'UPDATE')")).select("id", *_BOX)

    def query(self, path: str, kind: int, window: BoxTuple, predicate: int, option: int = 1) -> DataFrame:
        """(id, geo), geo null where only the filter step runs."""
        p, option = Predicate(predicate), selection.Option(option)
        if window is None:
            return self.spark.createDataFrame([], "id long, geo string")
        live = self.entries(path)
        found = selection.spatial_query(live, kind, window, p, option)
        self._add(path, "QUERY", None, window)
        if self.run is not None:
            from ..functions.boxes import literal_box

            n = found.count()
            filtered = n if option == selection.Option.FILTER_ONLY else selection.candidates(live, literal_box(*window), p).count()
            self.run.counts |= {"cand_num": filtered, "result_num": n, "query_predicate": p.name}
        return found.select("id", (F.lit(None).cast("string") if option == selection.Option.FILTER_ONLY else to_wkt(box())).alias("geo"))

    # measured runs

    def start(self, trace: bool = False) -> bool:
        """Sets all counters back and the clocks on."""
        self.run = Run(time.monotonic(), time.process_time(), self.seq + 1, trace)
        return True

    def collect_order(self) -> bool:
        """Turns the trace of requests on, counters stay."""
        if self.run is None:
            self.start()
        self.run.trace = True
        return True

    def set_execution_name(self, name: str, location: int = 1) -> bool:
        """Of the runs to come: from now on (location 1), or for the next one only."""
        if location == 1:
            self.name = name
        else:
            self.kept_name = name
        return True

    def store(self, path: str, option: int = 1, location: int = 1) -> int:
        """Ends a run and keeps it; returns its number. location 2: as statements of a script too (``scripts``)."""
        index, run = self._index(path), self.run
        if run is None:
            raise ValueError("no run was started")
        self.run = None
        keep = OPTIONS.get(option, OPTIONS[1])
        self.pe += 1
        pe = self.pe
        wall, cpu = time.monotonic() - run.wall, time.process_time() - run.cpu
        row = dict.fromkeys(f.name for f in T._parse_datatype_string(EXECUTION).fields)
        row |= {"pe_id": pe, "idx_id": index.idx_id, "execution_name": self.kept_name or self.name, "query_predicate": "INTERSECTS", "total_time": wall, "total_cpu_time": cpu, "cand_num": 0, "result_num": 0}
        row |= run.counts
        self.kept_name = None
        self.waiting.append((index, run.since, self.seq, row))
        if location == 2:
            self._replay(2)
        if keep & Keep.SNAPSHOT:
            self.snapshot(path, pe, bool(keep & Keep.PRINT), location)
        if run.trace:
            of_run = self._trace(path, run.since).withColumn("pe_id", F.lit(pe))
            self._keep("read_write_order", of_run.select("pe_id", F.row_number().over(Window.partitionBy("pe_id").orderBy("rw_order")).alias("rw_order"), "op_type", "page_id"), location)
        if keep & Keep.DEVICE:  # the device's totals since the index is there
            device = self.basics[index.bc_id]["device"] or flash.DeviceConfig()
            totals = trees.device_totals(self.log(path), {index.idx_id: self.tree_config(index)}, device, self.basics[index.bc_id]["page_size"])
            self._keep("flash", totals.withColumn("pe_id", F.lit(pe)), location)
        return pe

    def _replay(self, location: int = 1) -> None:
        """Counts what the runs that wait do to their indices, and draws the snapshots: each index is replayed once for all its runs, side by side with the others."""
        if self.waiting:
            waiting, self.waiting = self.waiting, []
            runs: dict[int, list[tuple[int, int, int]]] = {}
            for index, since, until, row in waiting:
                runs.setdefault(index.idx_id, []).append((row["pe_id"], since, until))
            log, configs = self._logs([w[0] for w in waiting])
            # a row for each run of an index that has operations
            nodes = {r["pe_id"]: r.asDict(recursive=True) for r in trees.measures_of_runs(log, configs, runs).collect()}
            known = {f.name for f in T._parse_datatype_string(EXECUTION).fields} - {"pe_id", "idx_id", "cand_num", "result_num"}
            rows = [row | {k: v for k, v in nodes.get(row["pe_id"], {}).items() if k in known} for *_, row in waiting]
            for r in [rows] if location == 1 else [[r] for r in rows]:
                self._keep("execution", self.spark.createDataFrame([tuple(x.values()) for x in r], EXECUTION), location if r is rows or r[0] is rows[-1] else 1)
        if self.drawn:
            drawn, self.drawn = self.drawn, []
            log, configs = self._logs([d[0] for d in drawn])
            marks: dict[int, list[tuple[int, int]]] = {}
            for index, pe, _, until in drawn:
                marks.setdefault(index.idx_id, []).append((pe, until))
            # read many times below: kept on the executors' disks
            nodes = trees.grow_at(log.where("op <> 'QUERY'"), configs, marks).localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
            for index, pe, with_print, _ in drawn:
                self._draw(nodes.where(F.col("idx_id") == pe), index, pe, with_print, 1)

    def _logs(self, indices: list[Index]) -> tuple[DataFrame, dict[int, dict]]:
        """The logs of some indices as one, and their trees' configurations."""
        each = {i.idx_id: i for i in indices}
        out = None
        for i in each.values():
            out = self._log(i) if out is None else out.unionByName(self._log(i))
        return out, {k: self.tree_config(i) for k, i in each.items()}

    def _draw(self, nodes: DataFrame, index: Index, pe_id: int, with_print: bool, location: int) -> None:
        self._keep("snapshot", structure(nodes, pe_id), location)
        if with_print:
            self._keep("print_index", printed(nodes, pe_id, self.tree_config(index).get("domain") if KINDS[index.kind][0] == "hilbert" else None), location)

    def _keep(self, table: str, rows: DataFrame, location: int) -> None:
        self.tables.setdefault(table, []).append(rows)
        if location == 2:
            flat = rows.select(*[F.to_json(c).alias(c) if isinstance(rows.schema[c].dataType, (T.ArrayType, T.StructType)) else F.col(c) for c in rows.columns])
            self.scripts.append(as_script(flat, table))

    def table(self, name: str) -> DataFrame | None:
        self._replay()
        parts = self.tables.get(name)
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def save(self, root: str) -> None:
        self._replay()
        r = Register(self.spark, root)
        for name in self.tables:
            r.append(name, self.table(name))
        self.tables.clear()

    def _trace(self, path: str, since: int = 0) -> DataFrame:
        """The requests of the operations from number ``since`` on."""
        index = self._index(path)
        return trees.run_workload(self.log(path), {index.idx_id: self.tree_config(index)}, since).where("page_id >= 0")

    def snapshot(self, path: str, pe_id: int, print_index: bool = False, location: int = 1) -> bool:
        """The structure of the index as it is, for a run that is stored."""
        if pe_id > self.pe:
            raise ValueError(f"no run {pe_id}")
        index = self._index(path)
        if location == 2:
            self._replay()
            nodes = trees.grow(self.log(path).where("op <> 'QUERY'"), {index.idx_id: self.tree_config(index)})
            self._draw(nodes.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY), index, pe_id, print_index, 2)
        else:
            self.drawn.append((index, pe_id, print_index, self.seq))
        return True

    def a_query(self, path: str, kind: int, window: BoxTuple, predicate: int, option: int = 1, store: int = 1) -> int:
        self.start()
        self.query(path, kind, window, predicate, option)
        return self.store(path, store)

    def a_insert(self, path: str, p: int, b: BoxTuple, store: int = 1) -> int:
        self.start()
        self.insert(path, p, b)
        return self.store(path, store)

    def a_delete(self, path: str, p: int, b: BoxTuple, store: int = 1) -> int:
        self.start()
        self.delete(path, p, b)
        return self.store(path, store)

    def a_update(self, path: str, old_p: int, old: BoxTuple, p: int, b: BoxTuple, store: int = 1) -> int:
        self.start()
        self.update(path, old_p, old, p, b)
        return self.store(path, store)

    def create(self, kind: int, path: str, src_id: int, bc_id: int, sc_id: int, buf_id: int | None = None, flush: bool = False, flush_pages: bool = False, option: int = 1) -> bool:
        """Builds an index from all of its source as one measured run, its buffers written at the end if asked for."""
        self.create_empty(kind, path, src_id, bc_id, sc_id, buf_id)
        self.start()
        self.insert_all(path, self.sources[src_id])
        if flush:
            self.flush(path)
        if flush_pages:
            self.flush_pages(path)
        self.store(path, option)
        return True


def _overflow(nodes: DataFrame) -> DataFrame:
    """Entries with o_node: an overflow node's parent is a leaf."""
    leaves = nodes.where("node_height = 0").select(F.col("node_id").alias("parent_node"), F.lit(True).alias("o_node")).distinct()
    return nodes.join(leaves, "parent_node", "left").withColumn("o_node", F.col("o_node").isNotNull() & (F.col("node_height") == 0))


def structure(nodes: DataFrame, pe_id: int) -> DataFrame:
    """One snapshot row of a tree's node entries (as trees.grow gives them)."""
    n = _overflow(nodes)
    as_tree = n.select(F.col("node_height").alias("height"), F.col("node_id").cast("long").alias("node_id"), "elem_position", "pointer", *_BOX)
    per = n.groupBy("node_id").agg(F.first("node_height").alias("height"), F.first("o_node").alias("o"), F.count("*").alias("entries"), *enclosing())
    per = per.select("node_id", "height", "o", "entries", area(box()).alias("coverage"))
    lap = packing.node_overlap(as_tree).select(F.col("node_id"), "overlap_area")
    dead = packing.dead_space(as_tree).select(F.col("node_id"), "dead_space")
    per = per.join(lap, "node_id", "left").join(dead, "node_id", "left").withColumn("overlap_area", F.coalesce("overlap_area", F.lit(0.0)))
    # root first, then by height and number: one element for each node, as the row holds them
    sorted_ = lambda c: F.transform(F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("h"), "node_id", F.col(c).alias("v")))), lambda x: x["v"])
    some = lambda test: F.sum(F.when(F.expr(test), 1).otherwise(0)).cast("long")
    held = lambda test: F.coalesce(F.sum(F.when(F.expr(test), F.col("entries"))), F.lit(0)).cast("long")
    heights = per.groupBy("height").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col("height"), F.col("n")))).alias("num_nodes_pheight"))
    row = per.agg(
        F.max("height").alias("height"), some("height > 0").alias("num_int_nodes"), some("height = 0 and not o").alias("num_leaf_nodes"), held("height > 0").alias("num_entries_int_nodes"),
        held("height = 0 and not o").alias("num_entries_leaf_nodes"), sorted_("entries").alias("num_entries_pnode"), sorted_("coverage").alias("coverage_area_pnode"),
        sorted_("overlap_area").alias("overlap_area_pnode"), sorted_("dead_space").alias("dead_space_pnode"), F.avg("entries").alias("avg_num_entries_pnode"), F.avg("coverage").alias("avg_coverage_area_pnode"),
        F.avg("overlap_area").alias("avg_overlap_area_pnode"), F.avg("dead_space").alias("avg_dead_space_pnode"), F.lit(0).cast("long").alias("num_int_o_nodes"), some("o").alias("num_leaf_o_nodes"),
        F.lit(0).cast("long").alias("num_entries_int_o_nodes"), held("o").alias("num_entries_leaf_o_nodes"),
    )
    return row.crossJoin(F.broadcast(heights)).withColumn("pe_id", F.lit(pe_id)).select(*[f.name for f in T._parse_datatype_string(SNAPSHOT).fields])  # one row each


def printed(nodes: DataFrame, pe_id: int, domain: BoxTuple | None) -> DataFrame:
    """A row for each entry of each node: pe_id, node_id, geom, elem_position, o_node, node_height, hilbert_value, parent_node (-1 of the root)."""
    x, y = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    value = hilbert(cell(x, domain[0], domain[2], 16), cell(y, domain[1], domain[3], 16), 16) if domain else F.lit(None).cast("long")
    return _overflow(nodes).select(
        F.lit(pe_id).alias("pe_id"), "node_id", to_wkt(box()).alias("geom"), "elem_position", "o_node", "node_height", value.alias("hilbert_value"), "parent_node", "pointer", *_BOX
    )
