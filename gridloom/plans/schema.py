"""The result schema of experiments: runs, snapshots, node entries, traces and device totals."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SECONDS = ("total", "index", "filter", "refinement", "retrieving_objects", "processing_predicates", "read", "write", "split")
_MORE_SECONDS = ("flushing", "ret_node_from_buf", "write_log", "compaction_log", "recovery_log", "std_buffer_find", "std_buffer_flushing", "read_buffer_put_node", "read_buffer_get_node")
_COUNTS = (
    "processed_entries_num", "reinsertion_num", "cand_num", "result_num", "writes_num", "reads_num", "split_int_num", "split_leaf_num",
    "flushing_num", "nof_unnecessary_flushed_nodes", "visited_int_nodes_num", "visited_leaf_nodes_num", "written_int_nodes_num", "written_leaf_nodes_num", "deleted_int_nodes_num", "deleted_leaf_nodes_num",
    "mod_node_buffer_num", "new_node_buffer_num", "del_node_buffer_num", "cur_new_node_buffer_num", "cur_mod_node_buffer_num", "cur_del_node_buffer_num", "cur_buffer_size",
    "compaction_log_num", "writes_log_num", "cur_log_size", "flushed_nodes_num", "merge_back_num", "std_buffer_page_fault", "std_buffer_page_hit", "read_buffer_page_hit", "read_buffer_page_fault",
    "cur_read_buffer_size", "efind_force_node_in_rbuffer", "efind_write_tc_sequential", "efind_write_tc_stride", "efind_write_tc_seqstride", "efind_write_tc_filled",
)
#: Fixed names: the columns of a run; what was not measured is null.
EXECUTION = (
    "pe_id int, idx_id int, execution_name string, query_predicate string, "
    + "".join(f"{x}_time double, {x}_cpu_time double, " for x in _SECONDS + _MORE_SECONDS) + "".join(f"{x} long, " for x in _COUNTS)
    + "mods_pheight array<struct<height:int,nofwrites:long>>, accesses_pheight array<struct<height:int,nofreads:long>>"
)
SNAPSHOT = (
    "pe_id int, height int, num_int_nodes long, num_leaf_nodes long, num_entries_int_nodes long, num_entries_leaf_nodes long, num_nodes_pheight array<struct<height:int,n:long>>, "
    "num_entries_pnode array<long>, coverage_area_pnode array<double>, overlap_area_pnode array<double>, dead_space_pnode array<double>, "
    "avg_num_entries_pnode double, avg_coverage_area_pnode double, avg_overlap_area_pnode double, avg_dead_space_pnode double, "
    "num_int_o_nodes long, num_leaf_o_nodes long, num_entries_int_o_nodes long, num_entries_leaf_o_nodes long"
)
TRACE = "pe_id int, rw_order int, op_type string, op_timestamp timestamp_ntz, page_id int"


def parse_buffer(text: str) -> tuple[str, tuple[float, ...]]:
    """``NONE``, ``LRU``, ``HLRU``, ``S2Q(a%)`` or ``2Q(a%,b%)``: the policy and its shares."""
    t = text.strip().upper()
    if "(" not in t:
        name, args = t, ()
    else:
        name, rest = t.split("(", 1)
        if not rest.endswith(")"):
            raise ValueError(f"buffer {text!r}")
        args = tuple(float(x.strip().rstrip("%")) / 100 for x in rest[:-1].split(","))
    if {"NONE": 0, "LRU": 0, "HLRU": 0, "S2Q": 1, "2Q": 2}.get(name.strip()) != len(args) or any(not 0 < a <= 1 for a in args):
        raise ValueError(f"buffer {text!r}")
    return name.strip(), args


def index_path(path: str) -> tuple[str, str]:
    """(folder, name) of a path, split at its last slash."""
    folder, slash, name = path.rpartition("/")
    if not name:
        raise ValueError(f"no index name in {path!r}")
    return folder + slash, name


class Register:
    """Tables of an experiment as Parquet folders under one root; ids are allocated by the register."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{table}")

    def read(self, table: str, schema: str) -> DataFrame:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not path.getFileSystem(conf).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(T._parse_datatype_string(schema)).parquet(f"{self.root}/{table}")

    def next_id(self, table: str, schema: str, key: str) -> int:
        """A number above all that the table has, taken for good: a marker file makes sure that no two callers get the same."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        n = (self.read(table, schema).agg({key: "max"}).first()[0] or 0) + 1
        while True:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_ids/{table}/{n}")
            fs = path.getFileSystem(conf)
            fs.mkdirs(path.getParent())
            try:
                if fs.createNewFile(path):
                    return n
            except Exception as e:  # some file systems raise where the file is there
                if not fs.exists(path):
                    raise e
            n += 1

    @contextmanager
    def run(self, name: str, idx_id: int, predicate: str = "INTERSECTS"):
        """Measures what is inside; the caller sets counts on the yielded dict; one EXECUTION row is appended, also if the run fails."""
        row = dict.fromkeys(f.name for f in T._parse_datatype_string(EXECUTION).fields)
        row |= {"pe_id": self.next_id("execution", EXECUTION, "pe_id"), "idx_id": idx_id, "execution_name": name, "query_predicate": predicate}
        wall, cpu = time.monotonic(), time.process_time()
        try:
            yield row
        finally:
            row["total_time"], row["total_cpu_time"] = time.monotonic() - wall, time.process_time() - cpu
            self.append("execution", self.spark.createDataFrame([tuple(row.values())], EXECUTION))


def as_script(rows: DataFrame, table: str) -> DataFrame:
    """INSERT statements for rows, one line each, as another database would read them."""
    from pyspark.sql import functions as F

    def text(f):
        c = F.col(f.name)
        quoted = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
        return F.coalesce(c.cast("string") if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else quoted, F.lit("NULL"))

    names = ", ".join(rows.columns)
    return rows.select(F.concat(F.lit(f"INSERT INTO {table} ({names}) VALUES ("), F.concat_ws(", ", *[text(f) for f in rows.schema.fields]), F.lit(");")).alias("statement"))
