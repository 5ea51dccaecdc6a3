"""Spatial datasets: DataFrames with an id and four box columns, and their register."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX_SCHEMA = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")]])


@dataclass(frozen=True)
class Dataset:
    """A registered dataset: where its rows come from, and the expressions of its boxes."""

    name: str
    table: str
    key: str
    bounds: tuple[str, str, str, str]

    def load(self, spark: SparkSession, folder: str) -> DataFrame:
        df = spark.read.parquet(f"{folder}/{self.table}.parquet")
        return df.select(F.col(self.key).cast("long").alias("id"), *[F.expr(e).cast("double").alias(c) for e, c in zip(self.bounds, ("xmin", "ymin", "xmax", "ymax"))])


def _point(x: str, y: str) -> tuple[str, str, str, str]:
    return x, y, x, y


DATASETS = {
    d.name: d
    for d in (
        Dataset("part_pts", "part", "p_partkey", _point("p_size", "p_retailprice")),
        Dataset("cust_pts", "customer", "c_custkey", _point("c_nationkey", "c_acctbal")),
        Dataset("order_pts", "orders", "o_orderkey", _point("o_custkey", "o_totalprice")),
        Dataset("order_rects", "orders", "o_orderkey", ("o_custkey", "o_totalprice", "o_custkey + 1 + o_orderkey % 7", "o_totalprice + 10 * (1 + o_orderkey % 11)")),
        Dataset("emb_pts", "embeddings", "vec_id", _point("embedding[0]", "embedding[1]")),
        Dataset("event_pts", "events", "event_id", _point("user_id", "value")),
    )
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in DATASETS:
        raise KeyError(f"no dataset {name}; there are {', '.join(sorted(DATASETS))}")
    return DATASETS[name].load(spark, folder)


def from_frame(df: DataFrame, key: str, geometry: str, bounds: tuple[str, str, str, str] | None = None) -> DataFrame:
    """A dataset from a table with a WKB column: the geometry is kept, and its box computed if the table has none in ``bounds``.

    Null and empty geometries have a box of nulls, which no box test passes.
    """
    from ..functions.geometry import bounds_udf

    names = ("xmin", "ymin", "xmax", "ymax")
    if bounds:
        return df.select(F.col(key).cast("long").alias("id"), F.col(geometry).alias("wkb"), *[F.expr(e).cast("double").alias(c) for e, c in zip(bounds, names)])
    # not deterministic as far as the planner goes: box tests are then made on computed boxes, before any exact test
    box = bounds_udf.asNondeterministic()(F.col(geometry))
    return df.select(F.col(key).cast("long").alias("id"), F.col(geometry).alias("wkb"), box.alias("b")).select("id", "wkb", *[F.col(f"b.{c}").alias(c) for c in names])


def page_trace(spark: SparkSession, folder: str) -> DataFrame:
    """The page requests that the events stand for: pe_id (a day), rw_order, op_type, op_timestamp, page_id."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{folder}/events.parquet")
    day = F.datediff("ts", F.lit("1970-01-01").cast("date")).cast("int")
    w = Window.partitionBy("pe_id").orderBy("ts", "event_id")
    return e.withColumn("pe_id", day).select(
        "pe_id", F.row_number().over(w).alias("rw_order"), F.when(F.col("event_type").isin("purchase", "signup"), "WRITE").otherwise("READ").alias("op_type"),
        F.col("ts").alias("op_timestamp"), F.col("user_id").cast("int").alias("page_id"),
    )
