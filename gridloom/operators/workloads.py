"""Query workloads: windows by rule or at random (seeded), and summaries of measured runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import box, literal_box, overlap_area
from ..functions.geometry import Shape, box_wkb_udf, refine_udf, share_udf
from ..functions.predicates import Predicate, box_test

WINDOW_SCHEMA = "qid int, xmin double, ymin double, xmax double, ymax double"


def windows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(int(q), *map(float, b)) for q, *b in rows], WINDOW_SCHEMA)


#: A box, or a geometry as WKB.
Region = tuple[float, float, float, float] | bytes
_BOX = ("xmin", "ymin", "xmax", "ymax")


def _random(seed: int, salt: int):
    """A number in [0, 1) from the row's id, the seed and the salt: the same whatever the partitioning, and in other systems."""
    digest = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}:{salt}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _bounds(region: Region) -> tuple[float, float, float, float]:
    if not isinstance(region, bytes):
        return region
    ends = Shape.of(region).bounds()
    if ends is None:
        raise ValueError("the region is empty")
    return ends


def _in_region(df: DataFrame, region: Region) -> DataFrame:
    """Points (xmin, ymin) in a region, its border included."""
    x0, y0, x1, y1 = _bounds(region)
    df = df.where((F.col("xmin") >= x0) & (F.col("xmin") <= x1) & (F.col("ymin") >= y0) & (F.col("ymin") <= y1))
    return df.where(refine_udf(region, Predicate.COVERS)(box_wkb_udf(*_BOX))) if isinstance(region, bytes) else df


def _meets_region(df: DataFrame, region: Region) -> DataFrame:
    df = df.where(box_test(box(), literal_box(*_bounds(region)), Predicate.INTERSECTS, 0.0))
    return df.where(refine_udf(region, Predicate.INTERSECTS)(box_wkb_udf(*_BOX))) if isinstance(region, bytes) else df


def _first(n: int, made, most: int = 1 << 34) -> DataFrame:
    """n rows of made(tries), of as many tries as it takes; ids order them."""
    tries = 4 * n + 16
    while True:
        rows = made(tries).orderBy("id").limit(n)
        if rows.count() == n:
            return rows
        if tries > most:
            raise ValueError("the region takes too few of the tries")
        tries *= 8


def random_points(spark: SparkSession, region: Region, n: int, seed: int = 1, dataset: str = "random") -> DataFrame:
    """n points, uniform in the region, rounded to 6 places."""
    x0, y0, x1, y1 = _bounds(region)

    def made(tries: int) -> DataFrame:
        p = spark.range(tries).select(F.col("id"), (F.lit(x0) + F.round(_random(seed, 1) * (x1 - x0), 6)).alias("xmin"), (F.lit(y0) + F.round(_random(seed, 2) * (y1 - y0), 6)).alias("ymin"))
        return _in_region(p.select("id", "xmin", "ymin", F.col("xmin").alias("xmax"), F.col("ymin").alias("ymax")), region)

    return _first(n, made).select("id", *_BOX, F.lit(False).alias("is_correlated"), F.lit(dataset).alias("dataset"))


def random_windows(spark: SparkSession, region: Region, percent: float, n: int, seed: int = 1, dataset: str = "random") -> DataFrame:
    """n windows of the form of the region's box, ``percent`` of its area, over a fifth of each inside the region.

    A region that is no box is asked at a grid of points of the window.
    """
    x0, y0, x1, y1 = _bounds(region)
    s = (percent / 100) ** 0.5
    w, h = (x1 - x0) * s, (y1 - y0) * s

    def made(tries: int) -> DataFrame:
        raw = spark.range(tries).select(F.col("id"), (F.lit(x0) + F.round(_random(seed, 3) * (x1 - x0), 6)).alias("cx"), (F.lit(y0) + F.round(_random(seed, 4) * (y1 - y0), 6)).alias("cy"))
        b = raw.select("id", (F.col("cx") - w / 2).alias("xmin"), (F.col("cy") - h / 2).alias("ymin"), (F.col("cx") + w / 2).alias("xmax"), (F.col("cy") + h / 2).alias("ymax"))
        good = b.where(overlap_area(box(), literal_box(x0, y0, x1, y1)) > 0.2 * w * h)
        return good.where(share_udf(region)(*_BOX) > 0.2) if isinstance(region, bytes) else good

    return _first(n, made).select("id", *_BOX, F.lit(float(percent)).alias("percentage"), F.lit("window").alias("type"), F.lit(False).alias("is_correlated"), F.lit(dataset).alias("dataset"))


def correlated_points(data: DataFrame, n: int, seed: int = 1, dataset: str = "correlated", region: Region | None = None) -> DataFrame:
    """Centres of n objects in the region, those with the least seeded hashes; fewer if there are not so many."""
    x, y = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    p = data.select("id", x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"))
    if region is not None:
        p = _in_region(p, region)
    return p.orderBy(_random(seed, 5), "id").limit(n).select("id", *_BOX, F.lit(True).alias("is_correlated"), F.lit(dataset).alias("dataset"))


def correlated_windows(data: DataFrame, region: Region, percent: float, n: int, seed: int = 1, containment: bool = False, dataset: str = "correlated") -> DataFrame:
    """n windows around objects that meet the region; with ``containment`` only those that properly contain an object; fewer if there are not so many."""
    x0, y0, x1, y1 = _bounds(region)
    s = (percent / 100) ** 0.5
    w, h = (x1 - x0) * s, (y1 - y0) * s
    cx, cy = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    q = data.select("id", (cx - w / 2).alias("xmin"), (cy - h / 2).alias("ymin"), (cx + w / 2).alias("xmax"), (cy + h / 2).alias("ymax"))
    q = _meets_region(q, region).withColumn("order", _random(seed, 5))
    total, tries = q.count(), n
    while True:
        some = q.orderBy("order", "id").limit(tries)
        if containment:
            from .selection import batch_query

            hit = batch_query(data, some.select(F.col("id").alias("qid"), *_BOX), Predicate.CONTAINS).select(F.col("qid").alias("id")).distinct()
            some = some.join(hit, "id", "left_semi")
        if tries >= total or not containment or some.count() >= n:
            break
        tries *= 4
    kind = "containment" if containment else "intersection"
    return some.orderBy("order", "id").limit(n).select("id", *_BOX, F.lit(float(percent)).alias("percentage"), F.lit(kind).alias("type"), F.lit(True).alias("is_correlated"), F.lit(dataset).alias("dataset"))


def summaries(executions: DataFrame) -> DataFrame:
    """Mean and deviation of a run's counts by execution name."""
    return executions.groupBy("execution_name").agg(
        F.count("*").alias("runs"), F.avg("cand_num").alias("avg_cand"), F.stddev_samp("cand_num").alias("std_cand"),
        F.avg("result_num").alias("avg_result"), F.stddev_samp("result_num").alias("std_result"),
    )


def measured_counts(data: DataFrame, queries: DataFrame, predicate: Predicate = Predicate.INTERSECTS) -> DataFrame:
    """Candidates and results of each query window, zero where there are none: (qid, cand_num, result_num)."""
    from .selection import batch_query

    counted = batch_query(data, queries, predicate, flag=True).groupBy("qid").agg(F.count("*").alias("cand_num"), F.sum(F.col("result").cast("long")).alias("result_num"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return queries.select("qid").join(counted, "qid", "left").select("qid", zero("cand_num"), zero("result_num"))
