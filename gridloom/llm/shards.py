"""Sharding by rendezvous hashing over weighted shards.

Every record key is scored against every shard and goes to the best score, so
key and shard list alone decide: a further shard only takes rows into itself.
Only DataFrame functions run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Hash buckets that order a shard's rows, whatever the session's settings.
BUCKETS = 4096
_BITS = 52


def _number(key: Column, salt: str) -> Column:
    """A number below 2 ** 52 from a key and a salt: the head of their digest, which other systems compute alike."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("\0")), F.lit(f":{salt}")).cast("binary")), 1, _BITS // 4), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: the least of ``-ln(u) / weight`` with u in (0, 1) hashed from key and shard; of equal ones the first."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")

    def score(i: int, w: float) -> Column:
        u = (_number(key, str(i)).cast("double") + F.lit(0.5)) / F.lit(float(2**_BITS))
        return F.struct((-F.log(u) / F.lit(float(w))).alias("s"), F.lit(i).alias("i"))

    if len(weights) == 1:
        return F.lit(0)
    return F.least(*[score(i, w) for i, w in enumerate(weights)])["i"]


def shard(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * 8,
    grown: Sequence[float] | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """One row for each record: id_col, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers a shard's rows without gaps from 0 (by hash bucket of the
    key, then low bits of the checksum, key, checksum and size), in two steps: row numbers inside (shard,
    bucket) and the running count of the buckets before, so no shard is sorted
    in one task. ``grown`` holds the weights after growth (default: one more
    shard of the mean weight). Null texts count as empty. Null keys share one
    hash and so one shard; repeated keys share a shard, and their rows, dealt
    over further buckets by their texts' checksums, get slots of their own. An
    empty table gives an empty result; other columns are ignored. Nothing
    depends on partitions or on the session's settings.
    """
    grown = list(weights) + [sum(weights) / len(weights)] if grown is None else grown
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(id_col), weights).alias("shard"), rendezvous(F.col(id_col), grown).alias("grown_shard"),
        F.pmod(_number(F.col(id_col), "slot"), F.lit(buckets)).cast("int").alias("bucket"),
    ).withColumn("part", F.pmod("text_crc32", F.lit(16)).cast("int"))
    # a bucket's rows are ranked in parts by checksum, so those of one key are not one task's
    before = rows.groupBy("shard", "bucket", "part").agg(F.count("*").alias("n"))
    # at most shards x buckets x 16 rows: a bound by the parameters, whatever the input
    before = before.select("shard", "bucket", "part", (F.sum("n").over(_order("shard", "bucket", "part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket", "part").orderBy("id", "text_crc32", "size"))
    return rows.withColumn("rank", rank).join(before, ["shard", "bucket", "part"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard",
    )


def _order(part: str, *by: str):
    return Window.partitionBy(part).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
