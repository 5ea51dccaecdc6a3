"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: blank and \x09-\x0D.
WHITE = " \t\n\x0b\f\r"
WHITE_RE = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Stands for a null id where ids are ordered.
NULL_ID = 2**63 - 1
#: Keys that are broadcast at most (8 bytes each, some 40 MB when built); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_column(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_RE), lambda w: w != "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def mix(a: np.ndarray, b: np.ndarray | np.uint64 | int) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(32))) * _MIX[0] + np.uint64(b) * _MIX[1] if not isinstance(b, np.ndarray) else (a ^ (a >> np.uint64(32))) * _MIX[0] + b * _MIX[1]
        x ^= x >> np.uint64(29)
        x *= _MIX[2]
        x ^= x >> np.uint64(32)
    return x


class WordHashes(dict):
    """A bounded cache from a word's bytes to its 64-bit hash."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def as_bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts; one narrow pass."""
    return int(df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0)


def pieces_for(n_bytes: int, each: int) -> int:
    return max(1, math.ceil(n_bytes / each))


def shared_folder(spark: SparkSession) -> None:
    """Makes sure that checkpoint() has a folder; the cluster's own setting wins."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/checkpoints/gridloom"  # one machine: the driver is the only executor
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(keys: DataFrame, bound: int = BROADCAST_KEYS, ready: bool = False) -> DataFrame:
    """Keys, counted first (and cut, unless ``ready``): marked for broadcast if no more than bound, else as they are."""
    keys = keys if ready else cut(keys)
    return F.broadcast(keys) if keys.count() <= bound else keys


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df does not have, in whatever case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Lets the engine delete shuffle files whose DataFrames are out of use; it does so when their driver objects are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
