"""Analytics over page request traces (pe_id, rw_order, op_type, op_timestamp, page_id)."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesced_runs(trace: DataFrame) -> DataFrame:
    """Runs of requests of one kind to consecutive ascending pages: each is one device operation."""
    w = Window.partitionBy("pe_id").orderBy("rw_order")
    follows = (F.col("page_id") == F.lag("page_id").over(w) + 1) & (F.col("op_type") == F.lag("op_type").over(w))
    marked = trace.withColumn("head", F.when(follows, 0).otherwise(1))
    run = F.sum("head").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("run", run).groupBy("pe_id", "run").agg(
        F.first("op_type").alias("op_type"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"), F.count("*").cast("long").alias("pages")
    )


def operations(trace: DataFrame) -> DataFrame:
    """Requests, distinct pages and coalesced operations of each run and kind."""
    runs = coalesced_runs(trace).groupBy("pe_id", "op_type").agg(F.count("*").alias("operations"), F.max("pages").alias("longest"))
    requests = trace.groupBy("pe_id", "op_type").agg(F.count("*").alias("requests"), F.count_distinct("page_id").alias("pages"))
    return requests.join(runs, ["pe_id", "op_type"])


def reuse_distances(trace: DataFrame) -> DataFrame:
    """For each request the number of distinct other pages since the last request of its page; null at first.

    One group for each pe_id, n log n by a Fenwick tree over last positions.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rw_order", ignore_index=True)
        n = len(pdf)
        tree = np.zeros(n + 1, np.int64)

        def add(i: int, v: int) -> None:
            i += 1
            while i <= n:
                tree[i] += v
                i += i & -i

        def upto(i: int) -> int:
            s = 0
            while i:
                s += tree[i]
                i -= i & -i
            return int(s)

        last: dict[int, int] = {}
        out = []
        for i, p in enumerate(pdf["page_id"].tolist()):
            j = last.get(p)
            out.append(None if j is None else upto(i) - upto(j + 1))
            if j is not None:
                add(j, -1)
            add(i, 1)
            last[p] = i
        return pd.DataFrame({"pe_id": pdf["pe_id"], "rw_order": pdf["rw_order"], "page_id": pdf["page_id"], "distance": pd.array(out, dtype="Int64")})

    return trace.groupBy("pe_id").applyInPandas(one, "pe_id int, rw_order int, page_id int, distance long")


def lru_curve(trace: DataFrame, slots: list[int]) -> DataFrame:
    """Hits and faults of an LRU cache of each size, from the reuse distances alone."""
    d = reuse_distances(trace).withColumn("slots", F.explode(F.array(*[F.lit(s) for s in slots])))
    hit = F.coalesce(F.col("distance") < F.col("slots"), F.lit(False))
    return d.groupBy("pe_id", "slots").agg(F.sum(hit.cast("long")).alias("hits"), F.sum((~hit).cast("long")).alias("faults"))


class Cache:
    """A page cache: ``request`` says whether a page was held, and counts writes of dirty victims."""

    def __init__(self, capacity: int):
        self.capacity, self.hits, self.faults, self.writes = capacity, 0, 0, 0

    def request(self, page: int, write: bool, height: int = 0) -> bool:
        hit = self.touch(page, write, height)
        self.hits += hit
        self.faults += not hit
        return hit

    def touch(self, page: int, write: bool, height: int) -> bool:
        raise NotImplementedError

    def flush(self) -> int:
        raise NotImplementedError


class LRU(Cache):
    """The least recently used page goes; without room for one page everything passes by."""

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.held: OrderedDict[int, bool] = OrderedDict()

    def touch(self, page, write, height):
        if not self.capacity:
            self.writes += write
            return False
        hit = page in self.held
        dirty = self.held.pop(page, False) or write
        if not hit and len(self.held) >= self.capacity:
            self.writes += self.held.popitem(last=False)[1]
        self.held[page] = dirty
        return hit

    def flush(self):
        n = sum(self.held.values())
        self.writes += n
        self.held.clear()
        return n


class HeightLRU(LRU):
    """LRU that never gives up a page higher in the tree for a lower one; without a victim the page passes by."""

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.height: dict[int, int] = {}

    def touch(self, page, write, height):
        if page in self.held:
            self.held[page] = self.held.pop(page) or write
            return True
        if len(self.held) >= self.capacity:
            victim = next((p for p in self.held if self.height[p] <= height), None)
            if victim is None:
                self.writes += write
                return False
            self.writes += self.held.pop(victim)
            del self.height[victim]
        self.held[page], self.height[page] = write, height
        return False


class SimplifiedTwoQueue(Cache):
    """A queue of page numbers seen once, and an LRU for pages seen again."""

    def __init__(self, capacity: int, ghosts: int):
        super().__init__(capacity)
        self.main, self.once, self.ghosts = LRU(capacity), OrderedDict(), ghosts

    def touch(self, page, write, height):
        if page in self.main.held:
            return self.main.touch(page, write, height)
        if page in self.once:
            del self.once[page]
            self.main.touch(page, write, height)
        else:
            self.once[page] = None
            if len(self.once) > self.ghosts:
                self.once.popitem(last=False)
            self.writes += write
        return False

    def flush(self):
        return self.main.flush()


class TwoQueue(Cache):
    """New pages enter a first-in queue; pages that return after they left it enter an LRU."""

    def __init__(self, capacity: int, new_share: float = 0.25, ghosts: int | None = None):
        super().__init__(capacity)
        self.room = max(1, int(capacity * new_share))
        self.main = LRU(max(1, capacity - self.room))
        self.new: OrderedDict[int, bool] = OrderedDict()
        self.gone: OrderedDict[int, None] = OrderedDict()
        self.ghosts = capacity // 2 if ghosts is None else ghosts

    def touch(self, page, write, height):
        if page in self.main.held:
            return self.main.touch(page, write, height)
        if page in self.new:
            self.new[page] |= write
            return True
        if page in self.gone:
            self.main.touch(page, write, height)
            return False
        if len(self.new) >= self.room:
            old, dirty = self.new.popitem(last=False)
            self.writes += dirty
            self.gone[old] = None
            self.gone.move_to_end(old)
            if len(self.gone) > self.ghosts:
                self.gone.popitem(last=False)
        self.new[page] = write
        return False

    def flush(self):
        n = sum(self.new.values())
        self.writes += n
        self.new.clear()
        return n + self.main.flush()


POLICIES: dict[str, Callable[[int], Cache]] = {
    "LRU": LRU, "HLRU": HeightLRU, "S2Q": lambda n: SimplifiedTwoQueue(n, max(1, n // 2)), "2Q": TwoQueue, "NONE": lambda n: LRU(0),
}


def totals(cache: Cache) -> tuple[int, int, int, int]:
    """Hits, faults, writes and what was flushed at the end."""
    flushed = cache.flush()
    return cache.hits, cache.faults, cache.writes + getattr(getattr(cache, "main", None), "writes", 0), flushed


def replay(trace: DataFrame, policy: str, slots: int) -> DataFrame:
    """Hits, faults and page writes of a policy for each pe_id; a column ``height`` is used if there is one."""
    make = POLICIES[policy]
    high = F.col("height").cast("int") if "height" in trace.columns else F.lit(0)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rw_order")
        cache = make(slots)
        for p, op, h in zip(pdf["page_id"].tolist(), pdf["op_type"], pdf["height"].tolist()):
            cache.request(p, op == "WRITE", h)
        return pd.DataFrame([(pdf["pe_id"].iloc[0], *totals(cache))], columns=["pe_id", "hits", "faults", "writes", "flushed"])

    t = trace.select("pe_id", "rw_order", "op_type", "page_id", high.alias("height"))
    out = t.groupBy("pe_id").applyInPandas(one, "pe_id int, hits long, faults long, writes long, flushed long")
    return out.select("pe_id", F.lit(policy).alias("policy"), F.lit(slots).alias("slots"), "hits", "faults", "writes", "flushed")
