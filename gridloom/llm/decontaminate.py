"""Benchmark decontamination by winnowing.

Items and documents are reduced to winnowed fingerprints: of every ``window``
consecutive k-gram hashes the least one (the rightmost of equals). Any shared
span of ``span`` = k + window - 1 words has a common fingerprint, so an
equi-join of the two sides' fingerprints finds it; each pair of a text and an
item that meets is then extended word by word, on the words themselves, and
only whole shared spans count. Items below ``span`` words, which winnowing does
not cover, have one fingerprint, of all their words.

Fingerprints of documents that no item has are left out before the join if the
items' distinct ones are no more than ``bound``: then they are sent to every
task, else all are joined by a shuffle. Texts are known by a 128-bit hash, so
copies are verified once and need no key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BROADCAST_KEYS, WordHashes, cut, few, fresh, mix

SPAN = 13
#: Words in a fingerprinted gram; the window is SPAN - GRAM + 1 grams.
GRAM = 5
#: Text of items that is broadcast at most to be compared with the documents'.
ITEM_BYTES = 32_000_000

_OTHER = bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_TABLE = bytes(0x20 if c in _OTHER else c for c in range(256))


def words_of(text: str) -> list[bytes]:
    """A-Z lowered, then runs of digits, a-z and all non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TABLE).split()


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams."""
    g = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        g = mix(g, h[j : len(h) - k + 1 + j])
    return g


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of each window of ``window`` grams, rightmost of equals."""
    n = len(g) - window + 1
    if n < 1:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    low = g[:n].copy()
    for j in range(1, window):
        x = g[j : n + j]
        take = x <= low
        low = np.where(take, x, low)
        at = np.where(take, np.arange(j, n + j), at)
    return np.unique(at)


def prints_of(h: np.ndarray, lengths: set[int], of_item: bool = False) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length of short items or 0, fingerprints, places) of a text's word hashes. An item has those of its own length only."""
    out = []
    n = len(h)
    g = h
    short = {n} if of_item and n < SPAN else set() if of_item else lengths - {0}
    for k in range(1, min(n, max([0, *short])) + 1):
        if k > 1:
            g = mix(g[:-1], h[k - 1 :])
        if k in short:
            out.append((k, g, np.arange(len(g))))
    if n >= SPAN and (of_item or 0 in lengths):
        g = grams(h, GRAM)
        at = winnow(g, SPAN - GRAM + 1)
        out.append((0, g[at], at))
    return out


def shared_spans(doc: list[bytes], item: list[bytes], at: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches of doc, of whole windows of item, around the places (doc place, item place, short length or 0) whose fingerprints meet."""
    out = []
    done: dict[int, int] = {}
    for p, q, m in sorted(at):
        if m:
            if doc[p : p + m] == item:
                out.append((p, p + m))
        elif done.get(p - q, -1) <= p:  # else inside a stretch that has been extended already
            a, b = p, p
            while a and q - (p - a) and doc[a - 1] == item[q - (p - a) - 1]:
                a -= 1
            while b < len(doc) and q + b - p < len(item) and doc[b] == item[q + b - p]:
                b += 1
            done[p - q] = max(b, p + 1)
            if b - a >= SPAN:
                out.append((a, b))
    return out


def _item_prints(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            item, m, fp, q = [], [], [], []
            for i, t in zip(batch.column("item").to_pylist(), batch.column("t").to_pylist()):
                for k, g, at in prints_of(hashes.of(words_of(t)), set(), True):
                    item.append(np.full(len(at), i, np.int64))
                    m.append(np.full(len(at), k, np.int32))
                    fp.append(g.view(np.int64))
                    q.append(at.astype(np.int32))
            if item:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (item, m, fp, q)], ["item", "m", "fp", "q"])

    return items.mapInArrow(run, "item long, m int, fp long, q int")


def _hits(rows: DataFrame, base: DataFrame, items: DataFrame, prints: DataFrame, bound: int) -> DataFrame:
    """x, y, n_hit, names, unnamed for the texts (x, y) with a window of an item. base: x, y, m, fp, at."""
    at = base.where(F.size("fp") > 0).select("x", "y", F.explode(F.arrays_zip("m", "fp", "at")).alias("f")).select("x", "y", "f.m", "f.fp", F.col("f.at").alias("p"))
    met = at.join(few(prints, bound, ready=True), ["m", "fp"])
    pairs = cut(met.groupBy("x", "y", "item").agg(F.collect_set(F.struct("p", "q", "m")).alias("places")))
    theirs = rows.join(few(pairs.select("x", "y").distinct(), bound), ["x", "y"], "left_semi").groupBy("x", "y").agg(F.first("t").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    named = items.select("item", "name", F.col("t").alias("words"))
    named = pairs.join(F.broadcast(named) if size <= min(ITEM_BYTES, bound * 1000) else named, "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, doc = None, []
        known: dict[int, list[bytes]] = {}
        for batch in batches:
            rows = []
            for x, y, i, name, w, places, t in zip(*[batch.column(c).to_pylist() for c in ("x", "y", "item", "name", "words", "places", "t")]):
                if (x, y) != last:
                    last, doc = (x, y), words_of(t)
                if i not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[i] = words_of(w)
                spans = shared_spans(doc, known[i], [(v["p"], v["q"], v["m"]) for v in places])
                if spans:
                    rows.append((x, y, name, [{"a": a, "b": b} for a, b in spans]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["x", "y", "name", "spans"])

    found = named.join(theirs, ["x", "y"]).sortWithinPartitions("x", "y").mapInArrow(verify, "x long, y long, name string, spans array<struct<a:int,b:int>>")
    covered = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda v, s: F.struct((v["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], v["end"]))).alias("n"), F.greatest(v["end"], s["b"]).alias("end")),
    )["n"]
    return found.groupBy("x", "y").agg(
        covered.cast("long").alias("n_hit"), F.array_sort(F.collect_set("name")).alias("names"), F.max(F.col("name").isNull().cast("int")).alias("unnamed")
    )


def _judged(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, null_items: bool, bound: int, all_rows: bool) -> tuple[DataFrame, DataFrame]:
    """(base, hits) of rows (x, y, t, and what else base is to keep)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(item_text_col).cast("string").alias("t")).where("t is not null")
    items = cut((items if null_items else items.where("name is not null")).withColumn("item", F.monotonically_increasing_id()))
    prints = cut(_item_prints(items))
    keys = prints.select("m", "fp").distinct()
    lengths = {r["m"] for r in prints.select("m").distinct().collect()}  # at most SPAN of them
    known = None
    if (n := keys.count()) <= bound:  # 12 bytes each
        got = keys.limit(n).toArrow()
        m, fp = got.column("m").to_numpy(), got.column("fp").to_numpy().view(np.uint64)
        known = {k: np.sort(fp[m == k]) for k in lengths}
    shared = rows.sparkSession.sparkContext.broadcast(known)
    kept = [c for c in rows.columns if c != "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), shared.value
        for batch in batches:
            many, ms, fps, ats = [], [], [], []
            for t in batch.column("t").to_pylist():
                h = hashes.of(words_of(t)) if t else np.zeros(0, np.uint64)
                many.append(len(h))
                m, fp, at = [], [], []
                for k, g, p in prints_of(h, lengths):
                    if known is not None:
                        keys = known[k]
                        ok = keys[np.minimum(np.searchsorted(keys, g), len(keys) - 1)] == g
                        g, p = g[ok], p[ok]
                    if len(g):
                        m.append(np.full(len(g), k, np.int32))
                        fp.append(g.view(np.int64))
                        at.append(p.astype(np.int32))
                ms.append(np.concatenate(m) if m else [])
                fps.append(np.concatenate(fp) if m else [])
                ats.append(np.concatenate(at) if m else [])
            out = pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(many, pa.int64()), pa.array(ms, pa.list_(pa.int32())), pa.array(fps, pa.list_(pa.int64())), pa.array(ats, pa.list_(pa.int32()))],
                [*kept, "n", "m", "fp", "at"],
            )
            yield out if all_rows else out.filter(pa.array([len(v) > 0 for v in ms], pa.bool_()))

    schema = StructType(rows.select(*kept).schema.fields + StructType.fromDDL("n long, m array<int>, fp array<long>, at array<int>").fields)
    base = cut(rows.mapInArrow(run, schema))
    return base, _hits(rows, base, items, prints, bound)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    percent: int = 5, null_items: bool = False, bound: int = BROADCAST_KEYS,
) -> DataFrame:
    """One row for each record: id_col, n_words, n_hit, n_items, items, items_sha256, contaminated.

    A window is SPAN consecutive words of an item, or the whole of a shorter
    one. ``items`` lists the ids of items with an occurring window, sorted as
    strings; items of equal id count once. A record is contaminated if at least
    ``percent`` of its words are in such windows. Null and empty texts have no
    words; items without words never occur, nor do those with a null id unless
    ``null_items``: then they count in n_hit and contaminated, together as one
    item in n_items, and only ``items`` leaves the null out. Keys may be of any
    type and are not looked at: null ones stay null, repeated rows stay
    repeated. An empty table on either side gives zero hits, other columns are
    ignored, texts are read whole.
    """
    t = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), t.alias("t"), F.xxhash64(t).alias("x"), F.xxhash64(F.lit(1), t).alias("y"))
    base, hits = _judged(rows, benchmark, item_col, item_text_col, null_items, bound, True)
    none = F.array().cast("array<string>")
    zero = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    out = base.select("id", "x", "y", "n").join(hits, ["x", "y"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_words"), zero.alias("n_hit"), F.coalesce(F.size("names") + F.col("unnamed"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("names", none).alias("items"), F.sha2(F.array_join(F.coalesce("names", none), ",").cast("binary"), 256).alias("items_sha256"),
        ((zero > 0) & (100 * zero >= percent * F.col("n"))).alias("contaminated"),
    )
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    percent: int = 5, null_items: bool = False, bound: int = BROADCAST_KEYS,
) -> DataFrame:
    """The records that are not contaminated, with all their columns, whatever these are called.

    Null and empty texts stay, repeated rows go or stay together, keys are not
    looked at, an empty table on either side drops nothing. ``null_items`` as in
    decontaminate.
    """
    t = F.col(text_col).cast("string")
    rows = docs.select(t.alias("t"), F.xxhash64(t).alias("x"), F.xxhash64(F.lit(1), t).alias("y"))
    base, hits = _judged(rows, benchmark, item_col, item_text_col, null_items, bound, False)
    x, y = fresh(docs, "x"), fresh(docs, "y")
    bad = base.select("x", "y", "n").distinct().join(hits, ["x", "y"]).where(100 * F.col("n_hit") >= percent * F.col("n"))
    bad = bad.select(F.col("x").alias(x), F.col("y").alias(y))
    return docs.withColumns({x: F.xxhash64(t), y: F.xxhash64(F.lit(1), t)}).join(few(bad, bound), [x, y], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
