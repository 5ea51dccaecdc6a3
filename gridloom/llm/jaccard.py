"""Exact n-gram Jaccard join by universe partition and the pigeonhole principle.

Texts become sets of hashed word shingles. Sizes fall into bands; for each band
the largest symmetric difference D of a linked pair is known. The universe of
shingles is hashed into segments, of which some must agree exactly and the
others up to one shingle, such that D differences cannot spoil all of them:
exact + 2 x one-deletion segments = D + 1. How many of each is chosen for each
band by cost: signatures to index against agreements by chance among the sets
of that size. Sets that share a signature, and whose counts of shingles in hash
cells differ by no more than D in all (no linked pair's do), fall into one
family, and every pair of a family is verified exactly.

Common signatures (empty segments, segments within a passage that many texts
have) say little and would chain strangers. Some segments more than D + 1 are
made, so that a set may leave its common signatures out as long as the others
still outweigh D: a linked set then agrees on one of the others. A set that
could not spare them keeps them all, so no link is lost.

Equal sets are one node (a 128-bit digest) throughout, so copies cost nothing
after the first pass. Families larger than a block are dealt over all pairs of
blocks. Signatures are made distinct in each batch before they are shuffled, and
only those that two nodes share meet the cell counts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WordHashes, cut, few, fresh, mix, release
from .components import connected_components

#: What a chance agreement costs, in signatures to index, for the cost model.
AGREEMENT = 0.05
#: Sets of one signature that are compared with each other; larger groups are chained without a comparison.
GROUP = 1500
#: Sets and shingles in a block of a family.
BLOCK_SETS, BLOCK_SHINGLES = 400, 400_000
#: A signature of more sets than this is common.
COMMON = 100
#: Segments beyond D + 1, so that common signatures can be left out.
SPARE = 0.15
_GROWTH = 1.5
_FIRST = 4


def shingles(text, hashes: WordHashes, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles; of all its words together if there are fewer."""
    if not isinstance(text, str):
        return np.zeros(0, np.uint64)
    w = hashes.of(text.encode("utf-8", "surrogatepass").lower().split())
    k = min(n, len(w))
    if not k:
        return w
    g = w[: len(w) - k + 1].copy()
    for j in range(1, k):
        g = mix(g, w[j : len(w) - k + 1 + j])
    return np.unique(g)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()

#: Twice the most bands that a set can sign for: those up to 100 times its size.
MARK = 32


@lru_cache(None)
def band_ends(most: int) -> tuple[int, ...]:
    out = [_FIRST]
    while out[-1] < most:
        out.append(int(out[-1] * _GROWTH))
    return tuple(out)


def band(size: int) -> int:
    ends = band_ends(1 << 40)
    return int(np.searchsorted(ends, size, "left"))


@dataclass(frozen=True)
class Allocation:
    """Segments of a band: exact ones and ones that allow one deletion."""

    exact: int
    one: int


def allocate(b: int, sets: int, percent: int) -> Allocation:
    """The cheapest allocation for a band that holds so many sets.

    Unrelated sets agree on a segment when both have nothing there, on one with
    a deletion when both have at most one shingle; agreements of more sets than
    are common mostly go. Where only equal sets can link there is one segment.
    """
    end = band_ends(1 << 40)[b]
    most = 2 * end * (100 - percent) // (100 + percent)
    need = most + 1 + math.ceil(SPARE * (most + 1)) if most else 1
    best = None
    for one in range(need // 2 + 1):
        exact = need - 2 * one
        c = end / (exact + one)
        chance, near = sets * math.exp(-2 * c), sets * ((1 + c) * math.exp(-c)) ** 2
        cost = exact * (1 + AGREEMENT * min(chance, COMMON)) + one * (c + 1 + AGREEMENT * min(near, COMMON))
        if best is None or cost < best[0]:
            best = (cost, Allocation(exact, one))
    return best[1]


def cells(s: np.ndarray) -> bytes:
    """Counts of a set's shingles in hash cells, a power of two of them, at most 255 each."""
    n = max(64, min(4096, 1 << max(0, (len(s) - 1) // 8).bit_length()))
    return np.minimum(np.bincount((mix(s, 0x1B873593) & np.uint64(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def folded(data: bytes, n: int) -> np.ndarray:
    """The counts in n cells; sums of parts, so that distances only shrink."""
    return np.frombuffer(data, np.uint8).astype(np.int32).reshape(-1, n).sum(0)


class Groups:
    """Takes rows (sig, node, n, cells) in the order of sig and gives a forest of the pairs that may link."""

    def __init__(self, percent: int):
        self.percent = percent
        self.sig = None
        self.held: dict[bytes, tuple[int, bytes]] = {}
        self.chained: bytes | None = None
        self.seen: set[int] = set()
        self.top: dict[bytes, bytes] = {}
        self.out: list[tuple[bytes, bytes]] = []

    def add(self, sig: int, node: bytes, n: int, data: bytes) -> None:
        if sig != self.sig:
            self.close()
            self.sig = sig
        if self.chained is not None:
            self.out.append((self.chained, node))
            self.chained = node
        elif node not in self.held:
            self.held[node] = (n, data)
            if len(self.held) > GROUP:
                names = list(self.held)
                self.out += zip(names, names[1:])
                self.chained = names[-1]
                self.held = {}

    def close(self) -> None:
        held, self.held, self.chained = self.held, {}, None
        if len(held) < 2:
            return
        key = hash(tuple(held))
        if key in self.seen:
            return
        if len(self.seen) > 1_000_000:
            self.seen.clear()
        self.seen.add(key)
        names = list(held)
        size = np.array([n for n, _ in held.values()], np.int64)
        least = min(len(d) for _, d in held.values())
        c = np.stack([folded(d, least) for _, d in held.values()])
        # what earlier groups have joined needs no comparison
        if len(self.top) > 1_000_000:
            self.top.clear()
        roots = [self._find(x) for x in names]
        number = {x: i for i, x in enumerate(dict.fromkeys(roots))}
        part = np.array([number[x] for x in roots])
        for i in range(len(names) - 1):
            apart = np.nonzero(part[i + 1 :] != part[i])[0] + i + 1
            if not len(apart):
                continue
            ok = np.abs(c[apart] - c[i]).sum(1) * (100 + self.percent) <= (size[i] + size[apart]) * (100 - self.percent)
            for j in apart[ok].tolist():
                if part[j] != part[i]:
                    part[part == part[j]] = part[i]
                    self.top[self._find(names[j])] = self._find(names[i])
                    self.out.append((names[i], names[j]))

    def _find(self, x: bytes) -> bytes:
        top = self.top
        while (y := top.get(x, x)) != x:
            top[x] = z = top.get(y, y)
            x = z
        return x


def signatures(s: np.ndarray, plan: dict[int, Allocation], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of a set: for its band, and for each further one that a linked set can be in.

    Each with a mark: MARK x the weight that the set can lose in this band, 2 x
    how many bands further it is, and 1 if the segment weighs two.
    """
    size = len(s)
    b = band(size)
    out, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    largest = size * 100 // percent
    for k in range(b, band(largest) + 1):
        a = plan.get(k)
        if a is None or (a.exact == 1 and not a.one):  # no set of this band, or only equal sets can link
            continue
        n = a.exact + a.one
        # no linked set of this band differs by more than d
        d = (size + min(largest, band_ends(1 << 40)[k])) * (100 - percent) // (100 + percent)
        mark = MARK * (n + a.one - d - 1) + 2 * (k - b)
        seg = (mix(s, 2 * k + 1) % np.uint64(n)).astype(np.int64)
        y = mix(s, 0x27D4EB2F165667C5)
        total = np.zeros(n, np.uint64)
        np.add.at(total, seg, y)
        tag = mix(np.arange(n, dtype=np.uint64), 1000003 * (k + 1) + n)
        out.append(mix(total, tag))
        marks.append(mark + (np.arange(n) < a.one))
        if a.one:
            near = seg < a.one
            out.append(mix(total[seg[near]] - y[near], tag[seg[near]]))
            marks.append(np.full(len(out[-1]), mark + 1))
    return np.concatenate(out), np.concatenate(marks)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The boolean matrix of linked pairs, from exact intersection sizes."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    head = np.ones(len(every), bool)
    head[1:] = every[1:] != every[:-1]
    ids = np.cumsum(head) - 1
    df = np.bincount(ids)
    keep = df[ids] > 1
    ids, owner = np.unique(ids[keep], return_inverse=True)[1], owner[keep]
    inter = np.zeros((n, n), np.float64)
    u = int(ids[-1]) + 1 if len(ids) else 0
    df = np.bincount(ids, minlength=u)
    if n * n * u < 25 * int((df.astype(np.int64) ** 2).sum()):
        step = 2048
        for a in range(0, u, step):
            lo, hi = np.searchsorted(ids, [a, a + step])
            m = np.zeros((n, step), np.float32)
            m[owner[lo:hi], ids[lo:hi] - a] = 1
            inter += m @ m.T
    else:
        begin = np.append(0, np.cumsum(df))
        by = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[by], np.arange(n + 1))
        for i in range(n):
            mine = ids[by[ends[i] : ends[i + 1]]]
            count = df[mine]
            at = np.repeat(begin[mine] - np.append(0, np.cumsum(count)[:-1]) if len(mine) else mine, count) + np.arange(int(count.sum()))
            inter[i] = np.bincount(owner[at], minlength=n)
    inter = np.rint(inter).astype(np.int64)
    union = size[:, None] + size[None, :] - inter
    out = 100 * inter >= percent * union
    np.fill_diagonal(out, False)
    out[size == 0] = False
    out[:, size == 0] = False
    return out


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row for each record: id_col, n_shingles, component_id, n_links.

    Two records link when ``100 * |intersection| >= percent * |union|`` of their
    shingle sets; A-Z are lowered. ``component_id`` is the least key reachable
    by links, ``n_links`` the number of other records linked. Null texts and
    texts without words have no shingles and link with nothing. Keys may be of
    any type that has an order; null ones count as the largest and stay null; a
    component of null keys only has a null id. Repeated rows link like other
    copies. An empty table gives an empty result; other columns are ignored;
    texts are read whole, and known by a 128-bit hash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    t = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), t.alias("t"), F.xxhash64(t).alias("x"), F.xxhash64(F.lit(1), t).alias("y"))

    def sizes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t, hashes, n) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "x", "y")], pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array([cells(s) for s in sets], pa.binary())],
                ["id", "x", "y", "n", "node", "cells"],
            )

    base = cut(rows.mapInArrow(sizes_of, f"id {kind}, x long, y long, n long, node binary, cells binary"))
    nodes = base.where("n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.min(F.struct("x", "y")).alias("text"), F.count("*").alias("copies"))
    band_of = F.lit(0)
    for i, end in enumerate(band_ends(1 << 40)[:-1]):
        band_of = band_of + (F.col("n") > end).cast("int")
    # a row for each band that occurs: under a hundred
    count = {r["band"]: r["count"] for r in nodes.select(band_of.alias("band")).groupBy("band").count().collect()}
    plan = {b: allocate(b, count.get(b, 0) + count.get(b - 1, 0), percent) for b in count}

    def candidate_edges() -> DataFrame:
        """Written to the shared folder; the shuffles behind it may go."""
        def signatures_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashes = WordHashes()
            for pdf in batches:
                seen: set[bytes] = set()
                sig, mark, node = [], [], []
                held = 0
                for t in pdf["t"]:
                    s = shingles(t, hashes, n)
                    d = digest(s)
                    if len(s) and d not in seen:
                        seen.add(d)
                        x, m = signatures(s, plan, percent)
                        sig.append(x)
                        mark.append(m)
                        node += [d] * len(x)
                        held += len(x)
                    if held > 200_000:
                        yield pd.DataFrame({"sig": np.concatenate(sig).view(np.int64), "node": node, "mark": np.concatenate(mark)})
                        sig, mark, node, held = [], [], [], 0
                if held:
                    yield pd.DataFrame({"sig": np.concatenate(sig).view(np.int64), "node": node, "mark": np.concatenate(mark)})

        signed = rows.where("t is not null").mapInPandas(signatures_of, "sig long, node binary, mark int")
        w = Window.partitionBy("sig").orderBy("node")
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first = F.coalesce(F.lag("node").over(w) != F.col("node"), F.lit(True))
        shared = signed.withColumn("first", first).where("first").withColumn("sets", F.count("*").over(whole)).where("sets > 1").repartition("node")
        # what a set loses in a band without its common signatures, and whether it can
        common = F.col("sets") > COMMON
        lost = F.sum(F.when(common, F.col("mark") % 2 + 1).otherwise(0)).over(Window.partitionBy("node", F.floor(F.col("mark") / 2)))
        shared = shared.withColumn("lost", lost).where(~common | (F.col("lost") > F.floor(F.col("mark") / MARK))).select("sig", "node")
        sketch = base.where("n > 0").groupBy("node").agg(F.max(F.struct("n", "cells")).alias("s"))

        def may_link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            groups = Groups(percent)
            for pdf in batches:
                for row in zip(pdf["sig"].tolist(), map(bytes, pdf["node"]), pdf["n"].tolist(), map(bytes, pdf["cells"])):
                    groups.add(*row)
                if groups.out:
                    yield pd.DataFrame(groups.out, columns=["a", "b"])
                    groups.out = []
            groups.close()
            yield pd.DataFrame(groups.out, columns=["a", "b"])

        chain = shared.join(sketch, "node").select("sig", "node", "s.n", "s.cells").repartition("sig").sortWithinPartitions("sig").mapInPandas(may_link, "a binary, b binary")
        return cut(chain.distinct())

    chain = candidate_edges()
    release(docs.sparkSession)
    families = connected_components(chain)
    member = cut(families.join(nodes, "node").select("node", F.col("root").alias("family"), "n", "copies", "text.x", "text.y"))
    blocks = member.groupBy("family").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("k")
    )
    def verified_links() -> DataFrame:
        """Written to the shared folder as well."""
        # one text for each node; only the members' texts are shuffled if their keys are few enough
        placed = member.join(blocks, "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
        theirs = rows.join(few(member.select("x", "y").distinct()), ["x", "y"], "left_semi").groupBy("x", "y").agg(F.first("t").alias("t"))
        texts = theirs.join(placed, ["x", "y"]).select("family", "node", "copies", "own", "k", "t")
        dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
            "family", "node", "copies", "own", "t", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
        )

        def verify(pdf: pd.DataFrame) -> pd.DataFrame:
            x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
            hashes = WordHashes()
            seen, sets, at = set(), [], []
            for i, (t, d) in enumerate(zip(pdf["t"], pdf["node"])):
                d = bytes(d)
                if d not in seen:
                    s = shingles(t, hashes, n)
                    if digest(s) == d:
                        seen.add(d)
                        sets.append(s)
                        at.append(i)
            out: list[tuple] = []
            if len(sets) > 1:
                pdf = pdf.iloc[at]
                link = linked(sets, percent)
                if x != y:  # pairs inside a block belong to that block's own task
                    own = pdf["own"].to_numpy()
                    link &= own[:, None] != own[None, :]
                name = [bytes(d) for d in pdf["node"]]
                many = link @ pdf["copies"].to_numpy(np.int64)
                out += [(name[i], None, int(c)) for i, c in enumerate(many) if c]
                left = np.ones(len(sets), bool)
                for i in range(len(sets)):
                    if left[i]:
                        left[i] = False
                        todo = [i]
                        while todo:
                            v = todo.pop()
                            for w in np.nonzero(link[v] & left)[0]:
                                left[w] = False
                                out.append((name[v], name[w], 0))
                                todo.append(int(w))
            return pd.DataFrame(out, columns=["a", "b", "links"])

        return cut(dealt.groupBy("family", "x", "y").applyInPandas(verify, "a binary, b binary, links long"))

    found = verified_links()
    release(docs.sparkSession)
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    least = roots.join(nodes, "node").groupBy("root").agg(F.min("rep").alias("least"))
    known = nodes.join(roots, "node", "left").join(least, "root", "left").join(links, "node", "left").select(
        "node", F.coalesce("least", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    known = cut(known)
    return base.select("id", "n", "node").join(known, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One record of each group of linked records, with all its columns; records without words all stay.

    Records are told apart by their place in the input, so null and repeated
    keys need no care; the input must read alike each time, as a table does. Null
    and empty texts stay, of repeated rows one stays, an empty table gives an
    empty result, other columns pass whatever their names.
    """
    name = fresh(docs, "row")
    rows = docs.withColumn(name, F.monotonically_increasing_id())
    gone = jaccard_groups(rows, name, text_col, n, percent).where(F.col(name) != F.col("component_id")).select(name)
    return rows.join(few(gone), name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
