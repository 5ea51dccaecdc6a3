"""Byte-level BPE by merge replay over a corpus block, and decoding.

The distinct pre-tokens of a block of documents are laid out end to end, an
inverted index from token pair (by the rank of what it merges to) to positions
is built once, and the merges are applied in rank order over the whole block;
each merge updates only its two neighbours. Documents then look their
pre-tokens up. A task sees one bounded block at a time, so nothing is shuffled
and a lost executor only costs its own blocks.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text replayed at once, and pre-tokens kept for later blocks.
BLOCK_CHARS = 4_000_000
CACHED_WORDS = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes many pre-tokens at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {v: k for k, v in ranks.items()}
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[int, int] = {}

    def _rank(self, a: int, b: int) -> int:
        """The rank that tokens a and b merge to, or -1."""
        key = a << 32 | b
        r = self.pairs.get(key)
        if r is None:
            r = self.pairs[key] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return r

    def encode(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        sym: list[int] = []
        starts: list[int] = []
        whole, single = self.ranks, self.single
        todo: list[int] = []
        for i, w in enumerate(words):
            r = whole.get(w)
            if r is not None:  # as the library does, a pre-token that is a token stays whole
                out.append([r])
            else:
                out.append([])
                if w:
                    todo.append(i)
                    starts.append(len(sym))
                    sym.extend([single[c] for c in w])
                    sym.append(-1)
        if not todo:
            return out
        n = len(sym)
        # -1 in sym ends a word; left and right skip what has been merged away
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        cur = [-1] * n  # rank of the pair that starts here, -1 if none
        index: dict[int, list[int]] = {}
        pairs, rank_of = self.pairs, self._rank
        for p in range(n - 1):
            a, b = sym[p], sym[p + 1]
            if a >= 0 and b >= 0:
                r = pairs.get(a << 32 | b)
                if r is None:
                    r = rank_of(a, b)
                if r >= 0:
                    cur[p] = r
                    at = index.get(r)
                    if at is None:
                        index[r] = [p]
                    else:
                        at.append(p)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            at = index.pop(r, None)
            if at is None:
                continue
            at.sort()
            held_to = -1  # a lower rank arose in the word that ends here: its later pairs wait
            for p in at:
                if cur[p] != r:
                    continue
                if p < held_to:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heapq.heappush(heap, r)
                    continue
                q = right[p]
                sym[p] = r
                cur[q] = -1
                sym[q] = -2
                z = right[q]
                right[p] = z
                left[z] = p
                low = False
                b = sym[z]
                if b >= 0:
                    x = pairs.get(r << 32 | b)
                    if x is None:
                        x = rank_of(r, b)
                    cur[p] = x
                    if x >= 0:
                        low = x < r
                        if x in index:
                            index[x].append(p)
                        else:
                            index[x] = [p]
                            heapq.heappush(heap, x)
                else:
                    cur[p] = -1
                y = left[p]
                if y >= 0 and (a := sym[y]) >= 0:
                    x = pairs.get(a << 32 | r)
                    if x is None:
                        x = rank_of(a, r)
                    cur[y] = x
                    if x >= 0:
                        low = low or x < r
                        if x in index:
                            index[x].append(y)
                        else:
                            index[x] = [y]
                            heapq.heappush(heap, x)
                if low:
                    held_to = p
                    while sym[held_to] != -1:
                        held_to += 1
        for i, s in zip(todo, starts):
            ids, p = out[i], s
            while sym[p] >= 0:
                ids.append(sym[p])
                p = right[p]
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        return out


class Codec:
    """Text to ids as little-endian 32-bit bytes, and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay = MergeReplay(ranks)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split, known = self.split, self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        cut = [split(t) for t in texts]
        new: dict[str, None] = {}
        for words in cut:
            for w in set(words):
                if w not in known:
                    new[w] = None
        todo = list(new)
        for w, ids in zip(todo, self.replay.encode([w.encode("utf-8", "surrogatepass") for w in todo])):
            known[w] = np.array(ids, dtype="<u4").tobytes()
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, decode: bool = True) -> DataFrame:
    """One row for each record: id_col, n_tokens, ids (little-endian 32-bit) and, with ``decode``, decoded; or their SHA-256 with ``digests``.

    Null texts encode as empty ones: no tokens. Null ids stay null, repeated
    rows stay repeated, an empty table gives an empty result and other columns
    are ignored. Very long texts and pre-tokens are encoded whole; a pre-token
    costs in proportion to its length. ``ranks_path`` is read on the driver.
    """
    ranks = load_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file: bounded

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(shared.value, pattern)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["t"]]
            for lo, hi in _blocks(texts):
                ids = codec.encode(texts[lo:hi])
                out = {"i": pdf["i"].iloc[lo:hi].to_numpy(), "n_tokens": [len(x) // 4 for x in ids]}
                if digests:
                    out["ids"] = [hashlib.sha256(x).hexdigest() for x in ids]
                    out["decoded"] = [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]
                else:
                    out["ids"], out["decoded"] = ids, [codec.decode(x) if decode else None for x in ids]
                yield pd.DataFrame(out)

    kind = "string" if digests else "binary"
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    done = rows.mapInPandas(run, f"i string, n_tokens long, ids {kind}, decoded {kind}")
    a, b = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    return done.select(F.col("i").cast(id_type).alias(id_col), "n_tokens", F.col("ids").alias(a), *[F.col("decoded").alias(b)] * decode)
