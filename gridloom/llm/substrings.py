"""Substring dedup by recompression.

Rounds replace runs of one word, and then pairs of a left and a right symbol,
by new symbols. A symbol's name is a 128-bit hash of what it stands for, and
its side a bit of that name, so every round's names hold in the whole corpus
without an exchange, and equal substrings get equal symbols but for a few at
their borders. Three Spark rounds follow:

1. Symbols. Low ones (after LOW rounds) and high ones (after each of HIGH
   rounds, WINDOW words or longer) are compared over the corpus.
2. Reveal. A high symbol that an earlier record has too removes all the words
   it stands for at once. A window with a low symbol inside that is unique in
   the corpus is itself unique. Only windows between the two remain.
3. Verify. A remaining window is named by the symbols that it consists of:
   round by round those at its ends that words beyond could change are taken
   off, until nothing is left. That sequence depends on the window's words
   alone and gives them back, so windows are equal if their symbols are. The
   earliest of equal windows stays.

Records are dealt to pieces by one exchange of the texts that is read three
times. Symbols and windows travel as packed arrays by (piece, bucket), each
distinct one once for a piece however often it occurs there, so a passage in a
third of all rows sends one entry for each piece. The replies are bit maps and
word positions.
"""

from __future__ import annotations

import hashlib
from array import array
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .common import cut, mix, pieces_for, text_bytes

WINDOW = 20
#: Rounds of pairs (after the round of runs) behind the symbols that prune, and behind those that reveal.
LOW = 4
HIGH = (14, 18, 22)
#: Text in a piece, in a partition of pieces, and in the words behind one bucket.
PIECE_BYTES = 1_500_000
PARTITION_BYTES = 16_000_000
BUCKET_BYTES = 12_000_000
_CACHED_WORDS = 100_000


class WordNames(dict):
    """A bounded cache of words' names, as places in two arrays."""

    def __init__(self):
        self.a, self.b = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        x = xxhash.xxh3_128_intdigest(word)
        self.a.append(max(x >> 64, 1))
        self.b.append(x & 0xFFFFFFFFFFFFFFFF)
        self[word] = n = len(self.a) - 1
        return n

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.a) > _CACHED_WORDS:
            self.clear()
            self.a, self.b = array("Q"), array("Q")
        at = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return np.frombuffer(self.a, np.uint64)[at] if len(at) else np.zeros(0, np.uint64), np.frombuffer(self.b, np.uint64)[at] if len(at) else np.zeros(0, np.uint64)


def _second(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The second half of a name made of two."""
    z = x * np.uint64(0xA0761D6478BD642F) + y
    z ^= z >> np.uint64(31)
    z *= np.uint64(0xE7037ED1A0B428DB)
    z ^= z >> np.uint64(28)
    return z


class Parse:
    """The recompression of a piece: words of all its texts with a 0 after each text."""

    def __init__(self, texts: list[bytes], names: WordNames | None = None, rounds: int = max(HIGH)):
        names = WordNames() if names is None else names
        a, b, lengths = [], [], []
        zero = np.zeros(1, np.uint64)
        for t in texts:
            x, y = names.of(t.split())
            a += [x, zero]
            b += [y, zero]
            lengths.append(len(x))
        self.lengths = np.array(lengths, np.int64)
        a, b = (np.concatenate(v) if v else np.zeros(0, np.uint64) for v in (a, b))
        n = len(a)
        head = np.ones(n, bool)
        head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (a[1:] == 0)
        self.run = (np.cumsum(head) - 1).astype(np.int32)
        begin = np.nonzero(head)[0].astype(np.int32)
        self.word_a, self.word_b = a[head], b[head]
        self.begins = [np.append(begin, np.int32(n))]
        count = np.diff(self.begins[0]).astype(np.uint64)
        a, b = self.word_a.copy(), self.word_b.copy()
        long = count > 1
        a[long], b[long] = mix(a[long], count[long]), _second(b[long], count[long])
        #: For each round: names, whether a symbol is a right one, and the place of its successor in the next round.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for r in range(rounds):
            right = (mix(a, 0x5851F42D4C957F2D + r) >> np.uint64(63)).astype(bool)
            text = a != 0
            joins = np.zeros(len(a), bool)
            joins[:-1] = ~right[:-1] & right[1:] & text[:-1] & text[1:]
            head = np.ones(len(a), bool)
            head[1:] = ~joins[:-1]
            to = (np.cumsum(head) - 1).astype(np.int32)
            self.levels.append((a, b, right, to))
            at = np.nonzero(joins)[0]
            x, y = a[head], b[head]
            x[to[at]], y[to[at]] = np.maximum(mix(a[at], a[at + 1]), np.uint64(1)), _second(b[at], b[at + 1])
            a, b = x, y
            begin = begin[head]
            self.begins.append(np.append(begin, np.int32(n)))
        self.levels.append((a, b, np.zeros(len(a), bool), np.zeros(len(a), np.int32)))

    def starts(self) -> np.ndarray:
        """Places where a whole window begins."""
        if not len(self.lengths):
            return np.zeros(0, np.int64)
        begin = np.cumsum(np.append(0, self.lengths[:-1] + 1))
        count = np.maximum(self.lengths - WINDOW + 1, 0)
        return np.repeat(begin - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(int(count.sum()))

    def interior(self, starts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window the range of that round's symbols that no words beyond it could change."""
        f, e = self.run[starts] + 1, self.run[starts + WINDOW - 1].copy()
        for r in range(rounds):
            _, _, right, to = self.levels[r]
            end = len(right) - 1
            f = f + ((f < e) & right[np.minimum(f, end)])
            e = e - ((f < e) & ~right[np.maximum(e, 1) - 1])
            some = f < e
            f, e = np.where(some, to[np.minimum(f, end)], 0), np.where(some, to[np.maximum(e, 1) - 1] + 1, 0)
        return f, np.maximum(e, f)

    def window_names(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of windows, from the symbols taken off their ends round by round."""
        n = len(starts)
        u = np.uint64
        f, e = self.run[starts], self.run[starts + WINDOW - 1]
        begin = self.begins[0]
        alone = f == e
        ahead = np.where(alone, WINDOW, begin[f + 1] - starts).astype(u)
        behind = np.where(alone, 0, starts + WINDOW - begin[e]).astype(u)
        la, lb = mix(self.word_a[f], ahead), _second(self.word_b[f], ahead)
        ra, rb = mix(self.word_a[e], behind), _second(self.word_b[e], behind)
        live = np.nonzero(f + 1 < e)[0]
        f, e = f[live] + 1, e[live]
        for r, (a, b, right, to) in enumerate(self.levels):
            if not len(live):
                break
            last = r == len(self.levels) - 1
            while True:
                off = np.ones(len(live), bool) if last else right[f]
                at = live[off]
                la[at], lb[at] = mix(la[at], a[f[off]]), _second(lb[at], b[f[off]])
                f = f + off
                if not last:
                    off = (f < e) & ~right[e - 1]
                    at = live[off]
                    ra[at], rb[at] = mix(ra[at], a[e[off] - 1]), _second(rb[at], b[e[off] - 1])
                    e = e - off
                some = f < e
                live, f, e = live[some], f[some], e[some]
                if not last or not len(live):
                    break
            if not last:
                f, e = to[f], to[e - 1] + 1
        assert len(la) == n
        return mix(la, ra), _second(lb, rb)

    def high(self, rounds: tuple[int, ...] = HIGH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of WINDOW words or more after these rounds, by place: (names a, names b, start, end); each stretch once."""
        parts = []
        for r in rounds:
            a, b, _, _ = self.levels[r]
            s, e = self.begins[r][:-1], self.begins[r][1:]
            m = (a != 0) & (e - s >= WINDOW)
            parts.append((a[m], b[m], s[m], e[m]))
        a, b, s, e = (np.concatenate(x) for x in zip(*parts))
        _, at = np.unique(s.astype(np.int64) << 32 | e, return_index=True)
        return a[at], b[at], s[at], e[at]


def _first_of_each(a: np.ndarray, b: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """Marks, of equal (a, b), the first by ``then`` (by place without it)."""
    order = np.lexsort((*then, b, a))
    head = np.ones(len(order), bool)
    head[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out = np.zeros(len(order), bool)
    out[order[head]] = True
    return out


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _column(t: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in t.column(name).to_pylist()]


def _join(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


class _Piece:
    """A piece's rows in the order of the records."""

    def __init__(self, t: pa.Table):
        order = np.argsort(t.column("ord").to_numpy(), kind="stable")
        self.table = t.take(pa.array(order))
        self.ord = self.table.column("ord").to_numpy()
        self.number = self.table.column("piece")[0].as_py()
        self.texts = self.table.column("t").cast(pa.binary()).to_pylist()

    def ord_at(self, parse: Parse, at: np.ndarray) -> np.ndarray:
        begin = np.cumsum(np.append(0, parse.lengths[:-1] + 1))
        return self.ord[np.searchsorted(begin, at, "right") - 1].astype(np.int64)


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t, copies and ord, by which records are ordered: the key, or its rank where keys are null, repeated or no integers."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    if isinstance(docs.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType)):
        plain = not rows.where(F.col("id").isNull()).limit(1).count() and not rows.groupBy("id").count().where("count > 1").limit(1).count()
        if plain:
            return rows.select("id", "t", F.lit(1).cast("long").alias("copies"), F.col("id").cast("long").alias("ord"))
    # equal rows are one with a count; the text's hash spreads the records of one key
    rows = rows.withColumn("x", F.xxhash64("t")).groupBy("id", "x", "t").agg(F.count("*").alias("copies"))
    by = [F.col("id").isNull(), F.col("id"), F.col("x"), F.col("y")]
    rows = rows.withColumn("y", F.xxhash64(F.lit(1), "t"))
    keys = rows.select("id", "x", "y").distinct()
    ranks = cut(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("ord", F.monotonically_increasing_id()))
    same = rows["id"].eqNullSafe(ranks["id"]) & (rows["x"] == ranks["x"]) & (rows["y"] == ranks["y"])
    return rows.join(ranks, same).select(rows["id"], "t", "copies", "ord")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: int | None = None, buckets: int | None = None, low: int = LOW, high: tuple[int, ...] = HIGH, digests: bool = False) -> DataFrame:
    """One row for each record: id_col, n_words, n_removed, kept (or kept_sha256 with ``digests``).

    A word goes if it is covered by a window of WINDOW words whose sequence also
    starts earlier: in a record of smaller key, or before in the same record;
    kept words are joined by one blank. Null and empty texts have no words.
    Keys may be of any type that has an order. Records of equal key count in
    the order of their texts' hashes, null keys come after all others, repeated
    rows stay repeated (each after the first without its windows), an empty
    table gives an empty result, other columns are ignored. Texts are read
    whole; one record is never cut, so a piece holds at least one whole text.
    """
    size = text_bytes(docs, text_col)
    pieces = pieces or pieces_for(size, PIECE_BYTES)
    buckets = buckets or pieces_for(size, BUCKET_BYTES)
    parts = pieces_for(size, PARTITION_BYTES)
    n_buckets = np.uint64(buckets)
    base = _ordered(docs, id_col, text_col).withColumn("piece", F.pmod(F.xxhash64("ord"), F.lit(pieces)).cast("int")).repartition(parts, "piece")
    sent = "piece int, bucket int, a binary, b binary, o binary, at binary"
    schema = pa.schema([("piece", pa.int32()), ("bucket", pa.int32()), *((x, pa.binary()) for x in ("a", "b", "o", "at"))])

    def packed(rows: list[tuple]) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 6, schema)], schema=schema)

    def symbols_of(t: pa.Table) -> pa.Table:
        """For each bucket: distinct low symbols (at), distinct high ones (a, b) and the record that has each first (o)."""
        piece = _Piece(t)
        parse = Parse(piece.texts, rounds=max(*high, low))
        u = np.unique(parse.levels[low][0])
        u = u[u != 0]
        a, b, s, _ = parse.high(high)
        first = _first_of_each(a, b)
        a, b, o = a[first], b[first], piece.ord_at(parse, s[first])
        rows, of_low, of_high = [], u % n_buckets, a % n_buckets
        for k in np.union1d(of_low, of_high):
            m = of_high == k
            rows.append((piece.number, int(k), a[m].tobytes(), b[m].tobytes(), o[m].tobytes(), u[of_low == k].tobytes()))
        return packed(rows)

    def compared(t: pa.Table) -> pa.Table:
        """For each piece of a bucket: which low symbols other pieces have too (at), which high ones an earlier record has (a)."""
        lows, a, b, o = _column(t, "at", np.uint64), _column(t, "a", np.uint64), _column(t, "b", np.uint64), _column(t, "o", np.int64)
        _, inverse, count = np.unique(_join(lows, np.uint64), return_inverse=True, return_counts=True)
        flags = count[inverse] > 1
        earlier = ~_first_of_each(_join(a, np.uint64), _join(b, np.uint64), _join(o, np.int64))
        x = np.cumsum([0] + [len(v) for v in lows])
        y = np.cumsum([0] + [len(v) for v in a])
        rows = zip(t.column("piece").to_pylist(), t.column("bucket").to_pylist())
        return packed([(p, k, _bits(earlier[y[i] : y[i + 1]]), None, None, _bits(flags[x[i] : x[i + 1]])) for i, (p, k) in enumerate(rows)])

    def windows_of(t: pa.Table, replies: pa.Table) -> pa.Table:
        """A bucket's remaining windows: names (a, b), record (o), place (at). Bucket -1: windows (at) and stretches (a) that go for sure."""
        if not t.num_rows:
            return packed([])
        piece = _Piece(t)
        parse = Parse(piece.texts, rounds=max(*high, low))
        starts = parse.starts()
        if not len(starts):
            return packed([])
        sym = parse.levels[low][0]
        u, inverse, count = np.unique(sym, return_inverse=True, return_counts=True)
        again = count > 1
        ha, hb, hs, he = parse.high(high)
        first = np.nonzero(_first_of_each(ha, hb))[0]
        gone = np.ones(len(ha), bool)
        gone[first] = False
        of_low, of_high = u % n_buckets, ha[first] % n_buckets
        for k, x, y in zip(replies.column("bucket").to_pylist(), replies.column("at").to_pylist(), replies.column("a").to_pylist()):
            where = np.nonzero((u != 0) & (of_low == np.uint64(k)))[0]
            again[where] |= _unbits(x, len(where))
            where = first[of_high == np.uint64(k)]
            gone[where] |= _unbits(y, len(where))
        del sym
        hs, he = hs[gone].astype(np.int64), he[gone].astype(np.int64)
        cover = np.zeros(len(parse.run) + 1, np.int32)
        np.add.at(cover, hs, 1)
        np.add.at(cover, he - WINDOW + 1, -1)
        starts = starts[np.cumsum(cover)[starts] == 0]
        unique_before = np.append(0, np.cumsum(~again[inverse])).astype(np.int32)
        f, e = parse.interior(starts, low)
        starts = starts[unique_before[e] == unique_before[f]]
        a, b = parse.window_names(starts)
        head = _first_of_each(a, b, starts)
        rows = []
        if len(hs) or not head.all():
            rows.append((piece.number, -1, np.stack([hs, he], 1).astype(np.uint32).tobytes(), None, None, starts[~head].astype(np.uint32).tobytes()))
        a, b, starts = a[head], b[head], starts[head]
        o, at, to = piece.ord_at(parse, starts), starts.astype(np.uint32), a % n_buckets
        for k in np.unique(to):
            m = to == k
            rows.append((piece.number, int(k), a[m].tobytes(), b[m].tobytes(), o[m].tobytes(), at[m].tobytes()))
        return packed(rows)

    def later(t: pa.Table) -> pa.Table:
        """For each piece of a bucket the windows (at) that an earlier record has too; what is settled goes through."""
        local = pc.less(t.column("bucket"), 0)
        out = t.filter(local)
        t = t.filter(pc.invert(local))
        a, b, o = (_join(_column(t, c, k), k) for c, k in (("a", np.uint64), ("b", np.uint64), ("o", np.int64)))
        lost = ~_first_of_each(a, b, o)
        rows, x = [], 0
        for p, k, at in zip(t.column("piece").to_pylist(), t.column("bucket").to_pylist(), _column(t, "at", np.uint32)):
            got = at[lost[x : x + len(at)]]
            x += len(at)
            if len(got):
                rows.append((p, k, None, None, None, got.tobytes()))
        return pa.concat_tables([out.select(schema.names).cast(schema), packed(rows)])

    kind = docs.schema[id_col].dataType.simpleString()

    def finish(t: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["id", "copies", "n_words", "n_removed", "kept"]
        if not t.num_rows:
            return pa.table([pa.array([], t.schema.field("id").type), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names)
        piece = _Piece(t)
        words = [x.split() for x in piece.texts]
        piece.texts = []
        cover = np.zeros(sum(map(len, words)) + len(words) + WINDOW + 1, np.int32)
        for at, spans in zip(replies.column("at").to_pylist(), replies.column("a").to_pylist()):
            at = np.frombuffer(at, np.uint32).astype(np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            if spans:
                x = np.frombuffer(spans, np.uint32).reshape(-1, 2).astype(np.int64)
                np.add.at(cover, x[:, 0], 1)
                np.add.at(cover, x[:, 1], -1)
        keep = np.cumsum(cover) == 0
        many, removed, kept, begin = [], [], [], 0
        for w in words:
            k = keep[begin : begin + len(w)]
            n = int(k.sum())
            text = b" ".join(w if n == len(w) else compress(w, k.tolist()))
            many.append(len(w))
            removed.append(len(w) - n)
            kept.append(hashlib.sha256(text).hexdigest() if digests else text.decode("utf-8", "surrogatepass"))
            begin += len(w) + 1
        return pa.table([piece.table.column("id"), piece.table.column("copies"), pa.array(many, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names)

    marks = (
        base.groupBy("piece").applyInArrow(symbols_of, sent).repartition(buckets, "bucket")
        .groupBy("bucket").applyInArrow(compared, sent).repartition(parts, "piece")
    )
    windows = base.groupBy("piece").cogroup(marks.groupBy("piece")).applyInArrow(windows_of, sent)
    # what a piece has settled itself spreads over the buckets
    to = F.when(F.col("bucket") < 0, F.pmod(F.col("piece"), F.lit(buckets))).otherwise(F.col("bucket"))
    lost = (
        windows.withColumn("to", to).repartition(buckets, "to").groupBy("to").applyInArrow(later, sent)
        .repartition(parts, "piece")
    )
    out = base.groupBy("piece").cogroup(lost.groupBy("piece")).applyInArrow(finish, f"id {kind}, copies long, n_words long, n_removed long, kept string")
    # the copies of a row, in two steps so that no array is long
    step = 10_000
    out = out.withColumn("hi", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / step))))
    out = out.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(step - 1).cast("long"), F.col("copies") - 1 - F.col("hi") * step))))
    copy = (F.col("hi") + F.col("lo") > 0) & (F.col("n_words") >= WINDOW)
    nothing = hashlib.sha256(b"").hexdigest() if digests else ""
    return out.select(
        F.col("id").alias(id_col), "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.col("kept")).alias("kept_sha256" if digests else "kept"),
    )
