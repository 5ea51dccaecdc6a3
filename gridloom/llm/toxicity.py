"""Toxicity by a linear-chain conditional random field over words.

The field has two states for each word. Its features are whole words and their
proper prefixes and suffixes; labelled tokens come from labelled documents:
those of toxic ones that carry a feature which toxic documents have and others
do not. It is fitted on the driver on a bounded sample. Documents are scored in
one pass without a shuffle: forward and backward messages visit the words that
have a feature, and cross the stretches between them by powers of the
transition matrix, so marginals are exact whatever the length of the text.

The fit takes whole texts of the sampled rows, one of those that share label
and sketch (copies), features that enough toxic texts have, and all windows of
words around a feature.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of either class in the fitting sample: those of least key hash, one text for each key.
SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 2000, 3000
#: Toxic texts of the sample that must have a feature: this many, and this share of them.
LEAST, LEAST_SHARE = 4, 0.01
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_WINDOW = 10
_REACH = 64
_FLOOR = 0.05
_CACHED_WORDS = 300_000


def word_features(w: str) -> list[str]:
    n = len(w)
    return [f"={w}", *[f"^{w[:k]}" for k in range(3, min(n, 12))], *[f"{w[-k:]}$" for k in range(3, min(n, 8))]]


class ToxicField:
    """Weights of the field, and of the logistic curve from marginals to a document's score."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, curve: tuple[float, float]):
        self.weights, self.bias, self.curve = weights, bias, curve
        self.trans = np.exp(trans)
        step = self.trans * np.array([1.0, math.exp(bias)])[None, :]
        step = step / np.abs(np.linalg.eigvals(step)).max()
        powers = [np.eye(2)]
        for _ in range(_REACH):
            powers.append(powers[-1] @ step)
        self.powers = [tuple(map(tuple, p.tolist())) for p in powers]
        doubled = [step]
        for _ in range(40):
            doubled.append(doubled[-1] @ doubled[-1])
        self.doubled = doubled
        self.known: dict[str, float | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def power(self, n: int) -> tuple[tuple[float, float], tuple[float, float]]:
        """The transition over n words without a feature."""
        if n <= _REACH:
            return self.powers[n]
        out = np.eye(2)
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = out @ self.doubled[k]
        return tuple(map(tuple, out.tolist()))

    def emission(self, w: str) -> float | None:
        """The toxic state's potential for a word, None without a known feature."""
        got = [self.weights[f] for f in word_features(w) if f in self.weights]
        return self.bias + sum(got) if got else None

    def marginals(self, n: int, hits: list[tuple[int, float]]) -> list[float]:
        """P(toxic) of the words in hits (position, potential), of n words."""
        if not hits:
            return []
        t = self.trans
        fwd = []
        a0, a1 = 1.0, 1.0
        last = -1
        for p, e in hits:
            between = p - last - 1
            if last < 0 and p:  # the first word has no transition into it
                a1 = math.exp(self.bias)
                between -= 1
            (p00, p01), (p10, p11) = self.power(between)
            a0, a1 = a0 * p00 + a1 * p10, a0 * p01 + a1 * p11
            if p:
                a0, a1 = a0 * t[0, 0] + a1 * t[1, 0], a0 * t[0, 1] + a1 * t[1, 1]
            a1 *= math.exp(min(30.0, max(-30.0, e)))
            z = a0 + a1
            a0, a1 = a0 / z, a1 / z
            fwd.append((a0, a1))
            last = p
        out = [0.0] * len(hits)
        b0 = b1 = 1.0
        last = n
        for k in range(len(hits) - 1, -1, -1):
            p, _ = hits[k]
            (p00, p01), (p10, p11) = self.power(last - p - 1)
            if last < n:
                e1 = math.exp(min(30.0, max(-30.0, hits[k + 1][1])))
                c0, c1 = t[0, 0] * b0 + t[0, 1] * e1 * b1, t[1, 0] * b0 + t[1, 1] * e1 * b1
            else:
                c0, c1 = b0, b1
            b0, b1 = p00 * c0 + p01 * c1, p10 * c0 + p11 * c1
            z = b0 + b1
            b0, b1 = b0 / z, b1 / z
            f0, f1 = fwd[k]
            out[k] = f1 * b1 / (f0 * b0 + f1 * b1)
            last = p
        return out

    def tags(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, P(toxic)) of the words that have a feature."""
        low = text.lower()
        words = _WORD.findall(low)
        known = self.known
        if len(known) > _CACHED_WORDS:
            known.clear()
        hits = []
        for w in set(words):
            if w not in known:
                known[w] = self.emission(w)
        if any(known[w] is not None for w in set(words)):
            hits = [(i, known[w]) for i, w in enumerate(words) if known[w] is not None]
        if not hits:
            return []
        p = self.marginals(len(words), hits)
        where = [m.span() for m in _WORD.finditer(low)]
        return [(*where[i], x) for (i, _), x in zip(hits, p)]

    @staticmethod
    def evidence(p: list[float]) -> float:
        """Of a whole text; words below _FLOOR say nothing, or many of them would in long clean texts."""
        return math.log(1e-6 + sum(-math.log1p(-min(x, 1 - 1e-9)) for x in p if x >= _FLOOR))

    def score(self, p: list[float]) -> float:
        a, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * self.evidence(p) + c))))


def fit_toxic(texts: list[str], labels: list[int], negative_weight: float = 1.0, steps: int = 80) -> ToxicField | None:
    """Fits on labelled texts; negative_weight: unlabelled share of class 0 that each of its texts stands for."""
    seqs = [_WORD.findall(t.lower()) for t in texts]
    # copies would make any word of theirs look like evidence: one text for each label and pair of least hashes of three words
    sketch = [(y, *heapq.nsmallest(2, {zlib.crc32(" ".join(s[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(s) - 2))})) for s, y in zip(seqs, labels)]
    first = sorted({x: i for i, x in reversed(list(enumerate(sketch)))}.values())
    seqs, texts, labels = [seqs[i] for i in first], [texts[i] for i in first], [labels[i] for i in first]
    pos, neg = Counter(), Counter()
    n1 = sum(labels)
    if not n1 or n1 == len(labels):
        return None
    least = max(LEAST, math.floor(LEAST_SHARE * n1))
    for s, y in zip(seqs, labels):
        if y:
            pos.update({f for w in set(s) for f in word_features(w)})
    pos = Counter({f: c for f, c in pos.items() if c >= least})
    for s, y in zip(seqs, labels):
        if not y:
            neg.update({f for w in set(s) for f in word_features(w) if f in pos})
    precision = {f: (c - 1) / (c + 1 + negative_weight * neg[f]) for f, c in pos.items()}
    strong = {f for f, x in precision.items() if x >= 0.8}
    used = strong | {f for f, x in precision.items() if x >= 0.5}
    feats: dict[str, int] = {f: i for i, f in enumerate(sorted(used))}
    cache: dict[str, tuple[list[int], bool]] = {}

    def of(w: str) -> tuple[list[int], bool]:
        if w not in cache:
            f = [x for x in word_features(w) if x in feats]
            cache[w] = [feats[x] for x in f], any(x in strong for x in f)
        return cache[w]

    # windows around words with a feature, and the heads of the other texts
    width = 2 * _WINDOW + 1
    rows, cols, tags, weight = [], [], [], []
    n = 0
    for s, y in zip(seqs, labels):
        at = [i for i, w in enumerate(s) if of(w)[0]] or [min(_WINDOW, len(s) // 2)]
        seen = -1
        for i in at:
            if i <= seen:  # inside the window before
                continue
            a = max(0, min(i - _WINDOW, len(s) - width))
            seen = a + width - 1
            # shorter texts are filled up with words without a feature
            part = s[a : a + width] + [""] * max(0, width - len(s))
            for j, w in enumerate(part):
                f, st = of(w)
                rows.extend([n * width + j] * len(f))
                cols.extend(f)
                tags.append(1.0 if y and st else 0.0)
            weight.append(1.0 if y else negative_weight)
            n += 1
    if not n:
        return None
    rows_, cols_ = np.array(rows, np.int64), np.array(cols, np.int64)
    y = np.array(tags).reshape(n, width)
    wt = np.array(weight)[:, None]
    theta, bias, trans = np.zeros(len(feats)), -4.0, np.zeros((2, 2))
    trans[0, 1], trans[1, 0] = -1.0, 0.0
    g2t, g2b, g2r = np.full(len(feats), 1e-4), 1e-4, np.full((2, 2), 1e-4)
    yi = y.astype(int)
    for _ in range(steps):
        em = np.full(n * width, bias)
        np.add.at(em, rows_, theta[cols_])
        em = np.clip(em.reshape(n, width), -25, 25)
        pot = np.stack([np.ones_like(em), np.exp(em)], 2)
        t = np.exp(trans)
        a, b = np.empty((n, width, 2)), np.empty((n, width, 2))
        a[:, 0] = pot[:, 0]
        a[:, 0] /= a[:, 0].sum(1, keepdims=True)
        for j in range(1, width):
            a[:, j] = (a[:, j - 1] @ t) * pot[:, j]
            a[:, j] /= a[:, j].sum(1, keepdims=True)
        b[:, -1] = 0.5
        for j in range(width - 2, -1, -1):
            b[:, j] = (pot[:, j + 1] * b[:, j + 1]) @ t.T
            b[:, j] /= b[:, j].sum(1, keepdims=True)
        m = a * b
        p = m[:, :, 1] / m.sum(2)
        pair = a[:, :-1, :, None] * t[None, None] * (pot * b)[:, 1:, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        d = (y - p) * wt
        gt = np.bincount(cols_, d.ravel()[rows_], len(feats)) - 0.02 * theta
        gr = np.zeros((2, 2))
        for u in range(2):
            for v in range(2):
                gr[u, v] = ((((yi[:, :-1] == u) & (yi[:, 1:] == v)) - pair[:, :, u, v]) * wt).sum() - 0.5 * trans[u, v]
        g2t += gt * gt
        g2b += d.sum() ** 2
        g2r += gr * gr
        theta += 0.6 * gt / np.sqrt(g2t)
        bias += 0.3 * d.sum() / math.sqrt(g2b)
        trans += 0.1 * gr / np.sqrt(g2r)
    field = ToxicField({f: float(theta[i]) for f, i in feats.items() if abs(theta[i]) > 1e-4}, float(bias), trans, (1.0, 0.0))
    x = np.array([field.evidence([q for _, _, q in field.tags(t)]) for t in texts])
    yy, ww = np.array(labels, float), np.where(np.array(labels) == 1, 1.0, negative_weight)
    a, c = 1.0, 0.0
    for _ in range(50):  # Newton's method with a small ridge, the slope kept positive
        q = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
        r, h = ww * (yy - q), ww * q * (1 - q)
        ga, gc = (r * x).sum() - 0.05 * a, r.sum() - 0.05 * c
        haa, hac, hcc = (h * x * x).sum() + 0.05, (h * x).sum(), h.sum() + 0.05
        det = haa * hcc - hac * hac
        da, dc = (hcc * ga - hac * gc) / det, (haa * gc - hac * ga) / det
        size = max(1.0, abs(da), abs(dc))
        a, c = max(0.05, a + da / size), c + dc / size
    field.curve = (float(a), float(c))
    return field


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicField | None:
    """Fits on a bounded sample of the rows that are not held out; None without rows of both classes.

    Rows with null keys, labels or texts are left out; of rows of one key that
    of least text hash counts, a repeated label once; an empty table on either
    side gives None; other columns are ignored, whatever their names.
    """
    named = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where(F.col("k").isNotNull() & ~held_out(F.col("k")))
    total = {r["y"]: r["count"] for r in named.groupBy("y").count().collect() if r["y"] is not None}

    def sample(y: int, n: int) -> DataFrame:
        return named.where(F.col("y") == y).dropDuplicates(["k"]).orderBy(F.xxhash64("k", F.lit("toxic")), "k").limit(n)

    # bounded: at most SAMPLE_POSITIVE + SAMPLE_NEGATIVE ids, and one text for each
    ids = sample(1, SAMPLE_POSITIVE).unionByName(sample(0, SAMPLE_NEGATIVE))
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    got = rows.join(F.broadcast(ids), "k").groupBy("k", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")).collect()
    got.sort(key=lambda r: (r["k"], r["y"]))
    n1, n0 = sum(r["y"] for r in got), sum(1 - r["y"] for r in got)
    if not n1 or not n0:
        return None
    ratio = (total.get(0, n0) / n0) / (total.get(1, n1) / n1)
    return fit_toxic([r["t"] for r in got], [r["y"] for r in got], ratio)


def score_toxicity(docs: DataFrame, field: ToxicField | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each record: id_col, held_out, score, predicted, n_toxic, offsets.

    ``offsets`` lists ``start:end`` of words with a marginal of at least 0.5.
    Null and empty texts get the score of a text without evidence. Without a
    field (no labelled rows of both classes) every score is 0. Null ids stay
    null and are not held out, repeated rows stay repeated, an empty table
    gives an empty result, other columns are ignored, texts are read whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, h, t in zip(pdf["i"], pdf["h"], pdf["t"]):
                tags = field.tags(t) if field is not None and isinstance(t, str) else []
                s = field.score([p for _, _, p in tags]) if field is not None else 0.0
                bad = [(a, b) for a, b, p in tags if p >= 0.5]
                rows.append((i, h, s, int(s >= THRESHOLD), len(bad), ",".join(f"{a}:{b}" for a, b in bad)))
            yield pd.DataFrame(rows, columns=["i", "held_out", "score", "predicted", "n_toxic", "offsets"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("i"), held_out(F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("t"))
    out = rows.mapInPandas(run, "i string, held_out boolean, score double, predicted int, n_toxic long, offsets string")
    return out.select(F.col("i").cast(kind).alias(id_col), *out.columns[1:])
