"""Personal data: base patterns plus a semi-Markov conditional random field.

The field scores whole candidate segments (shape, digits, Luhn, octets, the
characters and word around them) and a dynamic program over segments of bounded
length chooses boundaries and types together. It is fitted on the driver on a
bounded sample of documents whose base spans serve as labels, plus generated
spellings that the base patterns cannot see. Documents are scored in one pass
without a shuffle; only the neighbourhoods of digits, ``@`` and ``(at)``-like
words are looked at, each stretch of them whole: the program is linear in its
tokens. Entities are bounded: MAX_TOKENS tokens and MAX_DIGITS digits. The fit
sees stretches of about 240 characters of whole texts.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Longest segment in tokens and digits; documents in the fitting sample, and stretches with and without a span.
MAX_TOKENS = 14
MAX_DIGITS = 24
SAMPLE_DOCS = 400
SAMPLE_STRETCHES = 500
#: A span is added if the field prefers it to no entity by this much.
MARGIN = 2.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass their check, by kind and start.

    Each pattern is tried only where it can begin, which gives the matches of a
    plain left-to-right search in time linear in the text.
    """
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        s = at
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", s, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    starts = [m.start() for m in _DIGITS.finditer(text)]
    end = 0
    for s in starts:
        if s >= end and (m := _IP.match(text, s)):
            end = m.end()
            if all(_octet(x) for x in m[0].split(".")):
                out.append(("ip", s, end))
    end = 0
    for s in starts:
        if s >= end and (m := _CARD.match(text, s)):
            end = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", s, end))
    at, end = text.find("+"), 0
    while at >= 0:
        if m := _PHONE.match(text, at):
            end = m.end()
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", at, end))
        at = text.find("+", max(at + 1, end))
    return out


_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_|\s+")
_TRIGGER = re.compile(r"[0-9]{3,}|@|(?<![^\W_])[Aa][Tt](?![^\W_])")
_TRIGGER_OR_DIGITS = re.compile(r"[0-9]+|@|(?<![^\W_])[Aa][Tt](?![^\W_])")
_AT = re.compile(r"[\[({<]\s*at\s*[\])}>]|\sat\s", re.IGNORECASE)


def triggers(text: str) -> list[tuple[int, int]]:
    """Places an entity may hold, by start: 3+ digits, ``@``, (at)-like words, and shorter groups of 7+ digits in all within MAX_TOKENS tokens."""
    out: list[tuple[int, int]] = []
    groups: list[tuple[int, int]] = []  # the last digit groups of one or two
    digits = 0
    for m in _TRIGGER_OR_DIGITS.finditer(text):
        s, e = m.span()
        if m[0].lower() == "at":
            if text[s - 1 : s] in tuple("[({<") or "dot" in text[e : _after(text, e)].lower():
                out.append((s, e))
        elif m[0] == "@":
            out.append((s, e))
        elif e - s > 2:
            out.append((s, e))
            groups, digits = [], 0
        else:
            groups.append((s, e))
            digits += e - s
            while digits - (groups[0][1] - groups[0][0]) >= 7:
                digits -= groups[0][1] - groups[0][0]
                del groups[0]
            if digits >= 7 and sum(1 for _ in islice(_TOKEN.finditer(text, groups[0][0], e), MAX_TOKENS + 1)) <= MAX_TOKENS:
                out.append((groups[0][0], e))
    return sorted(out)


def _after(text: str, e: int) -> int:
    """Where the MAX_TOKENS tokens after position e end."""
    for m in islice(_TOKEN.finditer(text, e), MAX_TOKENS):
        e = m.end()
    return e


def _before(text: str, s: int) -> int:
    """Where the MAX_TOKENS tokens before position s begin."""
    width = 128
    while True:
        a = max(0, s - width)
        starts = [m.start() for m in _TOKEN.finditer(text, a, s)]
        if not a:
            return starts[-MAX_TOKENS] if len(starts) >= MAX_TOKENS else 0
        if len(starts) > MAX_TOKENS:  # the first may be a token's tail
            return starts[-MAX_TOKENS]
        width *= 2


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold an entity: triggers with MAX_TOKENS tokens around them, merged where they meet, of any length.

    No candidate segment reaches out of its stretch, so the best segmentations
    of all stretches are the best one of the text.
    """
    out: list[tuple[int, int]] = []
    at: list[tuple[int, int]] = []
    for s, e in triggers(text):
        if at and (s <= at[-1][1] or sum(1 for _ in islice(_TOKEN.finditer(text, at[-1][1], s), 2 * MAX_TOKENS + 1)) <= 2 * MAX_TOKENS):
            at[-1] = (at[-1][0], max(e, at[-1][1]))
        else:
            at.append((s, e))
    for s, e in at:
        out.append((_before(text, s), _after(text, e)))
    return out


def examples_of(text: str) -> list[tuple[int, int]]:
    """Stretches for the fit: triggers with 48 characters around them, at most about 240 long."""
    out: list[tuple[int, int]] = []
    for s, e in triggers(text):
        a, b = max(0, s - 48), min(len(text), e + 48)
        if out and a <= out[-1][1] and b - out[-1][0] <= 240:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif not out or b > out[-1][1]:
            out.append((max(a, out[-1][1]) if out else a, b))
    return out


def _shape(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"\s+", " ", re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", s))))[:24]


def features(text: str, s: int, e: int) -> list[str]:
    """Of the whole span text[s:e]."""
    x = text[s:e]
    digits = "".join(c for c in x if "0" <= c <= "9")
    n = len(digits)
    parts = x.split(".")
    low = x.lower()
    letters = sum(c.isalpha() for c in x)
    groups = "-".join(str(len(g)) for g in _DIGITS.findall(x))[:20]
    out = [
        "bias", f"shape={_shape(x)}", f"groups={groups}", f"n={n}", f"len={min(len(x) // 4, 12)}", f"letters={min(letters, 3)}",
        f"first={_shape(x[:1])}", f"last={_shape(x[-1:])}", f"before={_shape(text[s - 1 : s])}", f"after={_shape(text[e : e + 1])}",
        f"plus={x[0] == '+'}", f"luhn={13 <= n <= 19 and not letters and luhn(digits)}",
        f"quad={len(g := _DIGITS.findall(x)) == 4 and not letters and all(map(_octet, g))}",
        f"octets={len(parts) == 4 and all(p.isascii() and p.isdigit() and _octet(p) for p in parts)}",
        f"at={'@' in x}", f"word_at={bool(_AT.search(low))}", f"dot={' dot ' in low or '[dot]' in low or '(dot)' in low}",
    ]
    return out


class Field:
    """Weights by (kind, feature); the kind ``none`` of one token has weight 0."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w = weights or {}
        self.cache: dict[tuple[str, ...], tuple[float, ...]] = {}

    def scores(self, f: list[str]) -> tuple[float, ...]:
        w = self.w
        return tuple(sum(w.get(f"{k}|{x}", 0.0) for x in f) for k in KINDS)

    @staticmethod
    def tokens(text: str, a: int, b: int) -> list[tuple[int, int]]:
        return [(a + m.start(), a + m.end()) for m in _TOKEN.finditer(text[a:b])]

    @staticmethod
    def segments(text: str, toks: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Candidate segments [i, j) of tokens: bounded length, no white space at the ends, a trigger inside."""
        out = []
        good = [not text[a].isspace() for a, _ in toks]
        trig = [bool(_TRIGGER.search(text[a:b])) for a, b in toks]
        edge = [good[i] and (text[a].isalnum() or text[a] in "+(") for i, (a, _) in enumerate(toks)]
        for i in range(len(toks)):
            if not edge[i] or (i and toks[i - 1][1] == toks[i][0] and text[toks[i - 1][0]].isalnum()):
                continue
            seen = digits = 0
            for j in range(i + 1, min(len(toks), i + MAX_TOKENS) + 1):
                a, b = toks[j - 1]
                seen += trig[j - 1]
                digits += sum("0" <= c <= "9" for c in text[a:b])
                if digits > MAX_DIGITS:
                    break
                if (seen or digits >= 7) and text[a].isalnum():
                    out.append((i, j))
        return out

    def best(self, text: str, a: int, b: int) -> list[tuple[str, int, int]]:
        """The best segmentation of text[a:b]."""
        toks = self.tokens(text, a, b)
        by_end: dict[int, list[tuple[int, float, str]]] = {}
        for i, j in self.segments(text, toks):
            s = self.scores(features(text, toks[i][0], toks[j - 1][1]))
            k = max(range(len(KINDS)), key=s.__getitem__)
            if s[k] > MARGIN:
                by_end.setdefault(j, []).append((i, s[k] - MARGIN, KINDS[k]))
        if not by_end:
            return []
        top, back = [0.0], [None]
        for j in range(1, len(toks) + 1):
            v, p = top[j - 1], None
            for i, s, k in by_end.get(j, ()):
                if top[i] + s > v:
                    v, p = top[i] + s, (i, k)
            top.append(v)
            back.append(p)
        out, j = [], len(toks)
        while j:
            if back[j]:
                i, k = back[j]
                out.append((k, toks[i][0], toks[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        return [x for a, b in regions(text) for x in self.best(text, a, b)]

    def fit(self, examples: list[tuple[str, int, int, list[tuple[str, int, int]]]], epochs: int = 20, rate: float = 0.3, l2: float = 1e-3) -> Field:
        """Maximum conditional likelihood by forward-backward over segmentations. examples: (text, region start, end, spans)."""
        names: dict[str, int] = {}
        data = []
        for text, a, b, gold in examples:
            toks = self.tokens(text, a, b)
            segs = self.segments(text, toks)
            if not segs:
                continue
            ids = np.array([[names.setdefault(x, len(names)) for x in features(text, toks[i][0], toks[j - 1][1])] for i, j in segs])
            at = {(toks[i][0], toks[j - 1][1]): n for n, (i, j) in enumerate(segs)}
            want = [(at[(s, e)], KINDS.index(k)) for k, s, e in gold if (s, e) in at]
            if gold and len(want) < len(gold):
                continue  # a gold span that no segment can express, such as one that shares its digits
            data.append((len(toks), np.array(segs), ids, want))
        w = np.zeros((len(KINDS), len(names)))
        g2 = np.full_like(w, 1e-6)
        for _ in range(epochs):
            for n, segs, ids, want in data:
                s = w[:, ids].sum(2)  # kinds x segments
                m = np.exp(np.clip(s, -30, 30))
                tot = m.sum(0)
                alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
                alpha[0] = beta[n] = 1.0
                ends = {}
                heads = {}
                for x, (i, j) in enumerate(segs):
                    ends.setdefault(int(j), []).append(x)
                    heads.setdefault(int(i), []).append(x)
                for j in range(1, n + 1):
                    alpha[j] = alpha[j - 1] + sum(alpha[segs[x][0]] * tot[x] for x in ends.get(j, ()))
                for i in range(n - 1, -1, -1):
                    beta[i] = beta[i + 1] + sum(beta[segs[x][1]] * tot[x] for x in heads.get(i, ()))
                p = m * (alpha[segs[:, 0]] * beta[segs[:, 1]] / alpha[n])[None, :]
                diff = -p
                for x, k in want:
                    diff[k, x] += 1
                g = np.zeros_like(w)
                for k in range(len(KINDS)):
                    np.add.at(g[k], ids.ravel(), np.repeat(diff[k], ids.shape[1]))
                g -= l2 * w
                g2 += g * g
                w += rate * g / np.sqrt(g2)
        self.w = {f"{k}|{x}": float(w[i, n]) for x, n in names.items() for i, k in enumerate(KINDS) if abs(w[i, n]) > 1e-3}
        return self


def _generated(rng: random.Random, words: list[str]) -> list[tuple[str, int, int, list[tuple[str, int, int]]]]:
    """Spellings without a base pattern, and look-alikes that are nothing."""
    out = []
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))

    def card(sep: str) -> str:
        x = d(15)
        x = next(x + c for c in "0123456789" if luhn(x + c))
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    quad = lambda sep: sep.join(str(rng.randrange(256)) for _ in range(3)) + sep + str(rng.randrange(100, 256))
    for _ in range(40):
        for kind, x in (
            ("card", card(".")), ("card", card("/")), ("card", card(" - ")), ("ip", quad("[.]")), ("ip", quad(" . ")), ("ip", quad("(.)")),
            (None, ".".join(d(4) for _ in range(3))), (None, "/".join((d(2), d(2), d(4)))),
            ("phone", f"({d(3)}) {d(3)}-{d(4)}"), ("phone", f"{d(3)}-{d(3)}-{d(4)}"), ("email", f"{name()} [at] {name()}.com"),
            ("email", f"{name()} (at) {name()} (dot) org"), ("email", f"{name()} at {name()} dot com"),
            (None, d(rng.randint(5, 16))), (None, f"{d(4)}-{d(2)}-{d(2)}"), (None, f"{d(3)}.{d(2)}"), (None, f"{name()} @ {name()}"), (None, d(16)),
        ):
            if kind is None and 13 <= len(x) <= 19 and x.isdigit() and luhn(x):
                continue
            left = " ".join(rng.choice(words) for _ in range(4)) + " "
            text = left + x + " " + " ".join(rng.choice(words) for _ in range(4))
            out.append((text, 0, len(text), [(kind, len(left), len(left) + len(x))] if kind else []))
    for _ in range(40):  # groups of two digits
        sep = rng.choice(" .-")
        for kind, x in (("phone", sep.join(d(2) for _ in range(5))), (None, f"{d(2)}.{d(2)}.{d(4)}"), (None, f"{d(2)}:{d(2)}:{d(2)}"), (None, ", ".join(d(rng.randint(1, 2)) for _ in range(6)))):
            left = " ".join(rng.choice(words) for _ in range(4)) + " "
            text = left + x + " " + " ".join(rng.choice(words) for _ in range(4))
            out.append((text, 0, len(text), [(kind, len(left), len(left) + len(x))] if kind else []))
    return out


def fit_field(texts: list[str], seed: int = 7, most: int = SAMPLE_STRETCHES) -> Field:
    """Fits on stretches of the given texts (base spans as labels), up to ``most`` with and without a span drawn of all, and on generated spellings of every kind."""
    rng = random.Random(seed)
    examples, words = [], ["the", "of", "and"]
    for t in texts:
        spans = base_spans(t)
        words.extend(w for w in t.split() if w.isalpha())
        for a, b in examples_of(t):
            inside = [(k, s, e) for k, s, e in spans if a <= s and e <= b]
            if any(s < b and e > a and not (a <= s and e <= b) for _, s, e in spans):
                continue
            inside.sort(key=lambda x: (x[1], -x[2]))
            flat: list[tuple[str, int, int]] = []
            for x in inside:  # an ip's digits may also look like part of a phone: the longer one counts
                if not flat or x[1] >= flat[-1][2]:
                    flat.append(x)
            examples.append((t, a, b, flat))
    rng.shuffle(examples)
    with_, without = [x for x in examples if x[3]], [x for x in examples if not x[3]]
    return Field().fit(with_[:most] + without[:most] + _generated(rng, words))


def sample_texts(docs: DataFrame, id_col: str, text_col: str, n: int = SAMPLE_DOCS) -> list[str]:
    """Up to n whole texts with a digit or an ``@``: those of the least key hashes.

    Rows with null keys or texts are left out, rows of equal key compete by
    their texts' order, an empty table gives no texts, other columns are
    ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).where("k is not null and t rlike '[0-9@]'")
    rows = rows.withColumn("h", F.xxhash64("k", F.lit("pii")))
    # hashes alone compete, so a task sends n small rows; the texts follow for the n chosen
    ids = rows.select("h", "k").orderBy("h", "k").limit(n).distinct()
    return [r["t"] for r in rows.join(F.broadcast(ids), ["h", "k"]).orderBy("h", "t").limit(n).collect()]


def all_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base and added spans); an added one never meets a base one."""
    base = base_spans(text)
    added = []
    if field is not None and (found := field.spans(text)):
        taken: list[list[int]] = []  # base spans, merged where they meet
        for s, e in sorted((s, e) for _, s, e in base):
            if taken and s <= taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], e)
            else:
                taken.append([s, e])
        starts = [s for s, _ in taken]
        for k, s, e in found:
            i = bisect_left(starts, e) - 1
            if i < 0 or taken[i][1] <= s:
                added.append((k, s, e))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(set(base) | set(added), key=lambda x: (order[x[0]], x[1], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping ones the first counts, the others go with it."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row for each record: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added, redacted.

    Null and empty texts have no spans (and an empty redacted text). Null ids
    stay null, repeated rows stay repeated, an empty table gives an empty
    result, other columns are ignored, texts are searched whole. Without a
    ``field`` one is fitted on a bounded sample of the documents.
    """
    if field is None:
        field = fit_field(sample_texts(docs, id_col, text_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["i"], pdf["t"]):
                t = t if isinstance(t, str) else ""
                base, spans = all_spans(t, field)
                n = [sum(k == x for x, _, _ in base) for k in KINDS]
                rows.append((i, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans), len(spans) - len(set(base)), redacted(t, spans)))
            yield pd.DataFrame(rows, columns=["i", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_added", "redacted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    out = rows.mapInPandas(run, "i string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long, redacted string")
    return out.select(F.col("i").cast(kind).alias(id_col), *out.columns[1:])


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", field: Field | None = None) -> DataFrame:
    """All records and columns, personal data in the text replaced, and the length column, if there is one, counted anew.

    Null texts stay null and keep their length, empty ones stay empty; null and
    repeated keys and repeated rows stay as they are, other columns pass
    whatever their names, an empty table gives an empty result. Without a
    ``field`` one is fitted on a bounded sample, as in find_pii.
    """
    if field is None:
        field = fit_field(sample_texts(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, all_spans(t, field)[1]) for t in batch.column(text_col).to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns[text_col] = pa.array(texts, batch.schema.field(text_col).type)
            if length_col in columns:
                was = columns[length_col].to_pylist()
                columns[length_col] = pa.array([n if t is None else len(t) for t, n in zip(texts, was)], batch.schema.field(length_col).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
