"""Secret scans: base patterns plus corpus-wide ownership of candidates.

One pass over the texts finds the base spans and further candidates (provider
formats and mixed random-looking tokens of 20 characters or more, taken whole). Each candidate's hash is counted over
the whole corpus by distinct repository and owner: one that many owners share
is a copied example, one that stays with few owners and looks random is a live
credential, and such candidates are added to the spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("assign", "access", "hex")
#: A candidate in more owners or repositories than this is a copied example.
MOST_OWNERS = 2
MOST_REPOSITORIES = 3
#: Bits a character that a random-looking token has at least.
LEAST_ENTROPY = 3.2

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MORE = (
    ("key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    ("provider", re.compile(r"(?:gh[pousr]_|github_pat_|glpat-|sk_live_|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}")),
    ("bearer", re.compile(r"(?<=[Bb]earer )[A-Za-z0-9._~+/=-]{16,}")),
)
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass their length check, by start, then kind."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if b"pass" in low or b"secret" in low or b"token" in low or b"api" in low:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def entropy(x: str) -> float:
    return -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values()) if x else 0.0


def _random_looking(x: str) -> bool:
    """Of a whole token: a digit, a letter and enough entropy, wherever they are in it."""
    return any("0" <= c <= "9" for c in x) and any("a" <= c <= "z" or "A" <= c <= "Z" for c in x) and entropy(x) >= LEAST_ENTROPY


def value_of(kind: str, x: str) -> str:
    """What identifies a candidate: an assignment's value, else the whole match."""
    m = _ASSIGN.match(x) if kind == "assign" else None
    return m[2] if m else x


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further spans that may be secrets; none meets a base span or an earlier candidate. Linear in the text."""
    out = []
    found = [(k, m) for k, p in _MORE for m in p.finditer(text)]
    if any(c in text for c in "0123456789"):
        found += [("mixed", m) for m in _MIXED.finditer(text) if _random_looking(m[0])]
    if not found:
        return out
    taken = bytearray(len(text))
    for _, s, e in base:
        taken[s:e] = b"\1" * (e - s)
    for k, m in found:
        s, e = m.span()
        if taken.find(1, s, e) < 0:
            taken[s:e] = b"\1" * (e - s)
            out.append((k, s, e))
    return out


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_cols: tuple[str, ...] = ("source",), owner_col: str | None = None,
    most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES,
) -> DataFrame:
    """One row for each record: id_col, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_live, n_example.

    ``spans`` holds the base spans and the candidates judged live, as
    ``kind:start:end`` by start. ``n_live`` and ``n_example`` count all spans,
    base ones too, by ownership: a candidate in more than ``most_owners`` owners
    or more than ``most_repositories`` repositories is an example. A repository
    is an owner's, named by ``repository_cols`` together; without ``owner_col``
    it is its own owner. Nulls in these columns count as one name. Null and
    empty texts have no spans. Null ids stay null, repeated rows stay repeated, an empty table gives
    an empty result, other columns are ignored. Ownership is counted over all
    rows; hashes are made distinct by owner before they are shuffled together,
    so a credential in a third of all rows costs one row for each owner and task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t, r, o in zip(pdf["i"], pdf["t"], pdf["r"], pdf["o"]):
                t = t if isinstance(t, str) else ""
                base = base_spans(t)
                n = [sum(k == x for x, _, _ in base) for k in KINDS]
                digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
                found = [(k, s, e, True) for k, s, e in base] + [(k, s, e, False) for k, s, e in candidates(t, base)]
                got = [
                    {"k": k, "s": s, "e": e, "base": b, "h": hashlib.sha256(value_of(k, t[s:e]).encode("utf-8", "surrogatepass")).hexdigest()[:32]}
                    for k, s, e, b in found
                ]
                rows.append((i, *n, digest, got, r, o))
            yield pd.DataFrame(rows, columns=["i", "n_assign", "n_access", "n_hex", "base_sha256", "found", "r", "o"])

    kind = docs.schema[id_col].dataType.simpleString()
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    repository = F.concat_ws("\1", *[name(c) for c in repository_cols])
    owner = name(owner_col) if owner_col else repository
    found = docs.select(
        F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"), F.concat_ws("\2", owner, repository).alias("r"), owner.alias("o")
    ).mapInPandas(
        run,
        "i string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<k:string,s:int,e:int,base:boolean,h:string>>, r string, o string",
    )
    # spans and hashes only: written once to the shared folder, read by the counts and by the result
    found = cut(found).withColumn("row", F.monotonically_increasing_id())
    each = found.where(F.size("found") > 0).select("row", "r", "o", F.explode("found").alias("f"))
    owners = (
        each.select(F.col("f.h").alias("h"), "r", "o").distinct().groupBy("h")
        .agg(F.count_distinct("o").alias("owners"), F.count_distinct("r").alias("repositories"))
    )
    judged = (
        each.select("row", "f.*").join(owners, "h", "left")
        .withColumn("live", (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories))
        .groupBy("row")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("base") | F.col("live"), F.struct("s", F.when(F.col("base"), 0).otherwise(1).alias("b"), "e", "k")))).alias("all"),
            F.sum((F.col("live") & ~F.col("base")).cast("long")).alias("n_added"),
            F.sum(F.col("live").cast("long")).alias("n_live"),
            F.sum((~F.col("live")).cast("long")).alias("n_example"),
        )
    )
    order = F.create_map(*[x for n, k in enumerate(KINDS) for x in (F.lit(k), F.lit(n))])
    spans = F.transform(
        F.array_sort(F.transform("all", lambda x: F.struct(x["s"].alias("s"), F.coalesce(order[x["k"]], F.lit(9)).alias("o"), x["e"].alias("e"), x["k"].alias("k")))),
        lambda x: F.concat_ws(":", x["k"], x["s"], x["e"]),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.join(judged, "row", "left").select(
        F.col("i").cast(kind).alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(spans, ","), F.lit("")).alias("spans"), zero("n_added"), zero("n_live"), zero("n_example"),
    )
