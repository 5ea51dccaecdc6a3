"""Quality rules: exact base counts and a hashed n-gram likelihood ratio.

Target and raw multinomials over hashed n-grams (words, and pairs of word
shapes) give every bucket a log ratio; a document's score is the mean over its
n-grams, compared with one threshold. Raw counts cover all documents, the
target all rows labelled 1, the threshold all labelled rows. Only DataFrame
functions run: counts are one aggregation to BUCKETS rows, and the ratios come
back to the rows as one literal array of BUCKETS doubles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, words_column

#: Hash buckets of each of the two kinds of n-gram.
BUCKETS = 4096
#: The share of all trusted rows that the threshold must keep.
KEEP_SHARE = 0.995
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WORDS = 5
SYMBOLS = "#*$%&|<>"
NO_WHITE_RE = "[^\\x20\\x09-\\x0D]"


@dataclass(frozen=True)
class QualityModel:
    ratios: tuple[float, ...]
    threshold: float


def _shapes(text: Column) -> Column:
    """The text with runs of letters of one case and of digits cut to one sign; words stay apart as they were."""
    t = F.regexp_replace(text, "\\p{Ll}+", "a")
    t = F.regexp_replace(t, "\\p{Lu}{2,}", "AA")
    return F.regexp_replace(t, "\\p{Nd}+", "0")


def _grams(words: Column, shapes: Column) -> Column:
    """Bucket numbers of all n-grams of a text: words in [0, BUCKETS), shape pairs in [BUCKETS, 2 BUCKETS)."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    two = F.transform(
        shapes, lambda s, i: (F.lit(BUCKETS) + F.pmod(F.xxhash64(s, F.get(shapes, i + 1)), F.lit(BUCKETS))).cast("int")
    )
    return F.concat(one, two)


def _prepared(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*keep, words_column(t).alias("w"), words_column(_shapes(t)).alias("sh"))


def _score(ratios: tuple[float, ...]) -> Column:
    # one literal array, folded when the plan is made
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    one = F.aggregate("w", F.lit(0.0), lambda acc, w: acc + F.get(table, F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))
    sh = F.col("sh")
    two = F.aggregate(
        F.transform(sh, lambda s, i: (F.lit(BUCKETS) + F.pmod(F.xxhash64(s, F.get(sh, i + 1)), F.lit(BUCKETS))).cast("int")),
        F.lit(0.0), lambda acc, g: acc + F.get(table, g),
    )
    return F.when(F.size("w") > 0, (one + two) / (2 * F.size("w"))).otherwise(F.lit(0.0))


def _named(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """k, y: each labelled key once for each of its labels 0 and 1."""
    named = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y"))
    return named.where("k is not null and y in (0, 1)").distinct()


def fit_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[float, ...]:
    """The log ratios of all buckets, target over raw, from all rows; without target n-grams every ratio is 0.

    Nulls, repeated keys and labels, empty tables and other columns as in fit_quality.
    """
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    good = _named(labels, id_col, label_col).where("y = 1").select("k", F.lit(True).alias("good"))
    # by a shuffle at any size: labels grow with the documents
    keyed = rows.where("k is not null").join(good.hint("merge"), "k", "left").select(F.coalesce("good", F.lit(False)).alias("good"), "t")
    # null keys fit no label, and would all meet in one task of the join
    every = keyed.unionByName(rows.where("k is null").select(F.lit(False).alias("good"), "t"))
    grams = _prepared(every, "t", F.col("good")).select("good", F.explode(_grams(F.col("w"), F.col("sh"))).alias("g"))
    raw, target = [1.0] * (2 * BUCKETS), [1.0] * (2 * BUCKETS)
    for x in grams.groupBy("good", "g").count().collect():  # at most 4 x BUCKETS rows
        raw[x["g"]] += x["count"]
        target[x["g"]] += x["count"] * x["good"]
    if max(target) == 1:
        return (0.0,) * (2 * BUCKETS)
    ratios = []
    for half in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        r, t = raw[half], target[half]
        sr, st = sum(r), sum(t)
        ratios += [math.log(x / st) - math.log(y / sr) for x, y in zip(t, r)]
    return tuple(ratios)


def fit_threshold(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> float:
    """Over all labelled rows, the cut with fewest errors among those that keep KEEP_SHARE of the good; of equals the widest gap's middle, then the least.

    ``scored`` has k (the key), s (the score) and ok (whether the row has
    MIN_WORDS words; others don't count). Null keys have no label; a repeated
    row counts as often as it is there, a repeated label once; without good
    rows the threshold is minus infinity. Running sums are taken in the ranges of
    a distributed sort, so no task holds all scores.
    """
    marked = scored.where("ok").join(_named(labels, id_col, label_col), "k")
    cells = marked.groupBy("s").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    # the upper bits of these ids number the sort's ranges
    cells = cut(cells.orderBy("s").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)))
    n_good, n_bad, least = cells.agg(F.sum("good"), F.sum("bad"), F.min("s")).first()
    if not n_good:
        return float("-inf")
    # one row for each range, so few at any size
    parts = cells.groupBy("part").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.min("s").alias("lo"))
    over = Window.orderBy("part")
    until = over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select("part", (F.sum("g").over(until) - F.col("g")).alias("g"), (F.sum("b").over(until) - F.col("b")).alias("b"), F.lead("lo").over(over).alias("next"))
    within = Window.partitionBy("part").orderBy("s")
    until = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = cells.select("part", "s", F.sum("good").over(until).alias("lost"), F.sum("bad").over(until).alias("gone"), F.lead("s").over(within).alias("z"))
    cuts = cuts.join(F.broadcast(parts), "part").select("s", (F.col("lost") + F.col("g")).alias("lost"), (F.col("gone") + F.col("b")).alias("gone"), F.coalesce("z", "next").alias("z"))
    cuts = cuts.where((F.col("lost") <= int((1 - KEEP_SHARE) * n_good)) & F.col("z").isNotNull())
    best = cuts.agg(F.min(F.struct((F.col("lost") + n_bad - F.col("gone")).alias("errors"), (F.col("s") - F.col("z")).alias("gap"), ((F.col("s") + F.col("z")) / 2).alias("at")))).first()[0]
    return min((n_bad, 0.0, least - 1e-9), tuple(best) if best else (n_bad, 0.0, math.inf))[2]


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fits ratios and threshold on all rows; without labelled rows every ratio is 0 and everything is kept.

    The threshold keeps at least KEEP_SHARE of the trusted rows. Null keys,
    labels and texts count in the raw multinomial only (a null text as an empty
    one); each row of a labelled key has its label, a repeated label counts
    once, a row of both labels counts for both; empty tables are those without
    labelled rows; other columns are ignored, whatever their names.
    """
    ratios = fit_ratios(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).where("k is not null")
    scored = _prepared(rows, "t", F.col("k")).select("k", _score(ratios).alias("s"), (F.size("w") >= MIN_WORDS).alias("ok"))
    return QualityModel(ratios, fit_threshold(cut(scored), labels, id_col, label_col))


def base_counts() -> dict[str, Column]:
    """From the columns t, w: the exact counts of the base rules."""
    t, w = F.col("t"), F.col("w")
    n = F.size(w)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NO_WHITE_RE))
    k = REPEAT_WORDS
    hashes = F.col("wh")
    windows = F.when(
        n >= k,
        F.transform(F.slice(hashes, 1, n - (k - 1)), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, k)])),
    )
    return {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "windows": windows,
    }


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(docs: DataFrame, own: Column, ratios: tuple[float, ...], text_col: str) -> DataFrame:
    """own, llr and the exact counts of each record."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(own.alias("own"), t.alias("t"), words_column(t).alias("w"), words_column(_shapes(t)).alias("sh"))
    rows = rows.withColumn("wh", F.transform("w", lambda w: F.xxhash64(w)))
    rows = rows.select("own", _score(ratios).alias("llr"), *[c.alias(n) for n, c in base_counts().items()])
    # windows that occur once need no sorting
    rows = rows.withColumn(
        "pairs", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    p = F.col("pairs")
    again = lambda x, j: F.coalesce(x["h"] == F.get(p, j)["h"], F.lit(False))
    at = F.filter(F.transform(p, lambda x, j: F.when(again(x, j + 1) | again(x, j - 1), x["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("at", F.sort_array(at))
    a = F.col("at")
    gaps = F.transform(a, lambda i, j: F.least(F.lit(REPEAT_WORDS), F.coalesce(F.get(a, j + 1) - i, F.lit(REPEAT_WORDS))))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"))
    return rows.select("own", "llr", *_COUNTS)


def _verdict(rows: DataFrame, threshold: float) -> DataFrame:
    """With base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= F.lit(threshold)))


def quality(
    docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text",
    keep_columns: bool = False,
) -> DataFrame:
    """One row for each record: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    ``base_failed``: fewer than MIN_WORDS words, or over MAX_REPEAT_PERCENT of
    them in repeated windows. ``kept``: not failed, and the mean log ratio is at
    least the threshold. Null and empty texts have no words and fail. Null ids
    stay null, repeated rows stay repeated, an empty table gives an empty
    result; other columns are ignored, or with ``keep_columns`` all columns of
    the input are returned in one struct ``own``, the new ones in one struct ``quality``. Texts
    are read whole; repeated windows are found by sorting, in n log n.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep_columns else F.struct(F.col(id_col))
    rows = _verdict(_measured(docs, own, model.ratios, text_col), model.threshold)
    if keep_columns:
        return rows.select("own", F.struct(*_COUNTS, "base_failed", "llr", "kept").alias("quality"))
    return rows.select(F.col("own").getField(id_col).alias(id_col), *_COUNTS, "base_failed", "llr", "kept")


def fit_and_judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """quality() with the model of fit_quality() on the same records, which are scored once for both.

    What quality() returns, without the texts, is cut before the threshold is
    known. Nulls, repeated keys, empty tables and other columns as in both.
    """
    ratios = fit_ratios(docs, labels, id_col, text_col, label_col)
    rows = cut(_measured(docs, F.struct(F.col(id_col)), ratios, text_col))
    key = F.col("own").getField(id_col)
    scored = rows.select(key.alias("k"), F.col("llr").alias("s"), (F.col("n_words") >= MIN_WORDS).alias("ok"))
    rows = _verdict(rows, fit_threshold(scored, labels, id_col, label_col))
    return rows.select(key.alias(id_col), *_COUNTS, "base_failed", "llr", "kept")


def drop_low_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The records that are kept, with all their columns, whatever these are called; nulls, ties and empty tables as in quality."""
    judged = quality(docs, model, id_col, text_col, keep_columns=True)
    # a filter on computed arrays must not be pushed into their projections, where each would be computed many times
    at = F.monotonically_increasing_id()
    return judged.select("own", F.struct("quality.kept", at.alias("at")).alias("verdict")).where("verdict.kept and verdict.at >= 0").select("own.*")
