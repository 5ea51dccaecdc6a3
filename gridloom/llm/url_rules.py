"""URL filters: host-suffix and path-prefix expressions against a rule list.

Each distinct (host, path) is expanded into the expressions that any rule could
have (only those label counts and path lengths that occur among the rules), the
expressions are equi-joined with the rules on a short prefix of their SHA-256,
full digests are confirmed, and the longest rule wins. Only DataFrame functions
run; the rule side is broadcast by Spark only under its size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Hex digits of the digest that the join uses (32 bits).
PREFIX_DIGITS = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(raw), path


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules: (verdict, host, path)."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _expression(host: Column, path: Column) -> Column:
    # a host has no blank in it before the path begins, so the pair is kept apart
    return F.concat(host, F.lit("\x00"), path)


def match_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of ``pages``: id_col, host, path, rule, verdict.

    A rule fits its host and all subdomains if the url's path starts with the
    rule's path. The longest fitting rule (host and path together, then the
    longer host, then a block) wins; without one the rule is null and the
    verdict is ``default``. Null urls, urls without ``://`` and empty ones have
    an empty host and path. Repeated rows stay repeated; an empty table gives an
    empty result; other columns of ``pages`` are ignored.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))

    known = rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull()).select(
        ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    )
    shapes = sorted(
        (r[0], r[1])
        for r in known.select(F.size(F.split("r_host", "\\.")).alias("n"), F.length("r_path").alias("m")).distinct().collect()
    )
    known = known.withColumn("r_digest", F.sha2(_expression(F.col("r_host"), F.col("r_path")), 256)).groupBy("r_digest").agg(
        F.max(F.struct((F.col("r_verdict") == "block").alias("b"), "r_host", "r_path", "r_verdict")).alias("r")
    ).select("r_digest", "r.r_host", "r.r_path", "r.r_verdict", F.substring("r_digest", 1, PREFIX_DIGITS).alias("short"))

    labels = F.split("host", "\\.")
    n, m = F.size(labels), F.length("path")
    kinds = [
        F.when((n >= a) & (m >= b), _expression(F.array_join(F.slice(labels, n - a + 1, F.lit(a)), "."), F.col("path").substr(1, b)))
        for a, b in shapes
    ]
    if not kinds:
        return rows.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    distinct = rows.select("host", "path").distinct()
    expanded = (
        distinct.withColumn("e", F.explode(F.array_compact(F.array(*kinds))))
        .withColumn("digest", F.sha2("e", 256))
        .select("host", "path", "digest", F.substring("digest", 1, PREFIX_DIGITS).alias("short"))
    )
    best = (
        expanded.join(known, "short")
        .where(F.col("digest") == F.col("r_digest"))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    (F.length("r_host") + F.length("r_path")).alias("n"),
                    F.length("r_host").alias("h"),
                    (F.col("r_verdict") == "block").alias("b"),
                    F.concat("r_host", "r_path").alias("rule"),
                    F.col("r_verdict").alias("verdict"),
                )
            ).alias("best")
        )
    )
    return rows.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
