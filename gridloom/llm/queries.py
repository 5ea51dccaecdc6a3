"""The opN queries over the whole tables, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, jaccard, pii, quality, secrets_scan, shards, substrings, toxicity, url_rules
from .common import read

#: The rules of op3 (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules.rules_frame(spark, URL_RULES)
    return url_rules.match_urls(read(spark, sf_dir, "pages"), rules)


OP3_SQL = """
WITH r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
a AS (SELECT page_id, row_number() OVER () AS i,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, i, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
m AS (SELECT c.i, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM c JOIN r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path) GROUP BY c.i)
SELECT c.page_id, c.host, c.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM c LEFT JOIN m USING (i)
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(read(spark, sf_dir, "documents"))


#: The checksum's table comes from its rule, as list x of 256 numbers.
OP10_SQL = """
WITH x AS (SELECT list(v ORDER BY i) AS x FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(text, '') AS t, doc_id::VARCHAR AS k FROM documents),
s AS (SELECT doc_id, t, strlen(t)::BIGINT + 1 AS size, k, list_transform(range(9), lambda i: ('0x' || substr(md5(k || ':' || i), 1, 13))::BIGINT) AS u FROM d),
c AS (SELECT doc_id, size, k, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(t), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda a, b: xor(a >> 8, x.x[(xor(a, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32, list_position(u, list_max(u[1:8])) - 1 AS shard, list_position(u, list_max(u)) - 1 AS grown_shard FROM s, x)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k || ':slot'), 1, 13))::BIGINT % 4096, text_crc32 % 16, doc_id, text_crc32, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard FROM c
"""


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, digests=True)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents")).drop("redacted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), null_items=True)
    return out.drop("items")


OP5_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT d.*, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An owner is a source, its repositories are the source's languages."""
    return secrets_scan.scan_secrets(read(spark, sf_dir, "documents"), repository_cols=("source", "lang"), owner_col="source")


_LETTERS = {w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api", "key")}
_ASSIGN = "({password}|{passwd}|{secret}|{token}|{api}_?{key})".format(**_LETTERS) + """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, its place in the order, its pattern, and characters of context that stand for it: base kinds, then further candidates.
_SECRETS = [
    ("assign", 0, _ASSIGN, 0), ("access", 1, "AKIA[A-Z0-9]+", 0), ("hex", 2, "[0-9a-f]{24,}", 0), ("key", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    ("provider", 4, "(?:gh[pousr]_|github_pat_|glpat-|sk_live_|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}", 0), ("bearer", 5, "[Bb]earer ", 7),
    ("mixed", 6, "[A-Za-z0-9+/_=-]{20,}", 0),
]
#: Places from what is between the matches; each further kind where no span before it is; then owners of each value.
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS owner, coalesce(lang, chr(0)) AS lang FROM documents),
x AS ({" UNION ALL ".join(f"SELECT r, '{k}' AS kind, {o} AS o, {c} AS c, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS ps FROM d" for k, o, p, c in _SECRETS)}),
y AS (SELECT r, kind, o, c, ms, ps, unnest(generate_series(1, len(ms))) AS i FROM x WHERE len(ms) > 0),
z AS (SELECT r, kind, o, CASE WHEN c > 0 THEN regexp_extract(ps[i + 1] || coalesce(rtrim(ms[i + 1]), ''), '^[A-Za-z0-9._~+/=-]{{16,}}') ELSE ms[i] END AS m, list_sum(list_transform(ps[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda v: length(v))), 0) + c AS s FROM y),
f AS (SELECT r, kind, o, s::BIGINT AS s, (s + length(m))::BIGINT AS e, CASE WHEN o = 0 THEN regexp_extract(m, '{_ASSIGN}', 2) ELSE m END AS v FROM z
  WHERE CASE o WHEN 0 THEN length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6 WHEN 1 THEN length(m) >= 20 WHEN 5 THEN m <> ''
    WHEN 6 THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND
      list_sum(list_transform(map_values(list_aggregate(string_split(m, ''), 'histogram')), lambda n: -(n::DOUBLE / length(m)) * log2(n::DOUBLE / length(m)))) >= {secrets_scan.LEAST_ENTROPY} ELSE true END),
f3 AS (SELECT * FROM f WHERE o < 3),
""" + "".join(
    f"f{o + 1} AS (SELECT * FROM f{o} UNION ALL SELECT * FROM f a WHERE o = {o} AND NOT EXISTS (SELECT 1 FROM f{o} b WHERE b.r = a.r AND b.s < a.e AND a.s < b.e)),\n" for o in range(3, 7)
) + f"""w AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, lang)) AS repositories FROM f7 JOIN d USING (r) GROUP BY v),
j AS (SELECT r, kind, o < 3 AS base, s, e, kind || ':' || s || ':' || e AS name, owners <= {secrets_scan.MOST_OWNERS} AND repositories <= {secrets_scan.MOST_REPOSITORIES} AS live, o FROM f7 JOIN w USING (v)),
g AS (SELECT r, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex,
    string_agg(name, ',' ORDER BY s, o) FILTER (WHERE base) AS bases, string_agg(name, ',' ORDER BY s, least(o, 3), e, kind) FILTER (WHERE base OR live) AS spans,
    count(*) FILTER (WHERE live AND NOT base) AS n_added, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(bases, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_added, 0) AS n_added, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN g USING (r)
"""


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(read(spark, sf_dir, "documents"), n=3, percent=90)


#: All pairs that share a shingle, then the closure of the links.
OP7_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v),
m AS (SELECT v, min(c) AS component_id FROM r GROUP BY v),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.v = d.doc_id LEFT JOIN l ON l.a = d.doc_id
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fit_and_judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_on_sample(docs, read(spark, sf_dir, "labels")))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(read(spark, sf_dir, "documents"), digests=True)


OP1_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM r),
t AS (SELECT d.doc_id, p, w[p] AS x, c.p IS NOT NULL AS gone FROM (SELECT *, unnest(generate_series(1, len(w))) AS p FROM d) d LEFT JOIN c USING (doc_id, p)),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM t GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


QUERIES = {"op7_jaccard_join": op7_jaccard_join, "op1_substring_dedup": op1_substring_dedup, "op9_toxicity": op9_toxicity, "op8_quality_rules": op8_quality_rules, "op4_pii": op4_pii, "op5_decontamination": op5_decontamination, "op6_secret_scan": op6_secret_scan, "op2_byte_bpe": op2_byte_bpe, "op3_url_filters": op3_url_filters, "op10_sharding": op10_sharding}
ORACLE_SQL = {"op6_secret_scan": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op10_sharding": OP10_SQL, "op1_substring_dedup": OP1_SQL, "op3_url_filters": OP3_SQL, "op5_decontamination": OP5_SQL}
