"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, then confirmed in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
PREFIX_HEX = 8
#: Rules are broadcast up to so many bytes, else joined by shuffle.
BROADCAST_BYTES = 64 << 20
OTHERWISE = "allow"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, common.UPPER, common.LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def expressions(host: Column, path: Column, most_labels: int, lengths: Column) -> Column:
    """The host's suffixes of up to most_labels labels with the path's prefixes of the given lengths (the rules' own)."""
    labels = F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1
    suffixes = F.transform(F.sequence(F.lit(1), F.least(labels, F.lit(most_labels))), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    cuts = F.filter(lengths, lambda n: n <= F.char_length(path))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))
    )


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """verdict, rule (host and path), its digest and the digest's short prefix."""
    df = spark.createDataFrame(rules, "rule_verdict string, rule_host string, rule_path string")
    df = df.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("rule_digest", F.sha2("rule", 256))
    return df.withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = OTHERWISE) -> DataFrame:
    """pages with host, path, rule and verdict of the longest rule that fits.

    A rule fits its host and all subdomains where the path starts with the rule's. Of rules of one length the one with
    the longer host wins, then block before allow. No rule: rule null, verdict `otherwise`. Null urls and urls with no
    '://' have an empty host and path and fit no rule. Repeated rows stay repeated. A host has as many suffixes as the
    rules' own longest host at most, whatever its length. Rules are broadcast up to BROADCAST_BYTES; more are joined by
    shuffle, where the expressions that many urls have are dealt to many tasks.
    """
    ruled = rules.withColumn("_rank", F.struct(F.char_length("rule"), F.char_length("rule_host"), (F.col("rule_verdict") == "block").cast("int").alias("b"), "rule", "rule_verdict"))
    # Of equal expressions one rule can win; rules that share a short prefix are one row.
    ruled = ruled.groupBy("short", "rule", "rule_digest").agg(F.max("_rank").alias("_rank")).groupBy("short").agg(F.collect_list(F.struct("rule", "rule_digest", "_rank")).alias("_rules"))
    most_labels, held = rules.agg(F.max(F.size(F.split("rule_host", r"\."))), F.sum(F.octet_length("rule") + 400)).first()
    lengths = rules.select(F.sort_array(F.collect_set(F.char_length("rule_path")))).scalar()
    keys = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    once = pages.select(*keys).groupBy(*keys).agg(F.count("*").alias("_times"))
    parted = once.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url))).withColumn("_lengths", lengths)
    expanded = parted.withColumn("_x", F.explode_outer(expressions(F.col("host"), F.col("path"), most_labels or 1, F.col("_lengths")))).drop("_lengths")
    expanded = expanded.withColumn("_digest", F.sha2("_x", 256)).withColumn("_short", F.substring("_digest", 1, PREFIX_HEX))
    if (held or 0) <= BROADCAST_BYTES:
        hit = expanded.join(F.broadcast(ruled), F.col("_short") == F.col("short"), "left")
    else:
        asked = expanded.groupBy("_short").agg(F.count("*").alias("n"))
        hit = common.heavy_join(expanded, common.stored(ruled.withColumnRenamed("short", "_short").join(asked, "_short")), ["_short"], F.col("_digest"))
    confirmed = F.array_max(F.transform(F.filter("_rules", lambda r: (r["rule_digest"] == F.col("_digest")) & (r["rule"] == F.col("_x"))), lambda r: r["_rank"]))
    best = hit.groupBy(*keys).agg(F.first("_times").alias("_times"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(confirmed).alias("_best"))
    out = best.withColumn("rule", F.col("_best.rule")).withColumn("verdict", F.coalesce("_best.rule_verdict", F.lit(otherwise)))
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).drop("_times", "_best", "_i")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(/[^?#]*)', 1) AS path, row_number() OVER () AS i FROM pages),
r(v, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT i, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
      FROM u JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (i)
"""
