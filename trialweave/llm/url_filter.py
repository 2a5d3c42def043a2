"""URL filters: host-suffix and path-prefix expressions joined to rules by short hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict) of the registered query.
RULES = (
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

#: Rules up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 100_000


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``.

    A rule (host, path, verdict) fits its host and all subdomains where the url's path
    starts with the rule's.  Each distinct (host, path) is expanded into every host suffix
    at a label boundary times every path prefix of a length that some rule has; these
    expressions meet the rules by equality of a 32-bit hash prefix, and the full SHA-256
    digest then confirms.  The longest rule wins (host and path together, then the longer
    host; of equal rules, ``block``); no rule: ``default`` and a null ``rule``.

    Urls that repeat are expanded once, so a host with a third of all rows costs one row.
    Rules are broadcast only up to ``BROADCAST_RULES`` rows, counted first; the distinct
    lengths of rule paths go to the driver, no more than the longest path has characters.
    A null url, or one without ``://``, has an empty host and path and fits no rule.
    Columns of ``pages`` other than the url pass through; ones named like the four results
    are replaced.  Repeated rows stay; empty tables give empty results.
    """
    kept = [c for c in pages.columns if c not in {"host", "path", "rule", "verdict"} or c == url_col]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col(url_col)).alias("__host"), path_of(F.col(url_col)).alias("__path"))
    listed = rules.filter("host is not null and host != '' and path is not null and verdict is not null")
    lengths = sorted(r[0] for r in listed.select(F.char_length("path")).distinct().collect())
    hashed = listed.select(
        _digest(F.concat("host", F.lit("\n"), "path")).alias("r_digest"), F.concat("host", "path").alias("r_rule"),
        F.char_length("host").alias("r_host"), F.col("verdict").alias("r_verdict")).withColumn("r_short", _short(F.col("r_digest")))
    if listed.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        hashed = F.broadcast(hashed)
    urls = rows.filter("__host != ''").select(F.col("__host").alias("u_host"), F.col("__path").alias("u_path")).distinct()
    labels = F.split("u_host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths] or [F.lit(-1)]), lambda n: (n >= 0) & (n <= F.char_length("u_path")))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(
        prefixes, lambda n: F.concat(h, F.lit("\n"), F.substr(F.col("u_path"), F.lit(1), n)))))
    probes = urls.select("u_host", "u_path", F.explode(expressions).alias("e")).select("u_host", "u_path", _digest(F.col("e")).alias("digest"))
    met = probes.withColumn("short", _short(F.col("digest"))).join(hashed, F.col("short") == F.col("r_short")).filter("digest = r_digest")
    best = met.groupBy("u_host", "u_path").agg(F.max(F.struct(
        F.char_length("r_rule").alias("n"), "r_host", (F.col("r_verdict") == "block").alias("b"),
        F.col("r_rule").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
    out = rows.join(best, (F.col("__host") == F.col("u_host")) & (F.col("__path") == F.col("u_path")), "left")
    return out.select(
        *[F.col(f"`{c}`") for c in kept], F.col("__host").alias("host"), F.col("__path").alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = f"""
WITH r(r_host, r_path, r_verdict) AS (VALUES {_RULE_VALUES}),
s AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
m AS (
  SELECT page_id, host, path, r_host || r_path AS rule, r_verdict AS verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST, length(r_host) DESC, r_verdict DESC) AS k
  FROM u LEFT JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
