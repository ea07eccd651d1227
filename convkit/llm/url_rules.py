"""URL allow and block rules by hash-prefix lookup, native.

A URL is expanded into (host suffix, path prefix) expressions: every suffix
of the host at a dot, times every prefix of the path that ends in a slash.
Expressions and rules meet in an equi-join on the first four bytes of their
SHA-256 digests; then the full digests are compared and, where a rule's path
goes on after its last slash, the rest of it. Of the rules that fit, the
longest wins.

Only expressions as deep as the deepest rule are made (no deeper one can
fit), so a host of many labels or a path of many slashes stays small. The
rules' depths are read from the rules, in one row.

Defined results: null urls and urls without "://" have an empty host and an
empty path, fit no rule and get the default verdict; an empty path starts
with no rule path; repeated pages each get a row; of equal rules that
disagree, block wins; an empty page table gives no rows and without rules
every page gets the default; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 8          # hex digits of the short hash


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where there are none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with rule, digest, depths and the rest of
    the path after its last slash; one row per host and path. A rule's path
    starts with a slash, as every path of a URL does."""
    r = rules.where("host is not null and path like '/%'").select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    r = r.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))     # block > allow
    folder = F.regexp_extract("rule_path", r"(?s)^(.*/)", 1)
    return r.select(
        "rule_path", "rule_verdict", F.concat("rule_host", "rule_path").alias("rule"),
        _digest(F.col("rule_host"), folder).alias("rule_digest"),
        F.size(F.split("rule_host", r"\.")).alias("labels"),
        F.length(F.regexp_replace(folder, r"[^/]", "")).alias("slashes"))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule (null if none fits) and verdict of every page."""
    r = prepared_rules(rules).withColumn("short", F.substring("rule_digest", 1, PREFIX))
    depth = r.agg(F.coalesce(F.max("labels"), F.lit(0)), F.coalesce(F.max("slashes"), F.lit(0))).first()    # one row
    host, path = url_parts(F.col(url))
    # pages with equal host and path are judged once: a third of all pages may be the same
    parts = pages.select(host.alias("host"), path.alias("path")).where("path like '/%'").distinct()
    n_labels = F.least(F.size(F.split("host", r"\.")), F.lit(depth[0]))
    n_slashes = F.least(F.length(F.regexp_replace("path", "[^/]", "")), F.lit(depth[1]))
    wide = parts.select("host", "path", n_labels.alias("l"), n_slashes.alias("s")).where("l > 0 and s > 0")
    e = (wide.select("host", "path", "s", F.explode(F.sequence(F.lit(1), "l")).alias("l"))
             .select("host", "path", "l", F.explode(F.sequence(F.lit(1), "s")).alias("s")))
    suffix, prefix = F.expr("substring_index(host, '.', int(-l))"), F.expr("concat(substring_index(path, '/', int(s)), '/')")
    e = e.select("host", "path", _digest(suffix, prefix).alias("digest"))
    e = e.withColumn("short", F.substring("digest", 1, PREFIX))
    hit = e.join(r, "short").where((F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path")))
    best = hit.groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.length("rule_path"), "rule")).alias("best"))
    named = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    return named.join(best, ["host", "path"], "left").select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
