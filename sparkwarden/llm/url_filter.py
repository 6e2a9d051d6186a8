"""URL rules by hashed expressions.

A rule names a host with its subdomains and a prefix of the path. Each URL gives every suffix of its host (by
labels, as many as a rule's host has at most) joined to its path's prefixes of the lengths that the suffix's rules have;
expressions meet rules in an equi-join on the first PREFIX bytes of their SHA-256, then the full digests are
compared. Of the rules that fit, the longest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.session import durable, many_to_one

#: Bytes of a digest that the join is on, and rules (of some 200 bytes) up to which they are broadcast.
PREFIX, FEW = 4, 20_000
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as plain text says: what follows the first ``://``; both empty without one."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _AZ, _AZ.lower())
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(rule_host, rule_path, verdict). A path begins with a slash."""
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url).

    A rule fits its host and all subdomains if the path starts with its own. The longest rule (host
    and path) wins; of equal ones the longer host, then block, then the lesser text. rule is null and verdict
    ``otherwise`` where none fits, as for null urls and such without a host. Only distinct urls are expanded, however long, by
    rules of any number of lengths. Rows that repeat each get their url's result; no rules fit nothing; other columns are passed over.
    """
    expression = F.concat("rule_host", "rule_path")
    order = F.struct(F.length(expression).alias("n"), F.length("rule_host").alias("h"), (F.col("rule_verdict") == "block").alias("b"))
    known = rules.where("rule_host != '' AND rule_path IS NOT NULL").dropDuplicates(["rule_host", "rule_path", "rule_verdict"]).withColumn("key", F.concat_ws("\n", "rule_host", "rule_path"))
    known = known.select(F.sha2("key", 256).alias("rule_digest"), expression.alias("rule"), "rule_verdict", order.alias("order")).withColumn("short", F.substring("rule_digest", 1, 2 * PREFIX))
    named = rules.where("rule_host != '' AND rule_path IS NOT NULL")
    hosts = named.groupBy(F.col("rule_host").alias("suffix")).agg(F.collect_set(F.length("rule_path")).alias("lengths"))  # at most as many as the longest path has characters
    most = named.agg(F.max(F.size(F.split("rule_host", r"\.", -1)))).first()[0] or 0
    if known.count() <= FEW:
        known, hosts = F.broadcast(known), F.broadcast(hosts)

    host, path = url_parts(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    sites = durable(urls.where("host != ''").groupBy("host", "path").agg(F.count("*").alias("rows")))
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(max(1, most))), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    some = sites.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix")).where("suffix != ''").join(hosts, "suffix")
    some = some.withColumn("size", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))))
    keyed = some.withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", F.expr("substring(path, 1, size)")), 256)).withColumn("short", F.substring("digest", 1, 2 * PREFIX))
    met = keyed.join(known, "short").where("digest = rule_digest")
    best = met.groupBy("host", "path").agg(F.max(F.struct("order.n", "order.h", "order.b", "rule", "rule_verdict")).alias("best"))
    named = many_to_one(urls.where("host != ''"), best, ["host", "path"], sites)
    out = named.unionByName(urls.where("host = ''"), allowMissingColumns=True)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(otherwise)).alias("verdict"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM p),
r(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT page_id, host, path, h || q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) AS k
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.k = 1
"""
