"""URL rules indexed by their rarest literal token.

A rule names a host, its subdomains included, and the start of a path. Each rule is filed under the one
of its whole literal tokens (host labels, closed path segments) that the fewest urls hold, counted over
all urls. A url's tokens fetch the candidate rules, and only those run their regular expression. All of it
is DataFrame work; both the index and the urls are joined by token, so neither has to be small.

Edge cases: a null url or one without ``://`` has an empty host and path and fits no rule; rules of
equal length prefer the longer host, then the smaller text; repeated rows each get their verdict; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.tables import table

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: What a url gets that no rule fits: rules single out what to block, all else may pass.
DEFAULT = "allow"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_tokens(host: Column) -> Column:
    return F.transform(F.filter(F.split(host, r"\."), lambda t: t != ""), lambda t: F.concat(F.lit("h:"), t))


def path_tokens(path: Column) -> Column:
    """Segments between two slashes or a slash and the end, as they stand."""
    return F.transform(F.filter(F.split(path, "/"), lambda t: t != ""), lambda t: F.concat(F.lit("p:"), t))


def rule_tokens(host: Column, path: Column) -> Column:
    """Tokens every fitting url must hold: the last path segment counts only when a slash closes it."""
    closed = F.regexp_replace(path, "[^/]*$", "")
    return F.array_distinct(F.concat(host_tokens(host), path_tokens(closed), F.array(F.lit(""))))


def rule_index(rules: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with ``token``, their rarest by ``url_tokens``, and ``pattern``.

    The empty token, which every url holds, files a rule without any literal token.
    """
    rules = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict").distinct()
    filed = rules.withColumn("token", F.explode(rule_tokens(F.col("r_host"), F.col("r_path"))))
    counts = url_tokens.join(filed.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct((F.col("token") == "").alias("any"), F.coalesce("n", F.lit(0)).alias("n"), "token")
    rarest = filed.join(counts, "token", "left").groupBy("r_host", "r_path", "verdict").agg(F.min(order)["token"].alias("token"))
    quote = lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))
    return rarest.withColumn("pattern", F.concat(F.lit(r"^(?:[^/]*\.)?"), quote(F.col("r_host")), F.lit("(?=/|$)"), quote(F.col("r_path"))))


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Every row of ``urls`` (with ``host``, ``path``) plus ``rule`` and ``verdict``."""
    distinct = urls.select("host", "path").distinct()
    tokens = distinct.select("host", "path", F.explode(F.array_distinct(F.concat(host_tokens(F.col("host")), path_tokens(F.col("path")), F.array(F.lit(""))))).alias("token"))
    candidates = tokens.join(rule_index(rules, tokens.select("token")), "token")
    fits = candidates.filter(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    text = F.concat("r_host", "r_path")
    best = fits.groupBy("host", "path").agg(F.min(F.struct(-F.length(text), -F.length("r_host"), text.alias("rule"), "verdict")).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("_rule"), F.col("best.verdict").alias("_verdict"))
    judged = urls.drop("rule", "verdict").join(best, ["host", "path"], "left")
    return judged.withColumn("rule", F.col("_rule")).withColumn("verdict", F.coalesce("_verdict", F.lit(default))).drop("_rule", "_verdict")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the fixed rules on every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "verdict"), r)]) for r in RULES])))
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = """
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(r_host, r_path, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (
  SELECT host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(v, length(r_host || r_path)) AS v
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict FROM p LEFT JOIN f ON p.host = f.host AND p.path = f.path
"""
