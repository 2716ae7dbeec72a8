"""URL filters in DataFrame functions alone: pattern rules behind an index of their rarest literal tokens.

A rule has a regular expression and the literal tokens that any URL it fits must hold. Token counts over all URLs
choose each rule's rarest token, URLs fetch the rules of their tokens by an equi-join, and only those rules' regular
expressions run. The decision is made once for each different URL and joined back, so a URL that fills a third of
the table is matched once. Joins are left to the optimizer: small rule tables are broadcast by their measured size,
larger ones are shuffled, and the skew join splits a hot token's or URL's side.

Defined results: a null URL or one without "://" has an empty host and path and is left to the default verdict, as is
any URL that no rule fits; among rules that fit, the higher priority wins, then the longer rule, then the greater by
text; repeated rows and URLs get equal verdicts; an empty table gives none; a rule must name a token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm.common import literal_rows, saved, table

TOKEN = "[a-z0-9]+"
#: The site rules (host, path) with their verdicts.
SITE_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Words that, as a whole part of a host name, mark it as unwanted: gambling, adult, spam and advertising.
BLOCKED_WORDS = ["casino", "poker", "bet", "bets", "betting", "lottery", "slots", "adult", "porn", "xxx", "sex", "escort",
                 "pills", "viagra", "pharmacy", "spam", "ads", "adserver", "doubleclick", "tracker", "malware", "phishing", "warez"]
RULE_SCHEMA = "rule string, verdict string, priority int, length int, pattern string, tokens array<string>"


def rule_rows() -> list[tuple]:
    """(rule, verdict, priority, length, pattern, tokens); site rules go before patterns."""
    rows = []
    for verdict, host, path in SITE_RULES:
        pattern = r"^(?:[^/]*\.)?" + host.replace(".", r"\.") + path
        tokens = [t for t in host.split(".") + path.split("/") if t]
        rows.append((host + path, verdict, 2, len(host + path), pattern, tokens))
    for word in BLOCKED_WORDS:
        rows.append((f"host:{word}", "block", 1, len(word), rf"^(?:[^/]*[.-])?{word}(?:[.-][^/]*)?(?:[:/]|$)", [word]))
    return rows


def site_parts(url):
    """Host (A-Z lower-cased) and path of a URL column."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def verdicts(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """For every different URL that a rule fits: the URL, host, path and the winning rule."""
    seen = urls.select(F.col(url).alias("url")).where(F.col("url").isNotNull()).distinct()
    seen = seen.select("url", *(x.alias(n) for x, n in zip(site_parts(F.col("url")), ("host", "path"))))
    tokens = seen.withColumn("token", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit(TOKEN), F.lit(0)))))
    named = rules.select("*", F.explode(F.array_distinct("tokens")).alias("token")).drop("tokens")
    known = named.select("token").distinct()
    times = tokens.join(known, "token", "left_semi").groupBy("token").agg(F.count("*").alias("times"))
    rare = named.join(times, "token", "left").groupBy("rule", "verdict", "priority", "length", "pattern").agg(
        F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "token"))["token"].alias("token"))
    index = saved(rare)
    fits = tokens.join(index, "token").where("concat(host, path) rlike pattern")
    best = fits.groupBy("url").agg(F.max(F.struct("priority", "length", "rule", "verdict")).alias("best"))
    return best.select("url", "best.*")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule, verdict and priority (columns of these names are replaced)."""
    pages = pages.drop("host", "path", "rule", "verdict", "priority")
    best = verdicts(pages, rules, url).select(F.col("url").alias("__url"), "rule", "verdict", "priority")
    host, path = site_parts(F.col(url))
    found = pages.join(best, F.col(url) == F.col("__url"), "left").drop("__url")
    return found.select(*pages.columns, host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), "priority")


def default_rules(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, rule_rows(), RULE_SCHEMA)


def op9_urls(spark, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages").select("page_id", "url"), default_rules(spark))
    site = F.col("priority") == 2
    return found.select("page_id", "host", "path", F.when(site, F.col("rule")).alias("rule"), "verdict")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r(rule, verdict, host, path) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
best AS (
  SELECT p.*, (SELECT max({'n': length(r.rule), 'rule': r.rule, 'verdict': r.verdict}) FROM r
    WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS b FROM p)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, CASE WHEN regexp_matches(host,
  '(^|[.-])(casino|poker|bet|bets|betting|lottery|slots|adult|porn|xxx|sex|escort|pills|viagra|pharmacy|spam|ads|adserver|doubleclick|tracker|malware|phishing|warez)([.:-]|$)')
  THEN 'block' ELSE 'allow' END) AS verdict FROM best
"""
