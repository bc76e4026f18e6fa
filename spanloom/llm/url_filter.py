"""URL filter: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests.

Native DataFrame operations only. Cost: one narrow pass over the urls, one aggregation to distinct
(host, path), one equi-join of their few expressions with the rules, one join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: The rules of the registered query, (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Hex digits of the digest that the first join compares.
PREFIX_HEX = 8


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, rule_verdict string")


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix_hex: int = PREFIX_HEX) -> DataFrame:
    """urls with host, path, rule and verdict; columns of these names are replaced, all others are kept.

    A rule fits its host and every subdomain when the path starts with the rule's path. The rule
    with the longest host and path together wins, then the longer host, then block before allow,
    then the smaller text. No fitting rule: rule null, verdict `default`. Null urls and urls without
    :// have an empty host and path, which fit no rule. An empty rule table leaves all to `default`;
    repeated rules count once. Equal urls get equal verdicts, repeated rows stay.
    """
    rules = rules.select(F.lower("rule_host").alias("rule_host"), "rule_path", "rule_verdict").where("rule_host is not null and rule_path is not null").distinct()
    # How many labels and path characters rules have: the only expressions worth forming.
    shape = rules.agg(F.collect_set(F.size(F.split("rule_host", r"\."))), F.collect_set(F.length("rule_path"))).first()
    labels, lengths = sorted(shape[0] or []), sorted(shape[1] or [])
    digest = F.sha2(F.concat("h", F.lit("\n"), "p"), 256)
    keyed = rules.select(F.concat("rule_host", F.lit("\n"), "rule_path").alias("e"), "*").select(F.sha2("e", 256).alias("rule_digest"), "rule_host", "rule_path", "rule_verdict").withColumn("short", F.substring("rule_digest", 1, prefix_hex))

    seen = urls.drop("host", "path", "rule", "verdict").withColumn("host", url_host(urls[url])).withColumn("path", url_path(urls[url]))
    pairs = seen.select("host", "path").where("host <> ''").distinct()
    hosts = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in labels] or [F.col("host")]))
    paths = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths] or [F.col("path")]))
    expressions = pairs.select("host", "path", F.explode(hosts).alias("h"), paths.alias("ps")).select("host", "path", "h", F.explode("ps").alias("p"))
    expressions = expressions.select("host", "path", digest.alias("digest")).withColumn("short", F.substring("digest", 1, prefix_hex))
    hits = expressions.join(keyed, "short").where("digest = rule_digest")
    order = F.struct((F.length("rule_host") + F.length("rule_path")).alias("l"), F.length("rule_host").alias("h"), (F.col("rule_verdict") == "block").alias("b"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = hits.groupBy("host", "path").agg(F.max(order).alias("best")).select("host", "path", "best.rule", "best.verdict")
    return seen.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


SQL = """
with u as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages),
r(rule_host, rule_path, rule_verdict) as (values
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f as (
  select u.*, rule_host || rule_path as rule, rule_verdict,
         row_number() over (partition by page_id, host, path order by length(rule_host) + length(rule_path) desc nulls last, length(rule_host) desc) as n
  from u left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from f where n = 1
"""
