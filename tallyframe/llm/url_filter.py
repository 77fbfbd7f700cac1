"""URL filters by rules on hosts and paths, with DataFrame functions only.

A URL is expanded into expressions, a suffix of its host and a prefix of its path each; rules are expressions of the
same form. Both sides are hashed; a short prefix of the digest is joined on, the whole digest confirms. Only suffixes of
as many labels, and prefixes of as many characters, as some rule has are made, so a URL has a bounded number of
expressions however long it is. The longest rule wins; between equally long ones that with the longer host, then block.

Edge cases: a null URL or one without :// has empty host and path and gets the default verdict, as one that no rule
fits; repeated rows each get their verdict; further columns are ignored; empty tables give empty tables, and no rules
the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import common

#: Hexadecimal digits of the digest that are joined on.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next of / ? # or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (page_id, url) with host, path, rule and verdict; rules: verdict, host, path."""
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").where("verdict is not null and host is not null and path is not null").distinct()
    shapes = rules.agg(F.collect_set(F.size(F.split("host", r"\.", -1))).alias("labels"), F.collect_set(F.length("path")).alias("chars")).first()
    labels, chars = sorted(shapes["labels"]), sorted(shapes["chars"])
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\0"), path), 256)
    rules = rules.select(
        digest(F.col("host"), F.col("path")).alias("r_digest"),
        F.struct((F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"), (F.col("verdict") == "block").cast("int").alias("block"), F.concat("host", "path").alias("rule"), "verdict").alias("r"),
    ).withColumn("r_short", F.substring("r_digest", 1, SHORT))
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("row", F.monotonically_increasing_id())
    n_labels = F.size(F.split("host", r"\.", -1))
    suffixes = F.array_compact(F.array(*[F.when(n_labels >= n, F.substring_index("host", ".", -n)) for n in labels]).cast("array<string>"))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in chars]).cast("array<string>"))
    asked = (
        urls.withColumn("suffix", F.explode_outer(suffixes)).withColumn("prefix", F.explode_outer(prefixes))
        .withColumn("digest", digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("digest", 1, SHORT))
    )
    found = asked.join(rules, (F.col("short") == F.col("r_short")) & (F.col("digest") == F.col("r_digest")), "left")
    best = found.groupBy("row", "page_id", "url", "host", "path").agg(F.max("r").alias("r"))
    return best.select("page_id", "url", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.lit(default)).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(common.table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH u AS (
  SELECT row_number() OVER () AS row_no, page_id, url, strpos(coalesce(url, ''), '://') AS cut FROM pages
), s AS (
  SELECT row_no, page_id, CASE WHEN cut > 0 THEN substr(url, cut + 3) ELSE '' END AS rest FROM u
), p AS (
  SELECT row_no, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM s
), rules(verdict, r_host, r_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT row_no, r_host || r_path AS rule, verdict,
         row_number() OVER (PARTITION BY row_no ORDER BY length(r_host) + length(r_path) DESC, length(r_host) DESC, verdict DESC) AS place
  FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM fits WHERE place = 1) f USING (row_no)
"""
