"""URL filters by hashed expressions (operator 1), in DataFrame operations only.

A url's host gives its suffixes at label ends, its path the prefixes of the lengths that rules have; every pair is
an expression ``host`` + ``path``. Expressions meet rules on the first 32 bits of their SHA-256; the full digest
confirms a match; the longest rule (host and path together) decides, and an allow beats a block of equal length.
Without a rule the verdict is allow. Rules join by whatever strategy their measured size allows; a rule list too
large to broadcast is sorted and merged on the hash prefix.

Nulls, ties and odd rows: a null url or one without ``://`` has empty host and path and is allowed; null rules are
ignored; rows that repeat are judged each; other columns are ignored; empty tables give an empty result, and an
empty rule list allows all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows as a DataFrame."""
    rows = F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules))
    return spark.range(1).select(F.inline(rows))


def _host(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id_col, host, path, rule (null if none fits), verdict."""
    known = rules.where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL").select("verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    known = known.withColumn("digest", F.sha2(F.concat_ws("\x00", "rule_host", "rule_path"), 256)).withColumn("short", F.substring("digest", 1, 8))
    lengths = [r[0] for r in known.select(F.length("rule_path").alias("n")).distinct().sort("n").collect()]  # at most the longest rule path
    lengths = F.array(*map(F.lit, lengths)).cast("array<int>")
    d = pages.select(F.col(id_col).alias("_page"), F.col(url_col).alias("_url"))
    d = d.withColumn("host", F.coalesce(_host(F.col("_url")), F.lit(""))).withColumn("path", F.coalesce(_path(F.col("_url")), F.lit("")))
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # what repeats, above all of a host with a third of the pages, is expanded once
    urls = d.where("host <> ''").select("host", "path").distinct()
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    each = urls.select("host", "path", F.explode(hosts).alias("_h"), paths.alias("_paths")).select("host", "path", "_h", F.explode("_paths").alias("_p"))
    each = each.withColumn("_digest", F.sha2(F.concat_ws("\x00", "_h", "_p"), 256)).withColumn("_short", F.substring("_digest", 1, 8))
    met = each.join(known, F.col("_short") == F.col("short"))
    size = F.length("rule_host") + F.length("rule_path")
    # the digests are compared inside the aggregate: as a filter they would become a second key of the join
    sure = F.when(F.col("_digest") == F.col("digest"), F.struct(size, F.length("rule_host"), F.when(F.col("verdict") == "allow", 1).otherwise(0)))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("verdict", F.concat("rule_host", "rule_path").alias("rule")), sure).alias("best"))
    none = F.lit(None).cast(best.schema["best"].dataType)
    # rows without a host fit no rule and stay out of the join
    out = d.where("host <> ''").join(best, ["host", "path"], "left").unionByName(d.where("host = ''").withColumn("best", none))
    return out.select(F.col("_page").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r(v, h, s) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
j AS (
  SELECT page_id, host, path, v, h, s, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(s) DESC NULLS LAST) AS k
  FROM q LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)
)
SELECT page_id, host, path, h || s AS rule, coalesce(v, 'allow') AS verdict FROM j WHERE k = 1
"""
