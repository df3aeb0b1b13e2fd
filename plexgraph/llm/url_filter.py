"""URL filter by expressions and hash prefixes, in DataFrame operations only.

Every URL is expanded into those host suffixes x path prefixes that have a rule's shape (labels of
the host, characters of the path); the expressions are equi-joined with the rules on a short digest
prefix, confirmed by the full digest, and the longest confirmed rule decides.  While the rules are
few (BROADCAST_RULES) and of few shapes (JOINS) they are broadcast and no page is shuffled; beyond,
the same join is made once for each distinct URL over salted keys, with equal results.

Edge cases: a null URL or one without "://" has an empty host and path and no rule; a host or path of
any length is expanded only as far as rules reach; rules with a null part are void; of equal rules
(host and path), block wins, and of rules of equal length the one with the longer host, then the
greater one; repeated pages are judged alike; an empty rule table leaves the default verdict, an empty
page table gives no rows; an input column named like a result column is replaced, all others are
kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import columns, lower_ascii, table

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT = "allow"
PREFIX_DIGITS = 8
BROADCAST_RULES = 200_000
JOINS, SALTS = 24, 16


def split_url(url):
    """(host, path) as columns."""
    found = F.locate("://", url)
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def _suffix(labels, n: int):
    """The host's last n labels; null for a host of fewer."""
    return F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), n), "."))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """pages (column url) with host, path, rule and verdict; rules: host, path, verdict."""
    digest = F.sha2(F.concat("host", F.lit("\n"), "path"), 256)
    known = (
        rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
        .where("host is not null and path is not null and verdict is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(digest.alias("__digest"), F.concat("host", "path").alias("__rule"), F.col("verdict").alias("__verdict"), F.length("host").alias("__host_chars"), F.length("path").alias("path_chars"), F.size(F.split("host", r"\.", -1)).alias("labels"))
        .withColumn("__prefix", F.substring("__digest", 1, PREFIX_DIGITS))
    )
    shapes = known.groupBy("labels", "path_chars").agg(F.count(F.lit(1)).alias("n")).orderBy("labels", "path_chars").collect()
    known = known.drop("labels", "path_chars")
    host, path, kept = *split_url(F.col("url")), columns(pages, "host", "path", "rule", "verdict")
    if len(shapes) <= JOINS and sum(x.n for x in shapes) <= broadcast_rules:
        # One broadcast join for each shape of a rule: no page moves, and no URL is a hot key.
        out = pages.select(F.struct(*kept).alias("__row"), host.alias("__host"), path.alias("__path")).withColumn("__labels", F.split("__host", r"\.", -1))
        for i, x in enumerate(shapes):
            full = F.when(F.length("__path") >= x.path_chars, F.sha2(F.concat(_suffix(F.col("__labels"), x.labels), F.lit("\n"), F.substring("__path", 1, x.path_chars)), 256))
            own = known.select(*[F.col(c).alias(f"{c}{i}") for c in known.columns])
            out = out.withColumn(f"__full{i}", full).join(F.broadcast(own), (F.substring(f"__full{i}", 1, PREFIX_DIGITS) == F.col(f"__prefix{i}")) & (F.col(f"__full{i}") == F.col(f"__digest{i}")), "left")
        met = [F.when(F.col(f"__rule{i}").isNotNull(), F.struct(F.length(f"__rule{i}").alias("a"), F.col(f"__host_chars{i}").alias("b"), F.col(f"__rule{i}").alias("rule"), F.col(f"__verdict{i}").alias("verdict"))) for i in range(len(shapes))]
        best = F.array_max(F.array(*met)) if met else F.lit(None).cast("struct<rule:string,verdict:string>")
        return out.select("__row", "__host", "__path", best.alias("__best")).select("__row.*", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))
    # Very many rules: each distinct URL is expanded once; a common suffix such as "com/" is salted.
    tries = F.array(*[F.struct(F.lit(x.labels).alias("labels"), F.lit(x.path_chars).alias("chars")) for x in shapes])
    urls = pages.select("url").where(host != "").distinct().select("url", F.split(host, r"\.", -1).alias("__labels"), path.alias("__path")).select("url", "__labels", "__path", F.explode(tries).alias("x"))
    suffix = F.array_join(F.slice("__labels", F.size("__labels") - F.col("x.labels") + 1, F.col("x.labels")), ".")
    tried = urls.where((F.size("__labels") >= F.col("x.labels")) & (F.length("__path") >= F.col("x.chars")))
    tried = tried.select("url", F.sha2(F.concat(suffix, F.lit("\n"), F.substring("__path", F.lit(1), F.col("x.chars"))), 256).alias("full"))
    tried = tried.withColumn("__prefix", F.substring("full", 1, PREFIX_DIGITS)).withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = tried.join(salted, ["__prefix", "salt"]).where("full = __digest")
    best = found.groupBy("url").agg(F.max(F.struct(F.length("__rule").alias("a"), F.col("__host_chars").alias("b"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))).alias("__best"))
    # A page without a host meets no rule; its own key spreads such pages over all tasks.
    key = F.when(host != "", F.col("url")).otherwise(F.concat(F.lit("\n"), F.monotonically_increasing_id().cast("string")))
    paged = pages.select(F.struct(*kept).alias("__row"), key.alias("__url"), host.alias("__host"), path.alias("__path"))
    met = paged.join(best.withColumnRenamed("url", "__url"), "__url", "left")
    return met.select("__row.*", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), raw AS (
  SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest
), split AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM raw
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), met AS (
  SELECT s.page_id, s.host, s.path, r.rule_host || r.rule_path AS rule, r.rule_verdict,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS nth
  FROM split s LEFT JOIN rules r
    ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM met WHERE nth = 1
"""
