"""URL filter lists: host-suffix and path-prefix expressions joined on digest prefixes.

Every distinct URL is expanded into (host suffix, path prefix) expressions. An expression and
a rule that fits it have the same SHA-256 digest, so matching is an equi-join on the first
bytes of the digests, confirmed by the full digest; the longest rule that fits decides.

Defined results: NULL or scheme-less URLs have empty host and path and meet no rule; repeated
URLs are judged once and all their rows get the verdict; of two rules with the same host and
path ``block`` wins; an empty rule table leaves every verdict at the default. Only the named
columns of either input are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastry.llm.inputs import ascii_lower, table

#: The rules of the registered query (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
PREFIX_HEX = 8


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = ", ".join("('{}', '{}', '{}')".format(*(part.replace("'", "''") for part in rule)) for rule in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, verdict)")


def host_of(url: Column) -> Column:
    after = F.substring(url, F.locate("://", url) + F.lit(3), F.length(url))
    return ascii_lower(F.when(F.locate("://", url) > 0, F.regexp_extract(after, "^[^/?#]*", 0)).otherwise(F.lit("")))


def path_of(url: Column) -> Column:
    after = F.substring(url, F.locate("://", url) + F.lit(3), F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """Prefixes of the path with the lengths that occur among the rules."""
    wanted = F.array(*[F.lit(n) for n in lengths])
    return F.transform(F.filter(wanted, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))


def apply_rules(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict`` (clashing input columns are replaced)."""
    rules = rules.select(F.lower("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    rules = rules.withColumns({
        "rule_text": F.concat("rule_host", "rule_path"),
        "rule_digest": F.sha2(F.concat("rule_host", "rule_path").cast("binary"), 256),
    }).withColumn("digest_prefix", F.substring("rule_digest", 1, PREFIX_HEX))
    # distinct path lengths only: bounded by the longest rule path, not by the number of rules
    lengths = sorted(row[0] for row in rules.select(F.length("rule_path")).distinct().collect() if row[0] is not None)
    address = F.col("address")
    seen = urls.select(F.col(url).alias("address")).where(F.locate("://", F.col(url)) > 0).distinct()
    parts = seen.select("address", host_of(address).alias("host"), path_of(address).alias("path"))
    if lengths:
        expressions = (
            parts.select("address", F.explode(host_suffixes(F.col("host"))).alias("suffix"), path_prefixes(F.col("path"), lengths).alias("prefixes"))
            .select("address", "suffix", F.explode("prefixes").alias("prefix"))
            .select("address", F.sha2(F.concat("suffix", "prefix").cast("binary"), 256).alias("digest"))
            .withColumn("digest_prefix", F.substring("digest", 1, PREFIX_HEX))
        )
    else:
        expressions = parts.select("address", F.lit("").alias("digest"), F.lit("").alias("digest_prefix"))
    hits = (
        expressions.join(rules, "digest_prefix").where(F.col("digest") == F.col("rule_digest"))
        .groupBy("address").agg(F.max(F.struct(F.length("rule_text").alias("n"), F.col("rule_verdict"), F.col("rule_text"))).alias("best"))
    )
    kept = [c for c in urls.columns if c.lower() not in {"host", "path", "rule", "verdict", "address", "best"} or c == url]
    judged = urls.select(*[F.col(f"`{c}`") for c in kept]).join(hits, F.col(url) == F.col("address"), "left")
    return judged.select(
        *[F.col(f"`{c}`") for c in kept], F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), F.coalesce(path_of(F.col(url)), F.lit("")).alias("path"),
        F.col("best.rule_text").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return apply_rules(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op3_url_filters": op3_url_filters}

SQL = {
    "op3_url_filters": """
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), hits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, rule_verdict DESC) AS place
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM hits WHERE place = 1
"""
}
