"""URL filter: host-suffix and path-prefix expressions against hashed rules.

Every URL is expanded into ``host suffix + path prefix`` expressions.  The
expressions and the rules meet in an equi-join on the first 32 bits of a
SHA-256 digest; the full digests are then compared, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import ascii_lower, broadcast_if_small

RULE_SCHEMA = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("host", "path", "action")]
)
#: Rules up to this many are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_RULES = 1_000_000


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z folded; empty without ``://`` or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Per row of ``pages``: key, host, path, rule (host + path of the winning rule, else null), verdict.

    A rule fits its host and all subdomains if the url's path starts with the
    rule's path.  The rule whose host + path is longest wins; of equally long
    ones the longer host, then ``block`` before ``allow``.  Null or malformed
    urls have empty host and path and get ``default``; rules with a null part
    never fit; a repeated row is judged once for each copy; other columns of
    ``pages`` are ignored; no rules or no pages give defaults or no rows.
    """
    spark = pages.sparkSession
    rules = rules.dropna().dropDuplicates().select(
        F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("action").alias("r_action"),
        F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("r_digest"),
    )
    shape = rules.agg(
        F.collect_set(F.length("r_path")).alias("cuts"),  # at most one entry for each length of a path
        F.max(F.size(F.split("r_host", r"\."))).alias("labels"),
    ).first()
    cuts, labels = sorted(shape["cuts"]), shape["labels"] or 0
    base = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias(key),
        url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"),
    )
    if not cuts:
        return base.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("host", r"\.")
    tails = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.concat_ws(".", F.slice(parts, F.size(parts) - n + 1, n)),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.length("path")),
        lambda c: F.substring("path", F.lit(1), c),
    )
    said = (
        base.withColumn("tail", F.explode(tails))
        .withColumn("prefix", F.explode_outer(prefixes))
        .withColumn("digest", F.sha2(F.concat("tail", F.lit("\n"), "prefix"), 256))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    known = broadcast_if_small(rules.withColumn("short", F.substring("r_digest", 1, 8)), BROADCAST_RULES)
    hit = F.col("r_digest").isNotNull()
    rank = F.when(hit, F.struct(
        F.length("r_host") + F.length("r_path"), F.length("r_host"), F.when(F.col("r_action") == "block", 1).otherwise(0),
    ))
    met = said.join(known, (said["short"] == known["short"]) & (F.col("digest") == F.col("r_digest")), "left")
    best = met.groupBy("row").agg(
        F.first(key).alias(key), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_action").alias("action")), rank).alias("best"),
    )
    return best.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
