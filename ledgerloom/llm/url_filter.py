"""URL filters: host-suffix and path-prefix expressions, matched by short hash prefixes first.

Every URL expands into expressions ``suffix of its host + prefix of its path``; rules are expressions too.
Both sides are joined on the first hex digits of a SHA-256 digest, then the full digest decides, and the
longest rule that fits wins. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Hex digits of the digest on which the two sides are joined.
SHORT = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rules as a table with their digests."""
    df = spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string").distinct()
    digest = F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256)
    return df.select(
        F.concat("rule_host", "rule_path").alias("rule"), "verdict", digest.alias("digest"), F.substring(digest, 1, SHORT).alias("short"),
        (F.length("rule_host") + F.length("rule_path")).alias("rule_len"), F.length("rule_host").alias("rule_host_len"), F.length("rule_path").alias("path_len"),
    )


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict (that of the longest rule that fits, the
    longer host first among equals, then the smaller text; ``default`` where none fits).

    A null url, or one without ``://``, has an empty host and path and gets ``default``; rows that repeat stay
    as they are; columns of df named host, path, rule or verdict are replaced. Hosts and paths are judged once
    for each distinct pair, so a frequent host costs no more than a rare one; the join back is a plain equi-join
    whose large partitions Spark can split."""
    spark = df.sparkSession
    named = df.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    table = rule_table(spark, rules)
    # The lengths of rule paths, so few prefixes are built; a rule set has few distinct lengths.
    lengths = sorted({len(p) for _, _, p in rules})
    pairs = named.select("host", "path").filter("host != '' or path != ''").distinct()
    # Likewise the numbers of labels of rule hosts: a host of very many labels has few suffixes to ask for.
    counts = sorted({h.count(".") + 1 for _, h, _ in rules})
    labels = F.length("host") - F.length(F.replace("host", F.lit("."))) + 1
    suffixes = F.array_compact(F.array(*[F.when(labels >= n, F.substring_index("host", ".", -n)) for n in counts]))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    exprs = pairs.withColumn("host_suffix", F.explode(F.array_distinct(suffixes))).withColumn("path_prefix", F.explode(prefixes))
    exprs = exprs.withColumn("full", F.sha2(F.concat("host_suffix", F.lit("\n"), "path_prefix"), 256))
    found = exprs.withColumn("short", F.substring("full", 1, SHORT)).join(table, "short").filter("full = digest")
    order = F.struct("rule_len", "rule_host_len", F.col("rule"), F.col("verdict"))
    best = found.groupBy("host", "path").agg(F.max(order).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return named.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default))).select(*named.columns, "rule", "verdict")
