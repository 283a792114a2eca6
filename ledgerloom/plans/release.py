"""Release gates: acceptance checks as rows, manifests, and the summary of a contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def check(df: DataFrame, name: str, bad: Column) -> DataFrame:
    """One row: the check's name, PASS or FAIL, and how many rows are bad."""
    n = F.count_if(F.coalesce(bad, F.lit(True)))
    return df.agg(n.alias("bad")).select(F.lit(name).alias("check"), F.when(F.col("bad") == 0, "PASS").otherwise("FAIL").alias("status"), "bad")


def acceptance(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def sums_to_one(df: DataFrame, by: list[str], share: str, tolerance: float = 1e-10) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(share).alias("s")).withColumn("ok", F.abs(F.col("s") - 1) <= tolerance)


def inventory(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Names that are missing or unexpected."""
    a, b = found.select(key).distinct(), expected.select(key).distinct()
    return b.subtract(a).withColumn("problem", F.lit("missing")).unionByName(a.subtract(b).withColumn("problem", F.lit("unexpected")))


def content_manifest(df: DataFrame, kind: str, key: list[str]) -> DataFrame:
    """Rows and an order-free digest of a table: the rows' hashes, summed in parts that don't overflow."""
    h = F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in df.columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    return df.agg(F.count("*").alias("rows"), F.countDistinct(*key).alias("keys"), F.concat_ws("-", part(0), part(1)).alias("digest")).select(F.lit(kind).alias("kind"), "rows", "keys", "digest")
