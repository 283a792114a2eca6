"""Exact quantiles of any number of rows in small buffers: histograms narrow down where each rank lies until one value
is left. A task holds counts of bins, never the values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.sources.scratch import written

BINS = 1024


def order_statistics(values: DataFrame, by: list[str], ranks: DataFrame) -> DataFrame:
    """The value (by, rank, value) at each rank, from 0, of ranks (by, rank); values (by, v) have no nulls.

    In each round a rank's range is cut into BINS; the bin that holds it gives the next range, from its least to its
    largest value, which lie in different bins of the next round: so every round narrows."""
    bounds = values.groupBy(*by).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    todo, found = written(ranks.distinct().join(bounds, by).withColumn("before", F.lit(0).cast("long")), "ranks"), None
    half = F.col("high") / 2 - F.col("low") / 2  # of all doubles' range, too, a number
    place = F.when(half > 0, F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - F.col("low") / 2) / half * BINS).cast("int"))).otherwise((F.col("v") > F.col("low")).cast("int"))
    first = True
    while not todo.isEmpty():
        if first:  # all ranks of a group share their range still: its rows are counted once
            bins = values.join(bounds, by).groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
            bins, own = todo.join(bins, by), [*by, "rank"]
        else:
            own = [*by, "rank"]
            bins = values.join(todo, by).filter(F.col("v").between(F.col("low"), F.col("high"))).groupBy(*own, "before", place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("n").over(Window.partitionBy(*own).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        bins = bins.withColumn("upto", F.col("before") + upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        bins = written(bins.select(*own, F.col("least").alias("low"), F.col("most").alias("high"), (F.col("upto") - F.col("n")).alias("before")), "ranks")
        one = bins.filter("low = high").select(*own, F.col("low").alias("value"))
        found = one if found is None else found.unionByName(one)
        todo, first = bins.filter("low < high"), False
    return found if found is not None else todo.select(*by, "rank", F.col("low").alias("value"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float], nearest: bool = False) -> DataFrame:
    """(by, a column for each quantile wanted): linear between neighbours (type 7), or the smallest value with at least
    that share of all at or below it. Nulls and NaN don't count; a group without a value gives no row."""
    keys = by or ["_all"]
    v = F.col(value).cast("double")
    rows = df if by else df.withColumn("_all", F.lit(0))
    values = written(rows.select(*keys, v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")), "quantile-values")
    size = values.groupBy(*keys).agg(F.count("*").alias("size"))
    at = lambda p: F.greatest(F.lit(0), F.ceil(F.lit(p) * F.col("size")) - 1) if nearest else F.lit(p) * (F.col("size") - 1)
    places = F.array(*[F.struct(F.lit(name).alias("name"), at(p).cast("double").alias("h")) for name, p in wanted.items()])
    places = written(size.select(*keys, F.explode(places).alias("x")).select(*keys, "x.name", "x.h", F.floor("x.h").alias("low"), F.ceil("x.h").alias("high")), "quantile-places")
    ranks = places.select(*keys, F.explode(F.array("low", "high")).alias("rank"))
    known = order_statistics(values, keys, ranks)
    part = lambda c: known.select(*keys, F.col("rank").alias(c), F.col("value").alias(f"{c}_value"))
    both = places.join(part("low"), [*keys, "low"]).join(part("high"), [*keys, "high"])
    between = F.col("low_value") + (F.col("h") - F.col("low")) * (F.col("high_value") - F.col("low_value"))
    return both.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, between)).alias(name) for name in wanted]).drop("_all")
