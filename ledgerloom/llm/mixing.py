"""Mixing sources to target weights by capped water-filling; only DataFrame functions are used.

Targets: every source gets its weighted share of the mix until it reaches ``max_epochs`` times its size; what
is above is shared again by weight among the rest. The level at which no source is above its cap follows from
the sources ordered by cap / weight, so one pass over the (few) source rows replaces the repeated clamping.

Draw: whole repetitions for all documents of a source, and one further repetition for documents in seeded
order until the source's target is met; the document at which the target falls takes part of a repetition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.shared import saved

#: Words are runs of other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the seeded key that split a source's documents into ranges for the running sums.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, weights: list[int], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size) with targets: sources in code-point order, null last, take ``weights`` in turn."""
    total = F.sum("source_size").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    df = sizes.withColumns({"weight": w, "mix": F.least(F.lit(float(share)), F.lit(float(max_epochs))) * total, "cap": F.lit(float(max_epochs)) * F.col("source_size")})
    # With the sources by cap / weight, those before the first that the level doesn't fill are at their caps.
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = df.withColumns({"full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "open_weight": F.sum("weight").over(rest)})
    df = df.withColumn("level", (F.col("mix") - F.col("full")) / F.col("open_weight"))
    df = df.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(Window.partitionBy())["level"]
    return df.withColumn("level", level).select("source", "source_size", "weight", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def mix_sources(df: DataFrame, weights: list[int], share: float, max_epochs: float, seed: str = "mix") -> DataFrame:
    """One row per row of df: doc_id, source, size, source_size, target, copies (whole repetitions), part
    (words of one further, partial repetition) and taken = copies * size + part.

    Null or empty texts have size 0 and take nothing. A null source is a source of its own, last in order. Rows
    that repeat count as documents of their own. Two runs agree. Running sums go by ranges of the seeded key,
    so a source with a third of all rows is spread over ``16 ** RANGE_DIGITS`` groups."""
    sizes = saved(df.select("doc_id", "source", word_count(F.col("text")).alias("size"), seeded_key(F.col("doc_id"), seed).alias("key")), "mix-sizes")
    sizes = sizes.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = sizes.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, max_epochs)
    # Sources times ranges rows: small beside the documents.
    before = F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = targets.withColumnRenamed("source", "t_source")
    plan = ranges.withColumn("range_start", before).join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("source").alias("p_source"), F.col("range").alias("p_range"), "range_start", "source_size", "target")
    rows = sizes.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("range") == F.col("p_range")))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    over = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    rows = rows.withColumn("start", start).withColumn("whole", whole).withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), over - F.col("start"))))
    full = (F.col("more") == F.col("size")) & (F.col("size") > 0)
    copies = F.col("whole") + F.when(full, 1).otherwise(0)
    return rows.select(
        "doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), copies.cast("long").alias("copies"),
        F.when(full, 0).otherwise(F.col("more")).cast("long").alias("part"), (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken"),
    )


def mixed_documents(df: DataFrame, weights: list[int], share: float, max_epochs: float, seed: str = "mix") -> DataFrame:
    """The rows of df as often as the mix takes them, with their own columns only. A partial repetition counts as
    a whole one if it is half of the document or more. Rows of one doc_id are taken alike."""
    plan = mix_sources(df, weights, share, max_epochs, seed)
    times = (F.col("copies") + F.when((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size")), 1).otherwise(0)).cast("int")
    plan = plan.groupBy(F.col("doc_id").alias("_d")).agg(F.max(times).alias("_times")).filter("_times > 0")
    rows = df.join(plan, F.col("doc_id").eqNullSafe(F.col("_d")))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*df.columns)
