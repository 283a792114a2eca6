"""Nested weights, arm differences, paired contrasts and common support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def nested_weights(df: DataFrame, model: str, cluster: str) -> DataFrame:
    """df with w = 1/models * 1/clusters of the model * 1/rows of the model and cluster; they sum to 1. The model
    counts come from the (model, cluster) cells, so no window gathers a model's rows."""
    cells = df.groupBy(model, cluster).agg(F.count("*").alias("_r"))
    per = cells.groupBy(model).agg(F.count("*").alias("_i"))
    m = per.agg(F.count("*").alias("_m"))
    sizes = cells.join(F.broadcast(per), model).crossJoin(F.broadcast(m))  # one row for each model, and one
    return df.join(sizes, [model, cluster]).withColumn("w", 1.0 / F.col("_m") / F.col("_i") / F.col("_r")).drop("_r", "_i", "_m")


def equal_model_weights(df: DataFrame, model: str) -> DataFrame:
    """df with w = 1/models * 1/rows of the model."""
    per = df.groupBy(model).agg(F.count("*").alias("_n"))
    return df.join(F.broadcast(per), model).crossJoin(F.broadcast(per.agg(F.count("*").alias("_m")))).withColumn("w", 1.0 / F.col("_m") / F.col("_n")).drop("_n", "_m")


def weighted_mean(value: Column, weight: Column, when: Column | None = None) -> Column:
    use = value.isNotNull() if when is None else value.isNotNull() & when
    return F.try_divide(F.sum(F.when(use, value * weight)), F.sum(F.when(use, weight)))


def arm_difference(df: DataFrame, by: list[str], arm: str, treated: str, control: str, value: str, weight: str) -> DataFrame:
    """Weighted means of both arms and their difference; a missing arm gives null."""
    a, b = (weighted_mean(F.col(value), F.col(weight), F.col(arm) == x) for x in (treated, control))
    out = df.groupBy(*by).agg(F.count_if(F.col(arm) == treated).alias("n_treated"), F.count_if(F.col(arm) == control).alias("n_control"), a.alias("level_treated"), b.alias("level_control"))
    return out.withColumn("difference", F.col("level_treated") - F.col("level_control"))


def paired(df: DataFrame, unit: list[str], arm: str, target: str, reference: str, value: str) -> DataFrame:
    """One row for each unit with the mean of both arms and their difference, from one aggregate rather than a
    self-join; units that miss an arm say so."""
    t, r = F.col(arm) == target, F.col(arm) == reference
    out = df.filter(t | r).groupBy(*unit).agg(F.avg(F.when(t, F.col(value))).alias("target"), F.avg(F.when(r, F.col(value))).alias("reference"))
    status = F.when(F.col("target").isNull(), "no_target").when(F.col("reference").isNull(), "no_reference").otherwise("paired")
    return out.withColumns({"status": status, "d": F.col("target") - F.col("reference")})


def paired_contrast(pairs: DataFrame, model: str) -> DataFrame:
    """Equal-model mean of the paired differences and of both arms' levels."""
    per = pairs.filter("status = 'paired'").groupBy(model).agg(F.avg("d").alias("d"), F.avg("target").alias("t"), F.avg("reference").alias("r"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("models"), F.sum("n").alias("pairs"), F.avg("t").alias("level_target"), F.avg("r").alias("level_reference"), F.avg("d").alias("contrast"))


def support_cells(df: DataFrame, cell: list[str], arm: str, treated: str, control: str) -> DataFrame:
    out = df.groupBy(*cell).agg(F.count_if(F.col(arm) == treated).alias("n_treated"), F.count_if(F.col(arm) == control).alias("n_control"))
    return out.withColumn("supported", (F.col("n_treated") > 0) & (F.col("n_control") > 0))


def common_support(df: DataFrame, cell: list[str], arm: str, treated: str, control: str) -> DataFrame:
    """The rows in cells that hold both arms."""
    return df.join(support_cells(df, cell, arm, treated, control).filter("supported").select(*cell), cell, "left_semi")


def estimable(df: DataFrame, by: list[str], arm: str, treated: str, control: str, outcome: str, least: int = 5) -> DataFrame:
    """Why a contrast can't be estimated: the first reason that holds, or ok."""
    t, c, y = F.col(arm) == treated, F.col(arm) == control, F.col(outcome)
    out = df.groupBy(*by).agg(F.count_if(t).alias("n_treated"), F.count_if(c).alias("n_control"), F.coalesce(F.sum(F.when(t, y)), F.lit(0)).cast("long").alias("events_treated"), F.coalesce(F.sum(F.when(c, y)), F.lit(0)).cast("long").alias("events_control"))
    events = F.col("events_treated") + F.col("events_control")
    n = F.col("n_treated") + F.col("n_control")
    reason = F.when((F.col("n_treated") == 0) | (F.col("n_control") == 0), "one_arm").when(events < least, "few_events").when(events == n, "no_variation")
    reason = reason.when((F.col("events_treated").isin(0)) | (F.col("events_treated") == F.col("n_treated")) | (F.col("events_control") == 0) | (F.col("events_control") == F.col("n_control")), "separated").otherwise("ok")
    return out.withColumn("reason", reason)


def envelope(estimates: DataFrame, by: list[str], value: str = "estimate") -> DataFrame:
    """Smallest and largest estimate over label sets, and whether the sign is the same under all."""
    out = estimates.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("label_sets"))
    return out.withColumn("same_sign", (F.col("low") > 0) | (F.col("high") < 0))


def with_arms(df: DataFrame, arm: str, treated: str, control: str) -> DataFrame:
    return df.filter(F.col(arm).isin(treated, control))


def group_total(column: str, by: list[str]) -> Column:
    return F.sum(column).over(Window.partitionBy(*by))
