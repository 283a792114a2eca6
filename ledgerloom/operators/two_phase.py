"""Two-phase bootstrap of group means of pseudo-outcomes: clusters are drawn again and, in the same replicate, the
audited controls of each stratum get multipliers; the spread over fold assignments is added, and one factor makes the
intervals of all groups hold together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions.expressions import uniform
from ledgerloom.operators.contracts import ContractError
from ledgerloom.operators.resample import replicate_sums
from ledgerloom.sources.scratch import written


def numbered_within(df: DataFrame, group: str, unit: str) -> DataFrame:
    """df with slot, from 0 in the order of unit within each group, and group_size: by ranges that are written once, so
    no group goes through one task."""
    rows = written(df.repartitionByRange(group, unit).withColumn("_range", F.spark_partition_id()), "ranges")
    # One row for each range and group that meet.
    before = rows.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    before = before.withColumns({"_before": F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "group_size": F.sum("_n").over(w)}).drop("_n")
    place = F.row_number().over(Window.partitionBy(group, "_range").orderBy(unit)) - 1
    return rows.withColumn("slot", place).join(before, [group, "_range"]).withColumn("slot", F.col("slot") + F.col("_before")).drop("_range", "_before")


def control_multipliers(controls: DataFrame, stratum: str, reps: int, seed: str) -> DataFrame:
    """(rep, stratum, slot, times): in each replicate a stratum of n controls is drawn n - 1 times with replacement."""
    dealt = controls.filter(F.col("slot") < F.col("group_size") - 1).select(stratum, "slot", "group_size").repartition(int(controls.sparkSession.conf.get("spark.sql.shuffle.partitions")), stratum, "slot")
    each = dealt.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    pick = F.floor(uniform(f"{seed}|2", F.col("rep").cast("string"), F.col(stratum).cast("string"), F.col("slot").cast("string")) * F.col("group_size")).cast("long")
    return each.groupBy("rep", stratum, pick.alias("slot")).agg(F.count("*").alias("times"))


def two_phase_band(rows: DataFrame, cluster: str, by: str, unit: str, splits: DataFrame, reps: int, seed: str, level: float = 0.95, split_factor: float = 1.1) -> DataFrame:
    """rows: cluster, by, unit, m (prediction), correction ((y - m) / pi, else 0), stratum (null but for audited controls)
    and fraction (their sampling fraction, between 0 and 1). splits: (split, by, estimate), a point of each group for
    each fold assignment.

    A control's correction is multiplied by 1 - sqrt(1 - f) + sqrt(1 - f) * n / (n - 1) * times. Errors are
    sqrt(within^2 + split_factor * split^2); the factor is the level's quantile of the largest of all groups' distances
    over their error within. Replicates that lack a group count as failed. Raises if a stratum has one control."""
    rest = F.sqrt(1 - F.col("fraction"))
    fixed = F.when(F.col("stratum").isNotNull(), 1 - rest).otherwise(F.lit(1.0))
    base = written(rows.groupBy(cluster, by).agg(F.sum(F.col("m") + F.col("correction")).alias("all"), F.sum(F.col("m") + fixed * F.col("correction")).alias("s"), F.count("*").alias("n")), "two-phase-base")
    controls = written(numbered_within(rows.filter("stratum is not null").select(cluster, by, unit, "stratum", "fraction", "correction"), "stratum", unit), "controls")
    if bad := controls.filter("group_size < 2 or not (fraction > 0 and fraction < 1)").select("stratum").first():
        raise ContractError(f"stratum {bad[0]} can't be resampled")
    again = rest * F.col("group_size") / (F.col("group_size") - 1) * F.col("times") * F.col("correction")
    extra = control_multipliers(controls, "stratum", reps, seed).join(controls, ["stratum", "slot"]).groupBy("rep", cluster, by).agg(F.sum(again).alias("e"))
    sums = replicate_sums(base, base, cluster, [by], ["s", "n"], reps, f"{seed}|1", extra=written(extra, "control-sums"))
    est = written(sums.select("rep", by, ((F.col("s") + F.col("e")) / F.col("n")).alias("r")), "replicates")
    point = base.groupBy(by).agg((F.sum("all") / F.sum("n")).alias("estimate"), F.sum("n").alias("n"))
    groups = point.agg(F.count("*").alias("groups"))
    whole = est.groupBy("rep").agg(F.count("r").alias("k")).crossJoin(F.broadcast(groups)).filter("k = groups").select("rep")  # one row
    good = written(est.join(whole, "rep"), "whole-replicates")
    within = good.groupBy(by).agg(F.stddev_samp("r").alias("within_se"))
    far = good.join(F.broadcast(point.join(within, by)), by)  # one row a group
    z = F.coalesce(F.try_divide(F.abs(F.col("r") - F.col("estimate")), F.col("within_se")), F.lit(0.0))
    factor = far.groupBy("rep").agg(F.max(z).alias("z")).agg(F.percentile("z", F.lit(level)).alias("factor"), (F.lit(reps) - F.count("*")).alias("failed"))
    out = point.join(within, by, "left").join(splits.groupBy(by).agg(F.stddev_samp("estimate").alias("split_sd")), by, "left").crossJoin(F.broadcast(factor))  # one row
    out = out.withColumn("split_sd", F.coalesce("split_sd", F.lit(0.0)))
    out = out.withColumn("se", F.sqrt(F.col("within_se") * F.col("within_se") + split_factor * F.col("split_sd") * F.col("split_sd")))
    half = lambda k: k * F.col("se")
    return out.select(
        by, "n", "estimate", "within_se", "split_sd", "se", (F.col("estimate") - half(1.959963984540054)).alias("low"), (F.col("estimate") + half(1.959963984540054)).alias("high"),
        (F.col("estimate") - half(F.col("factor"))).alias("simultaneous_low"), (F.col("estimate") + half(F.col("factor"))).alias("simultaneous_high"), "factor", "failed",
    )
