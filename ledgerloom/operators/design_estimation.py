"""Estimates from probability samples: weighted totals, difference estimators and their variances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def horvitz_thompson(sample: DataFrame, by: list[str], y: str, pi: str) -> DataFrame:
    """Total, Hajek mean and effective size of each domain."""
    w = 1 / F.col(pi)
    return sample.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("n_hat"), F.sum(F.col(y) * w).alias("total"), (F.sum(F.col(y) * w) / F.sum(w)).alias("mean"), (F.pow(F.sum(w), 2) / F.sum(w * w)).alias("ess"))


def stratified_mean(sample: DataFrame, stratum: list[str], y: str, size: str, by: list[str] | None = None) -> DataFrame:
    """Mean and standard error under stratified sampling without replacement, with the finite correction; a
    stratum of one sampled unit adds no variance."""
    by = by or []
    per = sample.groupBy(*by, *[s for s in stratum if s not in by], size).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("v"))
    big, n = F.col(size), F.col("n")
    out = per.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(big).alias("population"), F.sum(big * F.col("m")).alias("t"), F.sum(big * big * (1 - n / big) * F.col("v") / n).alias("vt"))
    return out.select(*by, "n", "population", (F.col("t") / F.col("population")).alias("mean"), (F.sqrt("vt") / F.col("population")).alias("se"))


def pairwise_terms(sample: DataFrame, unit: str, components: list[tuple[list[str], str, str]], z: str) -> DataFrame:
    """Sums for the variance of a union of independent simple samples: each component is (group columns, N, n).
    For a pair, the chance that a component misses both depends only on whether they share its group, so units are
    first summed by their pattern of groups and probabilities, and patterns, not units, are paired."""
    def miss_one(c):
        return 1 - F.col(c[2]) / F.col(c[1])

    pi = 1 - _product([miss_one(c) for c in components])
    keys = sorted({g for c in components for g in c[0]} | {x for c in components for x in c[1:]})
    # Products of two sizes don't fit into the integers that sizes may come as.
    rows = sample.withColumns({x: F.col(x).cast("double") for c in components for x in c[1:]}).withColumn("_pi", pi)
    cells = rows.groupBy(*keys, "_pi").agg(F.sum(F.col(z) / F.col("_pi")).alias("s"), F.sum(F.pow(F.col(z) / F.col("_pi"), 2)).alias("q"))
    a, b = cells.select(*[F.col(c).alias(f"a_{c}") for c in cells.columns]), cells.select(*[F.col(c).alias(f"b_{c}") for c in cells.columns])
    both = []
    for group, big, small in components:
        same = _all([F.col(f"a_{g}") == F.col(f"b_{g}") for g in group])
        N, n, M, m = F.col(f"a_{big}"), F.col(f"a_{small}"), F.col(f"b_{big}"), F.col(f"b_{small}")
        both.append(F.when(same, F.try_divide((N - n) * (N - n - 1), N * (N - 1))).otherwise((1 - n / N) * (1 - m / M)))
    pij = F.col("a__pi") + F.col("b__pi") - 1 + _product(both)
    pairs = a.crossJoin(b)  # patterns of groups: few beside the units
    own = _all([F.col(f"a_{k}") == F.col(f"b_{k}") for k in [*keys, "_pi"]])
    products = F.col("a_s") * F.col("b_s") - F.when(own, F.col("a_q")).otherwise(0.0)
    delta = F.when(pij > 0, 1 - F.col("a__pi") * F.col("b__pi") / pij).otherwise(0.0)
    cross = pairs.agg(F.sum(delta * products).alias("v"))
    return cross.crossJoin(cells.agg(F.sum(F.col("q") * (1 - F.col("_pi"))).alias("d"), F.sum("s").alias("total"))).select("total", F.greatest(F.col("v") + F.col("d"), F.lit(0.0)).alias("variance"))


def _product(xs: list[Column]) -> Column:
    out = F.lit(1.0)
    for x in xs:
        out = out * x
    return out


def _all(xs: list[Column]) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & x
    return out


def difference_estimator(df: DataFrame, by: list[str], prediction: str, y: str, pi: str, drawn: str) -> DataFrame:
    """Mean of m + (y - m) / pi over all rows: unbiased whatever the prediction."""
    m = F.col(prediction)
    pseudo = F.when(F.col(drawn), m + (F.col(y) - m) / F.col(pi)).otherwise(m)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(drawn).alias("audited"), F.avg(m).alias("naive"), F.avg(pseudo).alias("estimate"), (F.stddev_samp(pseudo) / F.sqrt(F.count("*"))).alias("se"))


def cross_fitted_means(df: DataFrame, fold: str, cell: list[str], y: str, known: str) -> DataFrame:
    """df with ``m``: the mean of known outcomes in the row's cell over all other folds (else over all of them)."""
    good = df.filter(known)
    per = good.groupBy(*cell, fold).agg(F.sum(y).alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy(*cell)
    total = per.withColumns({"S_": F.sum("s").over(w), "N_": F.sum("n").over(w)})
    other = total.select(*cell, fold, F.try_divide(F.col("S_") - F.col("s"), F.col("N_") - F.col("n")).alias("m"))
    return df.join(other, [*cell, fold], "left").crossJoin(F.broadcast(good.agg(F.avg(y).alias("_all")))).withColumn("m", F.coalesce("m", "_all")).drop("_all")  # one row


def calibrated_confusion(sample: DataFrame, truth: str, guess: str, pi: str, totals: DataFrame) -> DataFrame:
    """Weighted confusion cells scaled so that each guess class has its known total (guess, total)."""
    cells = sample.groupBy(guess, truth).agg(F.sum(1 / F.col(pi)).alias("w"))
    return cells.join(totals, guess).withColumn("count", F.col("w") * F.col("total") / F.sum("w").over(Window.partitionBy(guess))).select(guess, truth, "count")


def certainty_plus_sample(df: DataFrame, certain: Column, drawn: str, pi: str, y: str) -> DataFrame:
    """Total over the rows taken with certainty plus the weighted total of the sampled rest."""
    sure = F.sum(F.when(certain, F.col(y)))
    rest = F.sum(F.when(~certain & F.col(drawn), F.col(y) / F.col(pi)))
    return df.agg(F.count_if(certain).alias("certain"), F.coalesce(sure, F.lit(0)).cast("double").alias("certain_total"), F.coalesce(rest, F.lit(0.0)).alias("rest_total"))
