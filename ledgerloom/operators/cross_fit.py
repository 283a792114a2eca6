"""Pseudo-outcomes from repeated cluster-cross-fitted logistic predictions of an audited sample.

Each of several fold assignments deals clusters to folds; a row's prediction in an assignment comes from the rows of all
other folds. All fits (assignments times folds) advance together: one pass over the sample gives every fit's gradient
and curvature, summed in tasks and then by Spark, and the driver solves systems as large as there are features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators.contracts import ContractError
from ledgerloom.sources.scratch import written

TOLERANCE, MOST_STEPS = 1e-9, 50


def design_vector(df: DataFrame, numbers: list[str], names: list[str]) -> Column:
    """Intercept, numbers (missing ones at their mean, scaled) and all but the first level of names, as one array. The
    driver gets one row of moments and the levels."""
    cast = {c: F.col(c).cast("double") for c in numbers}
    moments = df.agg(F.lit(1).alias("one"), *[f(cast[c]).alias(f"{k}_{c}") for c in numbers for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    parts = [F.lit(1.0)]
    for c in numbers:
        mean, sd = moments[f"m_{c}"] or 0.0, moments[f"s_{c}"] or 0.0
        parts.append((F.coalesce(cast[c], F.lit(mean)) - mean) / (sd if sd > 0 else 1.0))
    for c in names:
        levels = sorted(r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().collect())
        parts += [F.coalesce((F.col(c) == level).cast("double"), F.lit(0.0)) for level in levels[1:]]
    return F.array(*parts)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_all(sample: DataFrame, width: int, folds: int, repeats: int, penalty: float) -> np.ndarray:
    """Coefficients (repeats, folds, width) of penalised weighted logistic regressions on sample (x, folds, y, w)."""
    upper = np.triu_indices(width)
    size = width + len(upper[0]) + 2
    beta = np.zeros((repeats, folds, width))
    ridge = penalty * np.diag([0.0] + [1.0] * (width - 1))
    for _ in range(MOST_STEPS):
        now = beta

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((repeats, folds, size))
            for b in batches:
                if not b.num_rows:
                    continue
                x, at, y, w = matrix(b.column("x")), matrix(b.column("folds")), b.column("y").to_numpy(), b.column("w").to_numpy()
                for r in range(repeats):
                    for k in range(folds):
                        use = w * (at[:, r] != k)
                        p = chance(x @ now[r, k])
                        total[r, k, :width] += x.T @ (use * (y - p))
                        total[r, k, width:-2] += ((x * (use * p * (1 - p))[:, None]).T @ x)[upper]
                        total[r, k, -2:] += (use * y).sum(), use.sum()
            flat = total.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], names=["i", "v"])

        sums = np.zeros(repeats * folds * size)
        for i, v in sample.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v")).collect():  # features squared a fit
            sums[i] = v
        sums = sums.reshape(repeats, folds, size)
        if ((sums[..., -2] <= 0) | (sums[..., -2] >= sums[..., -1])).any():
            raise ContractError("the outcome has one class outside a fold")
        curve = np.zeros((repeats, folds, width, width))
        curve[..., upper[0], upper[1]] = curve[..., upper[1], upper[0]] = sums[..., width:-2]
        step = np.linalg.solve(curve + ridge + 1e-10 * np.eye(width), (sums[..., :width] - beta @ ridge)[..., None])[..., 0]
        beta = beta + step / np.maximum(1, np.abs(step).max(-1, keepdims=True) / 4)
        if np.abs(step).max() < TOLERANCE:
            return beta
    raise ContractError("a cross-fit didn't converge")


def repeated_cross_fit(df: DataFrame, cluster: str, numbers: list[str], names: list[str], y: str, pi: str, drawn: str, folds: int = 5, repeats: int = 10, penalty: float = 1.0, seed: int = 1) -> DataFrame:
    """df with m_by_split (predictions, one for each fold assignment), m (their mean), m_sd, correction
    (y - m) / pi where drawn and 0 elsewhere, pseudo = m + correction, pseudo_by_split, and fold_by_split.

    Missing numbers count at their mean, missing names as the first level. Raises if an outcome has one class outside
    a fold."""
    at = F.array(*[F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col(cluster)), F.lit(folds)).cast("int") for r in range(repeats)])
    known = F.coalesce(F.col(drawn), F.lit(False))
    rows = written(df.withColumns({"_x": design_vector(df, numbers, names), "fold_by_split": at}), "design-rows")
    sample = written(rows.filter(known).select(F.col("_x").alias("x"), F.col("fold_by_split").alias("folds"), F.col(y).cast("double").alias("y"), (1 / F.col(pi)).cast("double").alias("w")), "design-sample")
    if not (first := rows.select(F.size("_x")).first()):
        raise ContractError("there are no rows")
    beta = fit_all(sample, first[0], folds, repeats, penalty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = matrix(b.column("_x")) if b.num_rows else np.zeros((0, first[0])), matrix(b.column("fold_by_split")) if b.num_rows else np.zeros((0, repeats), int)
            p = np.stack([chance((x * beta[r, at[:, r]]).sum(1)) for r in range(repeats)], 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, repeats), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "m_by_split"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInArrow(run, f"{kinds}, m_by_split array<double>").drop("_x")
    mean = F.aggregate("m_by_split", F.lit(0.0), lambda s, v: s + v) / repeats
    out = out.withColumn("m", mean)
    spread = F.aggregate("m_by_split", F.lit(0.0), lambda s, v: s + (v - F.col("m")) * (v - F.col("m")))
    corrected = lambda m: F.when(known, (F.col(y) - m) / F.col(pi)).otherwise(F.lit(0.0))
    return out.withColumns({
        "m_sd": F.sqrt(spread / max(1, repeats - 1)), "correction": corrected(F.col("m")), "pseudo": F.col("m") + corrected(F.col("m")),
        "pseudo_by_split": F.transform("m_by_split", lambda v: v + corrected(v)),
    })


def cross_fit_diagnostics(fitted: DataFrame, y: str, pi: str, drawn: str) -> DataFrame:
    """(split, fold, n_population, n_reference, weighted Brier score and log loss) of the predictions of each fold."""
    each = fitted.select(y, pi, drawn, F.posexplode(F.arrays_zip("fold_by_split", "m_by_split")).alias("split", "x"))
    p, known = F.col("x.m_by_split"), F.coalesce(F.col(drawn), F.lit(False))
    clipped = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(F.col(y) * F.ln(clipped) + (1 - F.col(y)) * F.ln(1 - clipped))
    w = F.when(known, 1 / F.col(pi))
    mean = lambda v: F.try_divide(F.sum(w * v), F.sum(w))
    return each.groupBy("split", F.col("x.fold_by_split").alias("fold")).agg(F.count("*").alias("n_population"), F.count_if(known).alias("n_reference"), mean((F.col(y) - p) * (F.col(y) - p)).alias("weighted_brier"), mean(loss).alias("weighted_log_loss"))
