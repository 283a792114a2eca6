"""Logistic standardization: fits on grouped counts, separation diagnosis and counterfactual contrasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed values of the reference method: deviance tolerance, iterations, and bounds of the separation diagnosis.
TOLERANCE, ITERATIONS = 1e-8, 25
BETA_BOUND, SE_BOUND, EDGE = 15.0, 25.0, 1e-6


def model_terms(df: DataFrame, by: list[str], covariates: list[str], model: str | None = None, outcome: str = "y", arm: str = "home") -> DataFrame:
    """(by, formula, dropped): the right-hand side that a group's rows can carry. Covariates with one level are left out
    (nulls aren't a level); with ``model``, the arm is crossed with it where the group has more than one. A column
    has more than one level if its least and greatest differ; combinations of levels come first, as Spark sorts all rows
    for the least of strings, but hashes them for distinct ones."""
    df = df.select(*dict.fromkeys([*by, *covariates, *([model] if model else [])])).distinct()
    many = {c: F.min(c) < F.max(c) for c in [*covariates, *([model] if model else [])]}
    out = df.groupBy(*by).agg(*[F.coalesce(v, F.lit(False)).alias(f"_{c}") for c, v in many.items()])
    head = F.when(F.col(f"_{model}"), F.lit(f"{arm} * {model}")).otherwise(F.lit(arm)) if model else F.lit(arm)
    kept = F.concat_ws(" + ", head, *[F.when(F.col(f"_{c}"), F.lit(c)) for c in covariates])
    dropped = F.array_compact(F.array(*[F.when(~F.col(f"_{c}"), F.lit(c)) for c in covariates]))
    return out.select(*by, F.concat(F.lit(f"{outcome} ~ "), kept).alias("formula"), F.concat_ws(",", dropped).alias("dropped"))


def cells(df: DataFrame, by: list[str], arm: str, treated: str, covariates: list[str], cluster: str, outcome: str) -> DataFrame:
    """Counts and events of each combination of arm, covariates and cluster: all that a binomial fit needs."""
    return df.groupBy(*by, (F.col(arm) == treated).cast("int").alias("arm"), *covariates, cluster).agg(F.count("*").cast("double").alias("n"), F.sum(outcome).cast("double").alias("events"))


def design(pdf: pd.DataFrame, covariates: list[str]) -> tuple[np.ndarray, int]:
    """Intercept, arm and treatment-coded covariates; covariates with one level are left out."""
    columns = [np.ones(len(pdf)), pdf["arm"].to_numpy(float)]
    for c in covariates:
        columns += [(pdf[c] == level).to_numpy(float) for level in sorted(pdf[c].unique())[1:]]
    return np.stack(columns, axis=1), 1


def fit_logistic(x: np.ndarray, n: np.ndarray, events: np.ndarray, firth: bool = False) -> dict:
    """Iteratively reweighted least squares on grouped counts; with ``firth`` the scores carry the penalty's bias
    correction. Flags what the diagnosis needs. Steps start from each cell's own smoothed rate: from the overall rate
    they can overshoot where arms differ much."""
    deviance, done = np.inf, False
    p = (events + 0.5) / (n + 1)
    w = n * p * (1 - p)
    beta = np.linalg.pinv((x * w[:, None]).T @ x) @ (x.T @ (w * np.log(p / (1 - p)) + events - n * p))
    information = np.eye(len(beta))
    for _ in range(ITERATIONS if not firth else 4 * ITERATIONS):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        w = np.maximum(n * p * (1 - p), 1e-12)
        information = (x * w[:, None]).T @ x
        score = x.T @ (events - n * p)
        if firth:
            leverage = np.einsum("ij,jk,ik->i", x * w[:, None], np.linalg.pinv(information), x)
            score = score + x.T @ (leverage * (0.5 - p))
        beta = beta + np.linalg.lstsq(information, score, rcond=None)[0]
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -35, 35))), 1e-12, 1 - 1e-12)
        new = -2 * float((events * np.log(p) + (n - events) * np.log(1 - p)).sum())
        done = abs(new - deviance) / (abs(new) + 0.1) < TOLERANCE
        deviance = new
        if done:
            break
    w = np.maximum(n * p * (1 - p), 1e-12)  # at the last step's fitted values
    information = (x * w[:, None]).T @ x
    with np.errstate(invalid="ignore"):
        se = np.sqrt(np.diag(np.linalg.pinv(information)))
    found = symptoms(beta, se, p, done)
    return {"beta": beta, "se": se, "converged": done, "separated": bool(found), "symptoms": found, "fitted": p}


#: Symptoms that leave a fit undefined; the others make some predictions degenerate, which weights report.
BLOCKING = ("not_finite", "not_converged")


def symptoms(beta: np.ndarray, se: np.ndarray, fitted: np.ndarray, converged: bool) -> list[str]:
    """What speaks for separation in a fit, each by its name."""
    found = {
        "not_finite": not np.isfinite(beta).all() or not np.isfinite(fitted).all(), "not_converged": not converged, "large_coefficient": (np.abs(beta[np.isfinite(beta)]) > BETA_BOUND).any(),
        "large_error": (se[np.isfinite(se)] > SE_BOUND).any(), "fitted_at_edge": ((fitted < EDGE) | (fitted > 1 - EDGE)).any(),
    }
    return [name for name, there in found.items() if there]


def standardized(pdf: pd.DataFrame, covariates: list[str], weight: str, firth: bool = False) -> dict:
    """Mean fitted risk with the arm on and off everywhere, weighted; their difference; and the diagnosis."""
    x, at = design(pdf, covariates)
    fit = fit_logistic(x, pdf["n"].to_numpy(float), pdf["events"].to_numpy(float), firth)
    levels, w = [], pdf[weight].to_numpy(float)
    observed, either = (fit["fitted"] < EDGE) | (fit["fitted"] > 1 - EDGE), np.zeros(len(w), bool)
    for on in (1.0, 0.0):
        x[:, at] = on
        p = 1 / (1 + np.exp(-np.clip(x @ fit["beta"], -35, 35)))
        levels.append(float((p * w).sum() / w.sum()))
        either |= (p < EDGE) | (p > 1 - EDGE)
    return {
        "level_on": levels[0], "level_off": levels[1], "contrast": levels[0] - levels[1], "log_odds": float(fit["beta"][at]), "separated": fit["separated"], "converged": bool(fit["converged"]),
        "extreme_weight": float(w[either].sum() / w.sum()), "se": float(fit["se"][at]), "observed_extreme": float(w[observed].sum() / w.sum()),
        "blocking": any(x in BLOCKING for x in fit["symptoms"]), "symptoms": ",".join(fit["symptoms"]),
    }


FIELDS = "level_on double, level_off double, contrast double, log_odds double, separated boolean, converged boolean, extreme_weight double"


DIAGNOSIS = f"{FIELDS}, se double, observed_extreme double, blocking boolean, symptoms string"


def g_computation(grouped: DataFrame, by: list[str], covariates: list[str], weight: str = "n", firth: bool = False) -> DataFrame:
    """One standardized contrast for each group of ``by``. A group's cells, not its rows, come together.
    extreme_weight: share of the weight for which either prediction, arm on or arm off, is at 0 or 1."""
    out = fit_diagnosis(grouped, by, covariates, weight, firth)
    return out.select(*by, *[f.split()[0] for f in FIELDS.split(", ")])


def fit_diagnosis(grouped: DataFrame, by: list[str], covariates: list[str], weight: str = "n", firth: bool = False) -> DataFrame:
    """g_computation with the diagnosis of each fit: names of its symptoms of separation, whether they leave it
    undefined (not finite, not converged), and the share of the weight whose own fitted value is at 0 or 1. Separation
    in a nuisance cell doesn't block; it shows in the weights."""
    names = {f.name: f.dataType.simpleString() for f in grouped.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, **standardized(pdf, covariates, weight, firth)}])

    return grouped.groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {names[c]}" for c in by), DIAGNOSIS]))


def fit_arms(n: np.ndarray, events: np.ndarray) -> dict[str, np.ndarray]:
    """The fits and diagnoses of ``standardized`` without covariates, weighted by n, for many groups at once: counts n and
    events are (groups, 2), arm off and on; an arm without rows has n = 0. Each group's steps are those of a single fit."""
    x, there = np.array([[1.0, 0.0], [1.0, 1.0]]), n > 0
    information = lambda w: np.einsum("rc,ci,cj->rij", w, x, x)
    fitted = lambda beta: 1 / (1 + np.exp(-np.clip(beta @ x.T, -35, 35)))
    weights = lambda n, p: np.where(n > 0, np.maximum(n * p * (1 - p), 1e-12), 0.0)
    p = (events + 0.5) / (n + 1)
    w = n * p * (1 - p)
    beta = np.einsum("rij,rj->ri", np.linalg.pinv(information(w), hermitian=True), (w * np.log(p / (1 - p)) + events - n * p) @ x)
    deviance, done, last = np.full(len(n), np.inf), np.zeros(len(n), bool), p.copy()
    for _ in range(ITERATIONS):
        go = np.nonzero(~done)[0]
        if not len(go):
            break
        p = fitted(beta[go])
        inverse = np.linalg.pinv(information(weights(n[go], p)), rcond=2 * np.finfo(float).eps, hermitian=True)
        beta[go] += np.einsum("rij,rj->ri", inverse, (events[go] - n[go] * p) @ x)
        last[go] = p = np.clip(fitted(beta[go]), 1e-12, 1 - 1e-12)
        new = -2 * (events[go] * np.log(p) + (n[go] - events[go]) * np.log(1 - p)).sum(1)
        done[go] = np.abs(new - deviance[go]) / (np.abs(new) + 0.1) < TOLERANCE
        deviance[go] = new
    with np.errstate(invalid="ignore"):
        se = np.sqrt(np.einsum("rii->ri", np.linalg.pinv(information(weights(n, last)), hermitian=True)))
    level, edge = fitted(beta), (last < EDGE) | (last > 1 - EDGE)
    found = {
        "not_finite": ~np.isfinite(beta).all(1), "not_converged": ~done, "large_coefficient": (np.isfinite(beta) & (np.abs(beta) > BETA_BOUND)).any(1),
        "large_error": (np.isfinite(se) & (se > SE_BOUND)).any(1), "fitted_at_edge": (there & edge).any(1),
    }
    return {
        "level_on": level[:, 1], "level_off": level[:, 0], "contrast": level[:, 1] - level[:, 0], "log_odds": beta[:, 1], "separated": np.any(list(found.values()), axis=0), "converged": done,
        "extreme_weight": ((level < EDGE) | (level > 1 - EDGE)).any(1).astype(float), "se": se[:, 1], "observed_extreme": (n * edge).sum(1) / n.sum(1), "blocking": np.any([found[s] for s in BLOCKING], axis=0),
        "symptoms": [",".join(s for s, yes in zip(found, row, strict=True) if yes) for row in zip(*found.values(), strict=True)],
    }


def arm_diagnosis(wide: DataFrame) -> DataFrame:
    """``fit_diagnosis`` without covariates of groups in rows (n0, events0, n1, events1 for arm off and on, doubles, and
    other columns): a batch of groups is fitted together, so small groups cost no call each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, events = (np.stack([b.column(f"{c}{i}").to_numpy() for i in (0, 1)], axis=1) for c in ("n", "events"))
                got = fit_arms(n, events)
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(v) for v in got.values()]], names=[*b.schema.names, *got])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields)
    return wide.mapInArrow(run, f"{own}, {DIAGNOSIS}")


def without_cluster(grouped: DataFrame, by: list[str], covariates: list[str]) -> DataFrame:
    """Cells summed over clusters: the fit is the same, and the group small."""
    return grouped.groupBy(*by, "arm", *covariates).agg(F.sum("n").alias("n"), F.sum("events").alias("events"))


def bootstrap_g(grouped: DataFrame, drawn: DataFrame, by: list[str], covariates: list[str], cluster: str) -> DataFrame:
    """The contrast in each replicate: cells enter as often as their cluster was drawn, summed before the fit."""
    weighted = grouped.join(drawn, cluster).withColumns({"n": F.col("n") * F.col("mult"), "events": F.col("events") * F.col("mult")})
    return g_computation(without_cluster(weighted, ["rep", *by], covariates), ["rep", *by], covariates)


def ridge_moments(df: DataFrame, features: list[str], outcome: str, penalty: float) -> np.ndarray:
    """Coefficients of (X'X + penalty P)^-1 X'y with an unpenalised intercept: sums by Spark, solved here."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    k = len(cols)
    sums = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(c * F.col(outcome)).alias(f"y{i}") for i, c in enumerate(cols)]).first()
    a = np.array([[sums[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return np.linalg.solve(a + penalty * np.diag([0.0] + [1.0] * (k - 1)), np.array([sums[f"y{i}"] for i in range(k)]))
