"""Cluster bootstraps of standardized contrasts: thousands of replicates as a few stacked fits.

Draws go down a tree of halved ranges of clusters: how many of a range's draws fall into its left half is binomial, from
a generator that is seeded by the range alone. A block of clusters so knows its own draws in every replicate, whichever
task holds it, and nothing is shuffled for each replicate and cluster: tasks multiply draws with their clusters' counts
and send sums by cell. Replicates of a group share a design and advance together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators.resample import numbered
from ledgerloom.operators.standardize import BETA_BOUND, EDGE, ITERATIONS, SE_BOUND, TOLERANCE, design
from ledgerloom.sources.scratch import written

#: Clusters of a block, and replicates that are fitted together.
BLOCK, TOGETHER = 256, 250


def block_draws(block: int, size: int, reps: int, seed: int, width: int = BLOCK) -> np.ndarray:
    """(reps, clusters of the block): how often each is drawn when ``size`` clusters are drawn ``size`` times."""
    low, high, left = 0, -(-size // width), np.full(reps, size)
    node = 1
    while high - low > 1:
        mid = (low + high) // 2
        share = (mid - low) * width / (min(high * width, size) - low * width)
        first = np.random.Generator(np.random.Philox(key=[seed, node])).binomial(left, share)
        if block < mid:
            high, left, node = mid, first, 2 * node
        else:
            low, left, node = mid, left - first, 2 * node + 1
    n = min(width, size - block * width)
    return np.random.Generator(np.random.Philox(key=[seed, node])).multinomial(left, np.full(n, 1 / n))


def fit_together(x: np.ndarray, n: np.ndarray, events: np.ndarray) -> dict[str, np.ndarray]:
    """Logistic regressions of grouped counts n, events (fits, cells) on one design, by the steps of a single fit; each
    stops by its own deviance. Directions that a fit can't tell apart take the shortest step."""
    p = (events + 0.5) / (n + 1)
    w = n * p * (1 - p)
    inverse = np.linalg.pinv(np.einsum("rc,ci,cj->rij", w, x, x, optimize=True), hermitian=True)
    beta = np.einsum("rij,rj->ri", inverse, (w * np.log(p / (1 - p)) + events - n * p) @ x)
    deviance, done = np.full(len(n), np.inf), np.zeros(len(n), bool)
    fitted, se = np.zeros_like(n, float), np.zeros_like(beta)
    for _ in range(ITERATIONS):
        go = np.nonzero(~done)[0]
        if not len(go):
            break
        p = 1 / (1 + np.exp(-np.clip(beta[go] @ x.T, -35, 35)))
        w = np.where(n[go] > 0, np.maximum(n[go] * p * (1 - p), 1e-12), 0)
        inverse = np.linalg.pinv(np.einsum("rc,ci,cj->rij", w, x, x, optimize=True), hermitian=True)
        beta[go] += np.einsum("rij,rj->ri", inverse, (events[go] - n[go] * p) @ x)
        p = np.clip(1 / (1 + np.exp(-np.clip(beta[go] @ x.T, -35, 35))), 1e-12, 1 - 1e-12)
        new = -2 * (events[go] * np.log(p) + (n[go] - events[go]) * np.log(1 - p)).sum(1)
        se[go], fitted[go] = np.sqrt(np.maximum(0, np.einsum("rii->ri", inverse))), p
        done[go] = np.abs(new - deviance[go]) / (np.abs(new) + 0.1) < TOLERANCE
        deviance[go] = new
    edge = ((n > 0) & ((fitted < EDGE) | (fitted > 1 - EDGE))).any(1)
    return {"beta": beta, "converged": done, "separated": (np.abs(beta) > BETA_BOUND).any(1) | (se > SE_BOUND).any(1) | ~done | edge}


def contrasts(x: np.ndarray, at: int, n: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Mean risk with the arm on everywhere less that with it off, weighted by each fit's own counts."""
    out = []
    for on in (1.0, 0.0):
        x = x.copy()
        x[:, at] = on
        out.append((n / (1 + np.exp(-np.clip(beta @ x.T, -35, 35)))).sum(1) / np.maximum(n.sum(1), 1e-300))
    return out[0] - out[1]


def bootstrap_contrasts(grouped: DataFrame, by: str, covariates: list[str], cluster: str, reps: int, seed: int, width: int = BLOCK, together: int = TOGETHER) -> DataFrame:
    """(by, rep, estimate, separated) of cells (by, arm, covariates, cluster, n, events): clusters are drawn with
    replacement, as many as there are; a replicate in which a group has no row has a null estimate.

    The driver gets the distinct cells, which are few."""
    cells = ["arm", *covariates]
    rows = grouped.groupBy(by, *cells, cluster).agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
    rows = written(rows, "cluster-cells")
    patterns = rows.select(by, *cells).distinct().toPandas().sort_values([by, *cells], ignore_index=True)  # combinations of categories
    index = grouped.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(patterns.itertuples(index=False, name=None))], rows.select(by, *cells).schema.add("_cell", "integer"))
    slots = written(numbered(rows, cluster), "cluster-slots")
    size, k = slots.count(), len(patterns)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"i.{c}")) for c in [by, *cells]]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    placed = rows.alias("r").join(F.broadcast(index.alias("i")), condition).select(F.col(f"r.{cluster}"), "_cell", "n", "events").join(slots, cluster)
    placed = placed.select(F.floor(F.col("slot") / width).cast("int").alias("block"), (F.col("slot") % width).cast("int").alias("place"), "_cell", "n", "events")
    placed = placed.repartition(int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block")
    groups = [(g, pdf.index.to_numpy()) for g, pdf in patterns.groupby(by, sort=True)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now, held = np.zeros((reps, k, 2)), None, []

        def close() -> None:
            if held:
                place, cell, n, events = (np.concatenate(x) for x in zip(*held, strict=True))
                counts = np.zeros((min(width, size - now * width), k, 2))
                np.add.at(counts, (place, cell), np.stack([n, events], 1))
                total.reshape(reps, -1)[:] += block_draws(now, size, reps, seed, width) @ counts.reshape(len(counts), -1)

        for b in batches:
            blocks = b.column("block").to_numpy()
            for block in np.unique(blocks):
                if block != now:
                    close()
                    now, held = int(block), []
                at = blocks == block
                held.append([b.column(c).to_numpy()[at] for c in ("place", "_cell", "n", "events")])
        close()
        if now is None:
            return
        for i, (_, own) in enumerate(groups):
            for low in range(0, reps, together):
                part = np.ascontiguousarray(total[low : low + together][:, own])
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([low]), pa.array([part.tobytes()])], names=["g", "low", "sums"])

    sums = placed.mapInArrow(add, "g long, low long, sums binary")
    kind = rows.schema[by].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        i, low = int(pdf["g"].iloc[0]), int(pdf["low"].iloc[0])
        name, own = groups[i]
        total = np.zeros(min(together, reps - low) * len(own) * 2)
        for part in pdf["sums"]:  # one from each task
            total += np.frombuffer(part)
        n, events = np.moveaxis(total.reshape(-1, len(own), 2), -1, 0)
        x, at = design(patterns.loc[own], covariates)
        got = fit_together(x, n, events)
        estimate = np.where(n.sum(1) > 0, contrasts(x, at, n, got["beta"]), np.nan)
        return pd.DataFrame({by: name, "rep": np.arange(low, low + len(n)) + 1, "estimate": estimate, "separated": got["separated"]})

    return sums.groupBy("g", "low").applyInPandas(fit, f"`{by}` {kind}, rep long, estimate double, separated boolean")
