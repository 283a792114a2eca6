"""Embedding geometry: norms, exact neighbours of a stated query set, purity, concentration of features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.sources.batches import bounded_batches


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), n))


def all_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def packed(df: DataFrame, name: str, rows: int) -> DataFrame:
    """Blocks of that many vectors of length 1: their ids and components as bytes. A block has megabytes, so the rows
    of a batch are bounded by their bytes."""
    bounded_batches(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), rows):
                p = pdf.iloc[at : at + rows]
                m = np.stack(p["v"].to_numpy()).astype(np.float64)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                yield pd.DataFrame({f"{name}_ids": [p["vec_id"].to_numpy(np.int64).tobytes()], f"{name}_m": [m.tobytes()]})

    return df.select("vec_id", "v").mapInPandas(run, f"{name}_ids binary, {name}_m binary")


def cosine_neighbours(docs: DataFrame, queries: DataFrame, k: int, rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, cosine, label of the k nearest of each query among docs (vec_id, v, label), itself
    left out. Queries go in blocks past blocks of docs; each block keeps its k best before the shuffle."""

    slots = 8
    d = packed(docs, "d", rows).withColumn("slot", F.pmod(F.xxhash64("d_ids"), F.lit(slots)))
    q = packed(queries, "q", rows).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                qi, di = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.d_ids, np.int64)
                s = np.frombuffer(r.q_m).reshape(len(qi), -1) @ np.frombuffer(r.d_m).reshape(len(di), -1).T
                s[qi[:, None] == di[None, :]] = -np.inf
                m = min(k, s.shape[1])
                i, j = np.nonzero(s >= np.maximum(np.partition(s, -m, axis=1)[:, -m], -2)[:, None])
                yield pd.DataFrame({"query_id": qi[i], "vec_id": di[j], "cosine": s[i, j]})

    hits = d.join(q, "slot").select("q_ids", "q_m", "d_ids", "d_m").mapInPandas(search, "query_id long, vec_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "vec_id")
    best = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.join(docs.select("vec_id", "label"), "vec_id").select("query_id", "rank", "vec_id", "cosine", "label")


def near_links(docs: DataFrame, least: float, rows: int = 2048) -> DataFrame:
    """vec_id and links of each of docs (vec_id, v): how many others have a cosine of ``least`` (above 0) or more
    with it, all of them counted. Vectors that are null, not finite or zero link with nothing; vec_id is a key.

    Every block meets every block, in a grid of tasks; a task tells one number for each vector of a block."""
    groups = 8
    some = F.coalesce(all_finite(F.col("v")) & (norm(F.col("v")) > 0), F.lit(False))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    sides = [packed(docs.filter(some), x, rows).withColumns({own: F.pmod(F.xxhash64(f"{x}_ids"), F.lit(groups)), other: every}) for x, own, other in (("q", "i", "j"), ("d", "j", "i"))]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, links = b"", np.zeros(0, np.int64)
        told = lambda: pd.DataFrame({"vec_id": np.frombuffer(ids, np.int64), "links": links})
        for pdf in frames:
            for r in pdf.itertuples():
                qi, di = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.d_ids, np.int64)
                if r.q_ids != ids:
                    yield told()
                    ids, links = r.q_ids, np.zeros(len(qi), np.int64)
                near = np.frombuffer(r.q_m).reshape(len(qi), -1) @ np.frombuffer(r.d_m).reshape(len(di), -1).T >= least
                _, same, there = np.intersect1d(qi, di, return_indices=True)
                near[same, there] = False
                links += np.count_nonzero(near, axis=1)
        yield told()

    found = sides[0].join(sides[1], ["i", "j"]).select("q_ids", "q_m", "d_ids", "d_m").mapInPandas(count, "vec_id long, links long")
    none = docs.filter(~some).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("links"))
    return found.unionByName(none).groupBy("vec_id").agg(F.sum("links").alias("links"))


def purity(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of neighbours with the query's label, beside the sum of squared label shares (what chance gives)."""
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    found = neighbours.join(own, "query_id").agg(F.avg((F.col("label") == F.col("own")).cast("double")).alias("purity"), F.countDistinct("query_id").alias("queries"))
    p = labels.groupBy("label").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return found.crossJoin(p.agg(F.sum(F.col("p") * F.col("p")).alias("baseline")))  # one row each


def preservation(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Mean share of the k neighbours that two searches have in common."""
    both = first.select("query_id", "vec_id").join(second.select("query_id", "vec_id"), ["query_id", "vec_id"]).groupBy("query_id").agg(F.count("*").alias("same"))
    per = first.select("query_id").distinct().join(both, "query_id", "left").select(F.coalesce("same", F.lit(0)).alias("same"))
    return per.agg(F.count("*").alias("queries"), (F.avg("same") / k).alias("preservation"))


def principal_axes(df: DataFrame, vector: str, k: int) -> np.ndarray:
    """The k leading axes from sums of products, made in the tasks and added here: dimension squared numbers."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in frames:
            m = np.stack(pdf[vector].to_numpy()).astype(np.float64) if len(pdf) else None
            if m is not None:
                part = np.hstack([np.ones((len(m), 1)), m])
                total = part.T @ part if total is None else total + part.T @ part
        if total is not None:
            yield pd.DataFrame({"i": np.repeat(np.arange(len(total)), len(total)), "j": np.tile(np.arange(len(total)), len(total)), "x": total.ravel()})

    got = df.select(vector).mapInPandas(sums, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    n = int(got["i"].max()) + 1
    a = np.zeros((n, n))
    a[got["i"], got["j"]] = got["x"]
    mean = a[0, 1:] / a[0, 0]
    values, axes = np.linalg.eigh(a[1:, 1:] / a[0, 0] - np.outer(mean, mean))
    axes = axes[:, np.argsort(-values)[:k]]
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])


def projected(df: DataFrame, vector: str, axes: np.ndarray) -> DataFrame:
    """df with columns pc1, pc2, ...: a linear layout, named as such."""
    for n in range(axes.shape[1]):
        weights = F.array(*[F.lit(float(x)) for x in axes[:, n]])
        df = df.withColumn(f"pc{n + 1}", F.aggregate(F.zip_with(vector, weights, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda a, x: a + x))
    return df


def wedge(start: Column, end: Column, radius: Column, steps: int = 8) -> Column:
    """Corner points of a sector, its centre first."""
    angles = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: start + (end - start) * i / steps)
    centre = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    return F.concat(centre, F.transform(angles, lambda a: F.struct((radius * F.cos(a)).alias("x"), (radius * F.sin(a)).alias("y"))))
