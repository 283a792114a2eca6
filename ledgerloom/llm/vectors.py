"""Shared steps of the vector searches: usable rows, repeated vectors, packed blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.shared import lean

BLOCK_SCHEMA = "part long, dim int, n int, ids binary, mat binary"


def finite(vector: Column) -> Column:
    """The vector isn't null or empty and holds no null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def first_of_equal(df: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` rows of smallest vec_id of each distinct vector: of equal vectors no others can be among the
    keep - 1 nearest of any query but itself. Spark limits each group before the shuffle, so a vector that a
    third of all rows share stays small."""
    w = Window.partitionBy("vector").orderBy("vec_id")
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= keep).drop("_k")


def blocks(df: DataFrame, rows: int, dtype: str, part: bool = False) -> DataFrame:
    """df (vec_id long, vector array, part long if ``part``) packed into blocks of at most ``rows`` vectors of
    one dimension (and part), in the order read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def block(key, ids, mat):
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([mat.astype(dtype).tobytes()], pa.binary())], names=["part", "dim", "n", "ids", "mat"])

        for b in batches:
            lists = b.column("vector")
            dims = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims) - dims
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)
            parts = b.column("part").to_numpy(zero_copy_only=False) if part else np.zeros(len(ids), np.int64)
            for key in sorted(set(zip(parts.tolist(), dims.tolist(), strict=True))):
                sel = np.nonzero((parts == key[0]) & (dims == key[1]))[0]
                mat = flat[starts[sel][:, None] + np.arange(key[1])]
                old = held.pop(key, None)
                i, m = (ids[sel], mat) if old is None else (np.concatenate([old[0], ids[sel]]), np.concatenate([old[1], mat]))
                while len(i) >= rows:
                    yield block(key, i[:rows], m[:rows])
                    i, m = i[rows:], m[rows:]
                if len(i):
                    held[key] = [i, m]
        for key, (i, m) in held.items():
            yield block(key, i, m)

    return df.select("vec_id", "vector", *["part"] * part).mapInArrow(lean(run), BLOCK_SCHEMA)


def unpack(ids: bytes, mat: bytes, dim: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(mat, dtype).reshape(-1, dim)


def renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def answers(hits: DataFrame, asked: DataFrame, k: int, score: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``hits`` (rep, vec_id, score) for each row of ``asked``
    (query_id, rep), without the query's own id; ties go to the smaller vec_id."""
    w = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k + 1)
    best = best.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("best"))
    own = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asked.join(best, "rep").select("query_id", F.posexplode(own).alias("p", "hit"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").cast(score).alias("score"))
