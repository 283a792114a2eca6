"""Sparse matrices as chunks of rows in small pieces, tall thin dense ones as a key and columns of doubles. Only a chunk's
columns' rows of the thin matrix come to it, once each, and only their sums leave it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators.document_weights import PIECE, buckets_of, bytes_of, gaps, matrix_schema, places, spread, squeezed, strings, weighted
from ledgerloom.sources.batches import bounded_batches, lean
from ledgerloom.sources.scratch import dropped, large_rows, written

#: Factors that meet in one task when they are combined.
FACTORS = 32
#: Columns, counted in each chunk, that meet in one bucket, about, and messages that leave a task at once.
BUCKET_COLUMNS, MESSAGES = 1 << 18, 32


def thin(width: int) -> list[str]:
    return [f"c{i}" for i in range(width)]


def gaussian(keys: DataFrame, key: str, width: int, seed: int, *also: str) -> DataFrame:
    """A thin matrix of normal draws from hashes of the key: the same in every run, stored nowhere."""
    u = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col(key)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return keys.select(key, *also, *[(F.sqrt(-2 * F.ln(u(2 * i))) * F.cos(2 * math.pi * u(2 * i + 1))).alias(c) for i, c in enumerate(thin(width))])


def block(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in thin(width)], axis=1) if batch.num_rows else np.zeros((0, width))


def triangle(dense: DataFrame, width: int) -> np.ndarray:
    """R of the QR decomposition: each task reduces its rows to a triangle batch by batch, triangles are reduced
    FACTORS at a time, and the driver gets the last few, whatever the number of rows."""

    def rows(r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(r[:, i]) for i in range(width)], names=thin(width))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for b in batches:
            r = np.linalg.qr(np.concatenate([r, block(b, width)]), mode="r")
        if len(r):
            yield rows(r)

    schema = ", ".join(f"{c} double" for c in thin(width))
    parts = written(dense.select(*thin(width)).mapInArrow(reduce, schema), "triangles")
    while (n := parts.count()) > FACTORS * width:
        parts = written(parts.repartition(max(1, n // (FACTORS * width))).mapInArrow(reduce, schema), "triangles")
    r = np.linalg.qr(np.array(parts.collect(), dtype=float).reshape(-1, width), mode="r")
    return np.concatenate([r, np.zeros((width - len(r), width))])


def times(dense: DataFrame, key: str, width: int, right: np.ndarray) -> DataFrame:
    """A thin matrix times a small one."""
    to = right.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = block(b, width) @ right
            yield pa.RecordBatch.from_arrays([b.column(key), *[pa.array(out[:, i]) for i in range(to)]], names=[key, *thin(to)])

    kind = dense.schema[key].dataType.simpleString()
    return dense.select(key, *thin(width)).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in thin(to)))


def orthonormal(dense: DataFrame, key: str, width: int) -> DataFrame:
    """A basis of the columns of a thin matrix; directions that it lacks come out as zeros."""
    return written(times(dense, key, width, turn(triangle(dense, width))), "basis")


def turn(r: np.ndarray) -> np.ndarray:
    """What makes a matrix with this triangle orthonormal; directions that it lacks become zeros."""
    _, s, vt = np.linalg.svd(r)
    keep = s > max(s.max(), 1e-300) * 1e-12
    return vt.T * np.where(keep, 1 / np.where(keep, s, 1), 0)


def packed(entries: DataFrame, row: str, column: str) -> DataFrame:
    """Entries (row, column, weight, unique pairs) as a matrix in chunks (``matrix_schema``): a chunk for each batch."""
    bounded_batches(entries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, b in enumerate(batches):
            if not b.num_rows:
                continue
            lists = b.column("_entries")
            size, names, v = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().field(0).dictionary_encode(), lists.flatten().field(1).to_numpy()
            order = np.lexsort((names.indices.to_numpy(), np.repeat(np.arange(len(size)), size)))
            term, v = names.indices.to_numpy()[order].astype(np.int64), v[order]
            ends, (at, data) = np.concatenate([[0], np.cumsum(size)]), bytes_of(names.dictionary)
            rows = [{"piece": -1, "lens": np.diff(at).astype(np.int32).tobytes(), "data": data.tobytes(), "idf": np.ones(len(at) - 1).tobytes()}]
            for k, low in enumerate(range(0, len(size), PIECE)):
                e = slice(ends[low], ends[min(low + PIECE, len(size))])
                rows.append({"piece": k, "keys": b.column(row).slice(low, PIECE).to_pylist(), "docs": squeezed(size[low : low + PIECE]), "term": squeezed(gaps(size[low : low + PIECE], term[e])), "v": v[e].tobytes()})
            names = ["chunk", "piece", "keys", "docs", "term", "times", "v", "data", "lens", "idf"]
            kinds = [pa.int64(), pa.int32(), pa.list_(b.column(row).type), *[pa.binary()] * 7]
            yield from pa.Table.from_pylist([{"chunk": part << 32 | i, **r} for r in rows], pa.schema(list(zip(names, kinds)))).to_batches()

    x = entries.select(row, F.struct(F.col(column).cast("string").alias("name"), F.col("weight").cast("double").alias("v")).alias("_e")).filter("_e.v <> 0")
    return x.groupBy(row).agg(F.collect_list("_e").alias("_entries")).mapInArrow(lean(run), matrix_schema(entries.schema[row].dataType.simpleString()))


def message(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "chunk": pa.int64(), "place": pa.binary(), "slot": pa.binary(), "z": pa.binary(), "r": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds.values(), strict=True)], names=list(kinds))


MESSAGE = "bucket int, chunk long, place binary, slot binary, z binary, r binary"


def messages(bucket: int, z: np.ndarray, to: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """A bucket's rows of the thin matrix for each chunk that has those columns; its triangle beside the first."""
    for at in range(0, len(to), MESSAGES):
        yield message([(bucket, chunk, place, slot, z[np.frombuffer(slot, np.int32)].tobytes(), None if at + i else np.linalg.qr(z, mode="r").tobytes()) for i, (chunk, place, slot) in enumerate(to[at : at + MESSAGES])])


def drawn(x: DataFrame, width: int, seed: int, parts: int) -> DataFrame:
    """Messages of a normal draw for each column. Columns are numbered inside buckets of their names."""
    x = x.filter("piece < 0").select("chunk", "lens", "data", "idf")
    total = x.agg(F.coalesce(F.sum(F.length("lens")), F.lit(0))).first()[0] // 4
    buckets = max(total // BUCKET_COLUMNS + 1, min(parts, total // 10_000 + 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                names = strings(np.frombuffer(r["lens"], np.int32), r["data"])
                some = np.nonzero(~np.isnan(np.frombuffer(r["idf"])))[0]
                bucket = buckets_of(names, buckets)[some]
                order = np.argsort(bucket, kind="stable")
                cuts = [*np.nonzero(np.diff(bucket[order], prepend=-1))[0].tolist(), len(order)]
                at = [some[order[i:j]] for i, j in zip(cuts, cuts[1:])]
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), names.take(pa.array(some[order])))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts[:-1]].astype(np.int32)), pa.array([r["chunk"]] * len(at), pa.int64()), pa.array([p.astype(np.int32).tobytes() for p in at], pa.binary()), lists], names=["bucket", "chunk", "place", "names"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slots = None, {}
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] != now:
                    now, slots = r["bucket"], {}
                before = len(slots)
                slot = np.array([slots.setdefault(n, len(slots)) for n in r["names"]], np.int32)
                fresh = [r["names"][i] for i in np.nonzero(slot >= before)[0]]
                yield pa.RecordBatch.from_pylist([{"bucket": now, "chunk": r["chunk"], "place": r["place"], "slot": slot.tobytes(), "first": before, "names": fresh}], pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("place", pa.binary()), ("slot", pa.binary()), ("first", pa.int32()), ("names", pa.list_(pa.string()))]))

    dealt = x.mapInArrow(lean(deal), "bucket int, chunk long, place binary, names array<string>").repartition(parts, "bucket").sortWithinPartitions("bucket")
    links = written(dealt.mapInArrow(lean(number), "bucket int, chunk long, place binary, slot binary, first int, names array<string>"), "columns")
    names = links.select("bucket", "first", F.posexplode("names").alias("i", "name")).select("bucket", (F.col("first") + F.col("i")).alias("slot"), "name")
    draws = gaussian(names.select(F.struct("bucket", "slot").alias("id"), "name").withColumnRenamed("name", "key"), "key", width, seed, "id").select("id.bucket", "id.slot", *thin(width))

    def draw(left: pa.Table, right: pa.Table) -> pa.Table:
        z = np.zeros((right.num_rows, width))
        z[right["slot"].to_numpy()] = np.stack([right[c].to_numpy() for c in thin(width)], axis=1)
        to = [(r["chunk"], r["place"], r["slot"]) for r in left.to_pylist()]
        return pa.Table.from_batches(list(messages(left["bucket"][0].as_py(), z, to)), message([(0, 0, b"", b"", b"", b"")]).schema)

    return links.select("bucket", "chunk", "place", "slot").groupBy("bucket").cogroup(draws.groupBy("bucket")).applyInArrow(draw, MESSAGE)


def summed(sent: DataFrame, width: int, parts: int) -> DataFrame:
    """Messages of the sums, over all chunks, of what they sent for each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, z, to = None, np.zeros((0, width)), []
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] != now:
                    yield from messages(now, z, to)
                    now, z, to = r["bucket"], np.zeros((0, width)), []
                slot = np.frombuffer(r["slot"], np.int32)
                if (more := int(slot.max()) + 1 - len(z)) > 0:
                    z = np.concatenate([z, np.zeros((max(more, len(z) // 2), width))])
                z[slot] += np.frombuffer(r["z"]).reshape(-1, width)
                to.append((r["chunk"], r["place"], r["slot"]))
        yield from messages(now, z, to)

    return sent.select("bucket", "chunk", "place", "slot", "z").repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(lean(run), MESSAGE)


def there_and_back(x: DataFrame, thin_rows: DataFrame, width: int, right: np.ndarray, how: dict[str, bool], keep: bool = False) -> DataFrame:
    """What each chunk sends for its columns: its transpose times itself times (thin_rows times right). With
    ``keep`` the product before the transpose too, a row (the keys, y) for each piece. A chunk's messages come first, then
    its row of idf, then its pieces, so a task holds one piece and two matrices as long as the chunk's columns."""
    kind = x.schema["keys"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told, idf, w, z = None, [], None, None, None

        def full(batch: pa.RecordBatch, keys: pa.Array | None = None, y: bytes | None = None) -> pa.RecordBatch:
            if not keep:
                return batch
            n = batch.num_rows
            return pa.RecordBatch.from_arrays([*batch.columns, keys if keys is not None else pa.nulls(n, held), pa.array([y] * n, pa.binary())], names=[*batch.schema.names, "keys", "y"])

        def back() -> Iterator[pa.RecordBatch]:
            if z is not None:
                for at in range(0, len(told), MESSAGES):
                    yield full(message([(m[0], now, m[1], m[2], z[np.frombuffer(m[1], np.int32)].tobytes(), None) for m in told[at : at + MESSAGES]]))

        for b in batches:
            held = b.schema.field("keys").type
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names if c != "keys"}
                if r["chunk"] != now:
                    yield from back()
                    now, told, idf, w, z = r["chunk"], [], None, None, None
                if r["piece"] == -2:
                    told.append([r["bucket"], r["place"], r["slot"], r["z"]])
                    continue
                if r["piece"] == -1:
                    idf = np.frombuffer(r["idf"])
                    w = np.zeros((len(idf), width))
                    for m in told:
                        w[np.frombuffer(m[1], np.int32)] = np.frombuffer(m.pop()).reshape(-1, width)
                    w = w @ right
                    z = np.zeros_like(w)
                    continue
                size = spread(r["docs"])
                term = places(size, spread(r["term"]))
                size, term, _, v = (size, term, None, np.frombuffer(r["v"])) if r["v"] is not None else weighted(size, term, spread(r["times"]), idf, **how)
                left = np.nonzero(size)[0]
                ends, y = np.cumsum(size[left]).tolist(), np.zeros((len(left), width))
                for d, (lo, hi) in enumerate(zip([0, *ends], ends)):
                    c, e = term[lo:hi], v[lo:hi]
                    y[d] = e @ w.take(c, axis=0)
                    z[c] += e[:, None] * y[d]
                if keep and len(left):
                    keys = b.column("keys")[i].values.take(pa.array(left))
                    yield full(message([(None,) * 6]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), y.tobytes())
        yield from back()

    own = x.select("chunk", "piece", "docs", "term", "times", "v", "idf", *[F.col("keys") if keep else F.lit(None).cast(kind).alias("keys")])
    both = own.unionByName(thin_rows.select("chunk", F.lit(-2).alias("piece"), "bucket", "place", "slot", "z"), allowMissingColumns=True)
    both = both.repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk").sortWithinPartitions("chunk", "piece")
    return both.mapInArrow(lean(run), MESSAGE + (f", keys {kind.simpleString()}, y binary" if keep else ""))


def stacked(told: DataFrame, width: int) -> np.ndarray:
    """The triangle of all buckets' rows: one small triangle a bucket comes to the driver."""
    parts = [np.frombuffer(r[0]).reshape(-1, width) for r in told.filter("r IS NOT NULL").select("r").toLocalIterator()]
    return np.linalg.qr(np.concatenate([*parts, np.zeros((width, width))]), mode="r")


def truncated_svd(entries: DataFrame, row: str, column: str, rank: int, more: int = 10, rounds: int = 5, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """``packed_svd`` of entries (row, column, weight, unique pairs)."""
    return packed_svd(written(packed(entries, row, column), "matrix", large=True), row, rank, more, rounds, seed)


def packed_svd(x: DataFrame, row: str, rank: int, more: int = 10, rounds: int = 5, seed: int = 1, **how: bool) -> tuple[DataFrame, np.ndarray]:
    """Coordinates of the rows (row, c0, ... c rank-1: left vectors times singular values) and the ``rank`` largest
    singular values of a written matrix in chunks (``matrix_schema``; ``how`` its counts become weights), each row in one
    piece: a random range of rank + more columns, turned towards the largest directions ``rounds`` times, then a small
    exact decomposition.

    A round is one pass: chunks get their columns' rows of the range, and what they send back is the next range; both are
    made orthonormal by small matrices that the next pass applies. A range goes when the next one is written. Each
    component's sign makes its coordinate of largest size positive. Rows without entries have no coordinates; if the
    matrix has a lower rank, the last singular values are 0."""
    spark = x.sparkSession
    width, parts = rank + more, int(spark.conf.get("spark.sql.shuffle.partitions"))
    with large_rows(spark):
        made: list[str] = []
        told, right = written(drawn(x, width, seed, parts), "range", made=made), np.eye(width)
        for _ in range(rounds):
            told = written(summed(there_and_back(x, told, width, right, how), width, parts), "range", large=True, made=made)
            dropped(spark, made, 1)
            right = turn(stacked(told, width))
        last = written(there_and_back(x, told, width, right, how, keep=True), "range", large=True, made=made)
        dropped(spark, made, 1)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    y, keys = np.frombuffer(b.column("y")[i].as_py()).reshape(-1, width), b.column("keys")[i].values
                    yield pa.RecordBatch.from_arrays([keys, *[pa.array(y[:, c]) for c in range(width)]], names=[row, *thin(width)])

        kind = x.schema["keys"].dataType.elementType.simpleString()
        range_ = last.filter("y IS NOT NULL").select("keys", "y").mapInArrow(rows, f"`{row}` {kind}, " + ", ".join(f"{c} double" for c in thin(width)))
        basis = turn(triangle(range_, width))
        sums = written(summed(last.filter("y IS NULL"), width, parts).filter("r IS NOT NULL").select("r"), "range", made=made)
        u, s, _ = np.linalg.svd((stacked(sums, width) @ basis).T)
        scores = written(times(range_, row, width, basis @ (u * s)[:, :rank]), "coordinates")
        dropped(spark, made)
    if not rank or not (found := scores.agg(*[F.max_by(c, F.struct(F.abs(c), c)) for c in thin(rank)]).first()):
        return scores, s[:rank]
    sign = np.array([-1.0 if v is not None and v < 0 else 1.0 for v in found])
    return scores.select(row, *[(F.col(c) * float(f)).alias(c) for c, f in zip(thin(rank), sign, strict=True)]), s[:rank]
