"""Approximate nearest neighbours through learned partitions.

A neighbour graph over a bounded sample is cut into parts of equal size; a small classifier learns from that
which part a vector belongs to, assigns every row of the table, and routes each query to its most probable
parts, whose rows are reranked with exact inner products in double precision. How many parts a query needs is
measured on rows of the sample that the classifier hasn't seen: the fewest that find TARGET of their nearest.
Clustered vectors need few parts; vectors spread evenly in all directions need most of them, whatever the parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.vectors import answers, finite, first_of_equal
from ledgerloom.llm.shared import lean, saved

#: Rows of the sample on which the index is fitted (of those with the smallest seeded hash), neighbours of its
#: graph, rows of a part aimed at (of the table, and of the sample).
SAMPLE_ROWS, NEIGHBOURS, PART_ROWS, PART_SAMPLE = 8192, 16, 128, 32
#: Ranges of neighbouring parts into which rows are dealt, whatever the number of parts; queries, about, that one task
#: holds; products that it holds at once.
GROUPS, BAND, PRODUCTS = 16, 1 << 15, 1 << 21
#: What stands for a part in rows that are queries; parts start at -1.
QUERY = -2
#: Share of the nearest rows that routing must find on unseen rows of the sample, and the share held back for that.
TARGET, HELD = 0.96, 0.2


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product of each row, itself left out."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each node: the graph is halved again and again along a slowly varying vector of its walk,
    at the median, and the halves are then refined by swapping pairs that cut fewer edges."""
    part = np.zeros(len(graph), np.int64)
    for level in range(int(np.log2(parts))):
        for p in range(2**level):
            rows = np.nonzero(part == p)[0]
            if len(rows) < 2:
                continue
            place = np.full(len(graph), -1)
            place[rows] = np.arange(len(rows))
            near = place[graph[rows]]
            inside = near >= 0
            back = np.where(inside, near, 0)
            v = rng.standard_normal(len(rows))
            for _ in range(60):
                walk = np.where(inside, v[back], 0.0).sum(axis=1) + v
                np.add.at(walk, near[inside], np.repeat(v, inside.sum(axis=1)))
                degree = 1 + inside.sum(axis=1) + np.bincount(near[inside], minlength=len(rows))
                v = walk / degree
                v -= v.mean()
                v /= max(np.linalg.norm(v), 1e-12)
            side = np.zeros(len(rows), bool)
            side[np.argsort(v, kind="stable")[len(rows) // 2 :]] = True
            for _ in range(8):
                other = np.where(inside, side[back] != side[:, None], False).sum(axis=1)
                gain = 2 * other - inside.sum(axis=1)
                np.add.at(gain, near[inside], np.where((side[back] != side[:, None])[inside], 1, -1))
                a, b = (np.nonzero((side == s) & (gain > 0))[0] for s in (False, True))
                n = min(len(a), len(b)) // 2 + (min(len(a), len(b)) == 1)
                if not n:
                    break
                for g in (a, b):
                    flip = g[np.argsort(-gain[g], kind="stable")[:n]]
                    side[flip] = ~side[flip]
            part[rows[side]] += 2**level
    return part


@dataclass
class Router:
    """Softmax over parts behind one hidden layer."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_router(x: np.ndarray, part: np.ndarray, parts: int, rng: np.random.Generator, hidden: int = 128, epochs: int = 30) -> Router:
    """Minibatch gradient descent with momentum on the sample's parts."""
    r = Router(rng.standard_normal((x.shape[1], hidden)) * (2 / x.shape[1]) ** 0.5, np.zeros(hidden), rng.standard_normal((hidden, parts)) * 0.05, np.zeros(parts))
    speed = [np.zeros_like(w) for w in (r.w1, r.b1, r.w2, r.b2)]
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            i = order[at : at + 128]
            h = np.maximum(x[i] @ r.w1 + r.b1, 0)
            z = h @ r.w2 + r.b2
            g = np.exp(z - z.max(axis=1, keepdims=True))
            g /= g.sum(axis=1, keepdims=True)
            g[np.arange(len(i)), part[i]] -= 1
            g /= len(i)
            gh = (g @ r.w2.T) * (h > 0)
            for w, s, d in zip((r.w1, r.b1, r.w2, r.b2), speed, (x[i].T @ gh, gh.sum(0), h.T @ g, g.sum(0)), strict=True):
                s *= 0.9
                s -= 0.4 * (1 - epoch / epochs) * d
                w += s
    return r


@dataclass
class Index:
    dim: int
    parts: int
    scale: float
    router: Router
    probes: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.router.probabilities(x / self.scale)


def probes_needed(index: Index, x: np.ndarray, held: np.ndarray, near: int) -> int:
    """Fewest most probable parts that hold TARGET of the ``near`` nearest rows of the held-back rows."""
    s = x[held] @ x.T
    s[np.arange(len(held)), held] = -np.inf
    top = np.argpartition(-s, near - 1, axis=1)[:, :near]
    p = index.probabilities(x)
    place = np.argsort(np.argsort(-p[held], axis=1, kind="stable"), axis=1)
    found = np.take_along_axis(place, p.argmax(axis=1)[top], axis=1)
    shares = [(found < n).mean() for n in range(1, index.parts + 1)]
    return 1 + next(n for n, share in enumerate(shares) if share >= TARGET)


def fit_index(df: DataFrame, rows: int, k: int, seed: int = 7) -> Index | None:
    """Fitted on at most SAMPLE_ROWS distinct rows (vec_id, vector) of the most frequent length."""
    sample = df.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE_ROWS).select("vector").toArrow()["vector"].combine_chunks()
    if not len(sample):
        return None
    dims = pc.list_value_length(sample).to_numpy()
    dim = int(np.bincount(dims).argmax())
    x = np.unique(np.array([v for v in sample.to_pylist() if len(v) == dim], np.float64), axis=0)
    rng = np.random.default_rng(seed)
    parts = 1
    while parts * 2 <= min(rows // PART_ROWS, len(x) // PART_SAMPLE):
        parts *= 2
    x = x[rng.permutation(len(x))]
    scale = float(np.sqrt((x**2).mean())) * 4 / dim**0.5 or 1.0
    part = balanced_parts(neighbour_graph(x, NEIGHBOURS), parts, rng) if parts > 1 else np.zeros(len(x), np.int64)
    held = np.arange(int(HELD * len(x)))
    index = Index(dim, parts, scale, fit_router(x[len(held) :] / scale, part[len(held) :], parts, rng, epochs=30 if parts > 1 else 0), parts)
    if parts > 1:
        index.probes = probes_needed(index, x, held, max(1, k * len(x) // rows))
    return index


def placed(vectors: pa.ListArray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of the fitted length with the probabilities of their parts, and the other rows."""
    dims = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    fits, odd = np.nonzero(dims == index.dim)[0], np.nonzero(dims != index.dim)[0]
    x = vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, index.dim)
    return fits, index.probabilities(x), odd


def assigned(df: DataFrame, index: Index) -> DataFrame:
    """df (vec_id, vector) with its most probable part. Vectors of another length than the fitted one go to part -1,
    which is searched exhaustively."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits, p, _ = placed(b.column("vector"), index)
            part = np.full(b.num_rows, -1)
            part[fits] = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vector"), pa.array(part)], names=["vec_id", "vector", "part"])

    return df.select("vec_id", "vector").mapInArrow(lean(run), f"vec_id long, vector {dict(df.dtypes)['vector']}, part long")


def routed(df: DataFrame, index: Index, spans: dict[int, tuple[int, int]], groups: int) -> DataFrame:
    """df (vec_id, vector) once for each group that holds rows of parts to be searched, with those parts as bits
    (part -1 first)."""
    member = np.zeros((index.parts + 1, groups), bool)
    for part, (low, high) in spans.items():
        member[part + 1, low : high + 1] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits, p, odd = placed(b.column("vector"), index)
            want = np.zeros((b.num_rows, index.parts + 1), bool)
            want[fits[:, None], np.argsort(-p, axis=1, kind="stable")[:, : index.probes] + 1] = True
            want[odd, 0] = True
            row, group = np.nonzero(want.astype(np.float32) @ member.astype(np.float32))
            bits = [x.tobytes() for x in np.packbits(want, axis=1)]
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(row), b.column("vector").take(row), pa.array(group), pa.array(bits, pa.binary()).take(row)], names=["vec_id", "vector", "slot", "wanted"])

    return df.select("vec_id", "vector").mapInArrow(lean(run), f"vec_id long, vector {dict(df.dtypes)['vector']}, slot long, wanted binary")


class Nearest:
    """The k best of each of a set of queries, as candidates come by. Scores are summed pair by pair, so they don't
    depend on what comes together; what a matrix product leaves out is worse by more than its rounding."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray, want: np.ndarray, k: int):
        self.ids, self.mat, self.want, self.k = ids, mat, want, k
        self.rounding = 1e-15 * (mat.shape[1] + 1) * np.sqrt(np.einsum("ij,ij->i", mat, mat))
        self.bound = np.full(len(ids), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count, self.most = 0, 2 * k * len(ids) + (1 << 18)

    def meet(self, part: int, ids: np.ndarray, mat: np.ndarray) -> None:
        rows = np.nonzero(self.want[:, part + 1])[0]
        longest, m = np.sqrt(np.einsum("ij,ij->i", mat, mat).max()), min(self.k, len(ids))
        step = max(1, PRODUCTS // len(ids))
        for at in range(0, len(rows), step):
            r = rows[at : at + step]
            s, least = self.mat[r] @ mat.T, self.bound[r]
            if np.isinf(least).any():
                least = np.maximum(least, np.partition(s, len(ids) - m, axis=1)[:, len(ids) - m])
            i, j = np.nonzero(s >= (least - self.rounding[r] * longest)[:, None])
            for low in range(0, len(i), 1 << 16):
                a, c = r[i[low : low + (1 << 16)]], j[low : low + (1 << 16)]
                self.held.append((a, ids[c], np.einsum("ij,ij->i", self.mat[a], mat[c])))
                self.count += len(a)
                if self.count > self.most:
                    self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        q, ids, score = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.bound[q[rank == self.k - 1]] = score[rank == self.k - 1]
        best = rank < self.k
        self.held, self.count = [(q[best], ids[best], score[best])], int(best.sum())

    def best(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for q, ids, score in self.held:
            for low in range(0, len(q), 1 << 16):
                part = slice(low, low + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[q[part]]), pa.array(ids[part]), pa.array(score[part])], names=["rep", "vec_id", "score"])


def searched(rows: DataFrame, parts: int, k: int) -> DataFrame:
    """rep, vec_id, score: the k best of each query in each slot. rows (slot, part, vec_id, vector, wanted) stand by
    slot and, inside, by part, queries first; a task holds a slot's queries and lets its other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, near = None, [], {}
        for b in batches:
            slot, part = b.column("slot").to_numpy(), b.column("part").to_numpy()
            ids, lists = b.column("vec_id").to_numpy(), b.column("vector")
            dims = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)])
            cuts = [*np.nonzero(np.any([np.diff(x, prepend=x[0] - 1) for x in (slot, part, dims)], axis=0))[0].tolist(), len(slot)]
            for i, j in zip(cuts, cuts[1:]):
                dim, mat = int(dims[i]), flat[ends[i] : ends[j]].astype(np.float64).reshape(j - i, -1)
                if slot[i] != now:
                    for x in near.values():
                        yield from x.best()
                    now, asked, near = slot[i], [], {}
                if part[i] == QUERY:
                    bits = np.frombuffer(b"".join(b.column("wanted").slice(i, j - i).to_pylist()), np.uint8).reshape(j - i, -1)
                    asked.append((dim, ids[i:j], mat, np.unpackbits(bits, axis=1, count=parts + 1).astype(bool)))
                    continue
                for d in sorted({x[0] for x in asked}):
                    near[d] = Nearest(*(np.concatenate(x) for x in zip(*[x[1:] for x in asked if x[0] == d])), k)
                asked = []
                if dim in near:
                    near[dim].meet(int(part[i]), ids[i:j], mat)
        for x in near.values():
            yield from x.best()

    return rows.mapInArrow(lean(run), "rep long, vec_id long, score double")


def fewest(sizes: list[int], rows: int) -> int:
    """How many parts hold ``rows`` rows for certain, whichever they are; all parts if none do."""
    total = 0
    for n, size in enumerate(sorted(sizes), 1):
        total += size
        if total >= rows:
            return n
    return len(sizes)


def ann_search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found (largest inner product) for each query among docs,
    the query's own id left out. Both sides: vec_id long, vector array<float or double>.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without
    an id. Equal vectors are searched once; of those beyond the k + 1 smallest ids none can be an answer. One id with
    several vectors is several candidates of that id, of which the best counts; as a query its smallest vector counts.
    So many parts are searched that k others are found where there are as many of the query's length. Rows in the
    order of their parts are cut into GROUPS of equal size, so a part that most rows fall into is many tasks' work. A
    task takes the queries of a band that search parts of its group, each once, and gives the k + 1 best of each:
    what is made grows with the queries, not with the parts or rows that each searches."""
    usable = F.col("vec_id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    docs, queries = docs.filter(usable).distinct(), queries.filter(usable).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    docs = saved(first_of_equal(docs, k + 1), "vectors")
    rows = docs.count()
    index = fit_index(docs, rows, k)
    if index is None:
        return docs.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    reps = saved(queries.groupBy("vector").agg(F.min("vec_id").alias("rep")), "queries")
    asked = queries.join(reps, "vector").select(F.col("vec_id").alias("query_id"), "rep")
    bands = reps.count() // BAND + 1
    parts = saved(assigned(docs, index), "parts")
    sizes = dict(parts.groupBy("part").agg(F.count("*")).collect())  # a row for each of at most SAMPLE_ROWS / PART_SAMPLE parts
    index.probes = min(index.parts, max(index.probes, fewest([sizes.get(p, 0) for p in range(index.parts)], k + 1)))
    groups, total, starts = min(GROUPS, index.parts), sum(sizes.values()), {}
    for p in sorted(sizes):
        starts[p] = sum(sizes[x] for x in starts)
    spans = {p: (starts[p] * groups // total, (starts[p] + sizes[p] - 1) * groups // total) for p in starts}
    at = docs.sparkSession.createDataFrame([(p, starts[p], sizes[p]) for p in starts], "part long, start long, size long")
    group = F.expr(f"(start + pmod(xxhash64(vec_id), size)) * {groups} div {total}")
    every = F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))
    there = parts.join(F.broadcast(at), "part").select("vec_id", "vector", "part", group.alias("group"), every.alias("band"))
    there = there.select((F.col("band") * groups + F.col("group")).alias("slot"), "part", "vec_id", "vector", F.lit(None).cast("binary").alias("wanted"))
    asks = routed(reps.withColumnRenamed("rep", "vec_id"), index, spans, groups)
    asks = asks.select((F.pmod(F.xxhash64("vec_id"), F.lit(bands)) * groups + F.col("slot")).alias("slot"), F.lit(QUERY).cast("long").alias("part"), "vec_id", "vector", "wanted")
    both = asks.unionByName(there).repartitionById(groups * bands, F.col("slot").cast("int")).sortWithinPartitions("slot", "part", F.size("vector"))
    return answers(searched(both, index.parts, k + 1), asked, k, "double")
