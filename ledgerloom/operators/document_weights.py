"""TF-IDF weights, a row for each document. Terms are counted where documents are read. Many documents (a chunk) share a
list of distinct terms and are kept in small pieces; a chunk's distinct terms, not each document's, go to the tasks of
their bucket, which tell the chunk the terms' weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerloom.sources.batches import bounded_batches, lean
from ledgerloom.sources.scratch import written

#: Terms of all chunks that meet in one bucket, about, and the documents of a batch that is told.
BUCKET_TERMS, TOLD = 1 << 20, 256
#: Documents of a piece; a chunk ends beyond so many terms or documents, or at the end of its task. Chunks there are
#: about, if there are documents for them.
PIECE, CHUNK_TERMS, CHUNK_DOCS, CHUNKS = 256, 1 << 18, 1 << 15, 24
#: Terms in a row of a chunk's list of terms.
ROW_TERMS = 1 << 15


def char_runs(words: pa.StringArray, shortest: int = 3, longest: int = 5) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The distinct terms of ``features.char_grams`` of words, and by word the places of its runs among them and how
    many it has."""
    ends, data = bytes_of(words)
    lens = np.diff(ends).astype(np.int64)
    padded = np.full(len(data) + 2 * len(words), 32, np.uint8)
    padded[np.arange(len(data)) + 2 * np.repeat(np.arange(len(words)), lens) + 1] = data
    starts = np.nonzero((padded & 0xC0) != 0x80)[0]  # of characters
    word = np.repeat(np.arange(len(words)), lens + 2)[starts]
    chars = np.bincount(word, minlength=len(words))
    left = np.repeat(np.cumsum(chars), chars) - np.arange(len(starts))  # characters from here to the word's end
    starts, of, begins, sizes = np.append(starts, len(padded)), [], [], []
    for n in range(shortest, longest + 1):
        i = np.nonzero(left >= n)[0]
        of.append(word[i])
        begins.append(starts[i])
        sizes.append(starts[i + n] - starts[i])
    of, begin, size = np.concatenate(of), np.concatenate(begins), np.concatenate(sizes)
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    coded = strings(size, padded[at].tobytes()).dictionary_encode()
    order = np.argsort(of, kind="stable")
    return coded.dictionary, coded.indices.to_numpy()[order].astype(np.int64), np.bincount(of, minlength=len(words))


def summed(doc: np.ndarray, term: np.ndarray, times: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, term, times) in order, each pair once. Counts stand in the low bits of what is sorted."""
    bits = int(times.max(initial=1)).bit_length()
    both = np.sort((doc * terms + term) << bits | times)
    key, times = both >> bits, both & ((1 << bits) - 1)
    starts = np.nonzero(np.diff(key, prepend=-1))[0]
    return *np.divmod(key[starts], max(terms, 1)), np.add.reduceat(times, starts) if len(starts) else times


def entries(lists: pa.ListArray, grams: str) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of a batch of lists of words, and (doc, term, times) of it; nulls are no words."""
    doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    words, term = coded.dictionary, coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    n, real = len(words), term >= 0
    if grams == "pairs":
        next_to = np.nonzero((doc[:-1] == doc[1:]) & real[:-1] & real[1:])[0]
        pairs, code = np.unique(term[next_to] * n + term[next_to + 1], return_inverse=True)
        joined = pc.binary_join_element_wise(words.take(pa.array(pairs // max(n, 1))), words.take(pa.array(pairs % max(n, 1))), " ")
        # A word with a space may equal a pair.
        coded = pa.concat_arrays([words, joined]).dictionary_encode()
        doc, term = np.concatenate([doc[real], doc[next_to]]), coded.indices.to_numpy()[np.concatenate([term[real], n + code])].astype(np.int64)
        return coded.dictionary, *summed(doc, term, np.ones(len(doc), np.int64), len(coded.dictionary))
    doc, term, times = summed(doc[real], term[real], np.ones(int(real.sum()), np.int64), n)
    if grams == "chars":
        words, run, sizes = char_runs(words)
        size = sizes[term]
        at = np.repeat((np.cumsum(sizes) - sizes)[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        doc, term, times = summed(np.repeat(doc, size), run[at], np.repeat(times, size), len(words))
    return words, doc, term, times


def bytes_of(terms: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each term starts in the bytes of all, the end beside, and the bytes."""
    ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1] if len(terms) else np.zeros(1, np.int32)
    data = terms.buffers()[2] if len(terms) else None
    return ends - ends[0], np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)


def strings(lens: np.ndarray, data: bytes) -> pa.StringArray:
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(lens, dtype=np.int32)])
    return pa.StringArray.from_buffers(len(lens), pa.py_buffer(ends.tobytes()), pa.py_buffer(data))


def packed_schema(kind: str) -> str:
    """A matrix of some rows: their keys, the number of entries of each, the columns' names, and the entries' places
    among those names and weights."""
    return f"chunk long, keys array<{kind}>, lens binary, data binary, size binary, term binary, v binary"


def packed_rows(chunk: int, keys: pa.Array, names: pa.StringArray, size: np.ndarray, term: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    ends, data = bytes_of(names)
    held = [np.diff(ends).astype(np.int32), data, size.astype(np.int32), term.astype(np.int32), v.astype(np.float64)]
    lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
    return pa.RecordBatch.from_arrays([pa.array([chunk]), lists, *[pa.array([x.tobytes()], pa.binary()) for x in held]], names=["chunk", "keys", "lens", "data", "size", "term", "v"])


def buckets_of(terms: pa.StringArray, buckets: int) -> np.ndarray:
    """A bucket for each term: a polynomial of its bytes, the same in every process."""
    ends, data = bytes_of(terms)
    lens = np.diff(ends)
    power = np.cumprod(np.full(int(lens.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(ends[:-1], lens)], dtype=np.uint64)])
    h = total[ends[1:]] - total[ends[:-1]]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def squeezed(x: np.ndarray) -> bytes:
    """Integers from 0 on: the bytes that the largest needs, by significance, compressed."""
    k = next(k for k in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * k)
    raw = x.astype(f"<u{k}").view(np.uint8).reshape(-1, k).T.tobytes()
    return bytes([k]) + len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def spread(held: bytes) -> np.ndarray:
    k, n = held[0], int.from_bytes(held[1:9], "little")
    raw = pa.Codec("zstd").decompress(held[9:], k * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(k, -1).T).view(f"<u{k}").ravel().astype(np.int64)


def gaps(size: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Ascending places of each document: the first, then by how much each is larger than the one before."""
    out, starts = np.diff(term, prepend=0), (np.cumsum(size) - size)[size > 0]
    out[starts] = term[starts]
    return out


def places(size: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    up, some = np.cumsum(gaps), size > 0
    starts = (np.cumsum(size) - size)[some]
    return up - np.repeat((up - gaps)[starts], size[some])


#: Pieces of a chunk (piece 0 on): keys, entries of each, their places among the chunk's terms (gaps) and counts. The last
#: rows of a chunk (pieces up to -1): its terms, from ``first`` on, and the number of its documents that hold them.
COUNTED = "piece int, first int, docs binary, term binary, times binary, data binary, lens binary, df binary"


def counted(docs: DataFrame, key: str, words: str, grams: str, most: int) -> DataFrame:
    """Documents in chunks of at most ``most`` documents, and about CHUNK_TERMS terms, as COUNTED says."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, piece, held = TaskContext.get().partitionId(), 0, 0, 0
        known, df = pa.array([], pa.string()), np.zeros(0, np.int64)

        def row(piece: int, keys: pa.Array, first: int | None, *held: bytes | None) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | number]), lists, pa.array([piece], pa.int32()), pa.array([first], pa.int32()), *[pa.array([x], pa.binary()) for x in held]], names=["chunk", "keys", "piece", "first", "docs", "term", "times", "data", "lens", "df"])

        def end(keys: pa.Array) -> Iterator[pa.RecordBatch]:
            for low in range(0, len(known), ROW_TERMS):
                ends, data = bytes_of(known.slice(low, ROW_TERMS))
                yield row((low - len(known)) // ROW_TERMS, keys[:0], low, None, None, None, data.tobytes(), np.diff(ends).astype(np.int32).tobytes(), df[low : low + ROW_TERMS].astype(np.int32).tobytes())

        keys = None
        for b in batches:
            for low in range(0, b.num_rows, PIECE):
                keys, lists = (b.column(i).slice(low, PIECE) for i in (0, 1))
                terms, doc, term, times = entries(lists, grams)
                if not len(doc):
                    continue
                at = pc.index_in(terms, value_set=known).fill_null(-1).to_numpy().astype(np.int64)
                fresh = np.nonzero(at < 0)[0]
                at[fresh] = len(known) + np.arange(len(fresh))
                known, df = pa.concat_arrays([known, terms.take(pa.array(fresh))]), np.concatenate([df, np.zeros(len(fresh), np.int64)])
                df[at] += np.bincount(term, minlength=len(terms))
                doc, term, times = summed(doc, at[term], times, len(known))
                size = np.bincount(doc, minlength=len(lists))
                yield row(piece, keys, None, squeezed(size), squeezed(gaps(size, term)), squeezed(times), None, None, None)
                piece, held = piece + 1, held + len(lists)
                if len(known) > CHUNK_TERMS or held >= most:
                    yield from end(keys)
                    number, piece, held = number + 1, 0, 0
                    known, df = known[:0], df[:0]
        if held:
            yield from end(keys)

    return docs.select(key, words).mapInArrow(lean(run), f"chunk long, keys array<{kind}>, " + COUNTED)


def weighted(size: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, sublinear: bool, unit: bool) -> tuple[np.ndarray, ...]:
    """(entries of each document, places, counts, weights) without terms whose idf is NaN."""
    doc, v = np.repeat(np.arange(len(size)), size), idf[term]
    some = np.nonzero(~np.isnan(v))[0]
    doc, term, tf, v = doc[some], term[some], tf[some], v[some]
    v = v * (1 + np.log(tf) if sublinear else tf)
    if unit:
        v = v / np.sqrt(np.bincount(doc, v * v, len(size)))[doc]
    return np.bincount(doc, minlength=len(size)), term, tf, v


def matrix_schema(kind: str) -> str:
    """A matrix in chunks of rows. Piece -1: the names of its columns and their idf (NaN: no column). Pieces 0 on: keys,
    entries of each, their places (gaps) and counts, or the entries themselves (v)."""
    return f"chunk long, piece int, keys array<{kind}>, docs binary, term binary, times binary, v binary, data binary, lens binary, idf binary"


def document_weights(docs: DataFrame, key: str, words: str, grams: str = "words", min_df: int = 1, max_df: float = 1.0, sublinear: bool = False, unit: bool = False, terms: bool = False, bucket_terms: int = BUCKET_TERMS, packed: bool = False, counts: bool = False) -> DataFrame:
    """(key, weights array) of docs (key, words array), and with ``terms`` (terms array, tf array) beside: tf * (ln((1 + n) /
    (1 + df)) + 1) of its words, its words and pairs of neighbours (grams ``pairs``), or runs of three to five characters of
    its words (``chars``). Terms in fewer than ``min_df`` documents or more than ``max_df`` of them are left out, as are
    documents without any other. ``sublinear``: 1 + ln tf for tf; ``unit``: each document of length 1. Rows that
    share a key are one document. ``packed``: matrices of batches of documents instead, as ``packed_schema`` has them.
    ``counts``: counts and idf, of which ``weighted`` makes weights, as ``matrix_schema`` has them; documents aren't moved."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts, kind = int(spark.conf.get("spark.sql.shuffle.partitions")), docs.schema[key].dataType.simpleString()
    docs = docs.select(key, words)
    again = docs.groupBy(key).agg(F.count("*").alias("_rows"))
    n, most = again.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.max("_rows"), F.lit(0))).first()
    if most > 1:  # null between two rows' words: no pair goes across
        docs = docs.groupBy(key).agg(F.flatten(F.collect_list(F.concat(words, F.array(F.lit(None).cast("string"))))).alias(words))
    docs = docs.coalesce(max(CHUNKS, n // CHUNK_DOCS))
    chunks = written(counted(docs, key, words, grams, min(max(n // CHUNKS, PIECE), CHUNK_DOCS)), "term-counts", large=True)
    total = chunks.agg(F.coalesce(F.sum(F.length("lens")), F.lit(0))).first()[0] // 4
    buckets = max(total // bucket_terms + 1, min(parts, total // 10_000 + 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                found = strings(np.frombuffer(r["lens"], np.int32), r["data"])
                bucket = buckets_of(found, buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, (ends, data) = bucket[order], bytes_of(found.take(pa.array(order)))
                cuts = [*np.nonzero(np.diff(bucket, prepend=-1))[0].tolist(), len(order)]
                lens, df, order = np.diff(ends), np.frombuffer(r["df"], np.int32)[order], (order + r["first"]).astype(np.int32)
                spans = list(zip(cuts, cuts[1:]))
                packed = [[x[i:j].tobytes() for i, j in spans] for x in (order, lens, df)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(spans), r["chunk"])), pa.array([data[ends[i] : ends[j]].tobytes() for i, j in spans], pa.binary()), *[pa.array(x, pa.binary()) for x in packed]], names=["bucket", "chunk", "data", "slots", "lens", "df"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def told() -> Iterator[pa.RecordBatch]:
            if held:
                lens = [np.frombuffer(r["lens"], np.int32) for r in held]
                code = strings(np.concatenate(lens), b"".join(r["data"] for r in held)).dictionary_encode()
                code = code.indices.to_numpy()
                df = np.bincount(code, np.concatenate([np.frombuffer(r["df"], np.int32) for r in held]))
                idf = np.where((df >= min_df) & (df <= max_df * n), np.log((1 + n) / (1 + df)) + 1, np.nan)[code]
                at, out = 0, []
                for r, size in zip(held, map(len, lens), strict=True):
                    v = idf[at : at + size]
                    some = np.nonzero(~np.isnan(v))[0]
                    out.append((r["chunk"], np.frombuffer(r["slots"], np.int32)[some].tobytes(), v[some].tobytes()))
                    at += size
                for i in range(0, len(out), TOLD):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + TOLD]), (pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "slots", "idf"])
            held.clear()

        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] != now:
                    yield from told()
                    now = r["bucket"]
                held.append(r)
        yield from told()

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, idfs, heads, now, idf, names = [], [], [], None, None, None
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names if c != "keys"}
                if r["chunk"] != now:
                    slots, idfs, heads, now = [], [], [], r["chunk"]
                if r["slots"] is not None:
                    slots.append(np.frombuffer(r["slots"], np.int32))
                    idfs.append(np.frombuffer(r["idf"]))
                    continue
                if r["piece"] < 0:
                    heads.append((r["lens"], r.get("data", b"")))
                    if r["piece"] < -1:
                        continue
                    lens, data = (b"".join(x) for x in zip(*heads))
                    idf = np.full(len(lens) // 4, np.nan)
                    if slots:
                        idf[np.concatenate(slots)] = np.concatenate(idfs)
                    slots, idfs = [], []
                    if counts:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([-1], pa.int32()), *[pa.array([x], pa.binary()) for x in (data, lens, idf.tobytes())]], names=["chunk", "piece", "data", "lens", "idf"])
                    heads, names = [], strings(np.frombuffer(lens, np.int32), data) if terms or packed else None
                    continue
                size = spread(r["docs"])
                size, term, tf, v = weighted(size, places(size, spread(r["term"])), spread(r["times"]), idf, sublinear, unit)
                left = np.nonzero(size)[0]
                ends = np.concatenate([[0], np.cumsum(size[left])])
                keys = b.column("keys")[i].values
                if packed:
                    if len(left):
                        used, term = np.unique(term, return_inverse=True)
                        yield packed_rows(r["chunk"], keys.take(pa.array(left)), names.take(pa.array(used)), size[left], term, v)
                    continue
                for low in range(0, len(left), TOLD):
                    e = ends[low : low + TOLD + 1]
                    inside = slice(e[0], e[-1])
                    lists = [names.take(pa.array(term[inside])), pa.array(tf[inside].astype(np.int32)), pa.array(v[inside])] if terms else [pa.array(v[inside])]
                    offsets = pa.array((e - e[0]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(left[low : low + TOLD])), *[pa.ListArray.from_arrays(offsets, x) for x in lists]], names=[key, *(["terms", "tf"] if terms else []), "weights"])

    dealt = chunks.filter("piece < 0").select("chunk", "first", "data", "lens", "df").mapInArrow(lean(deal), "bucket int, chunk long, data binary, slots binary, lens binary, df binary")
    idf = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(weigh), "chunk long, slots binary, idf binary")
    own = ["piece", "lens", *["data"] * (terms or packed or counts), *["keys", "docs", "term", "times"] * (not counts)]
    moved = chunks.filter("piece < 0") if counts else chunks
    both = idf.unionByName(moved.select("chunk", *own), allowMissingColumns=True).repartition(parts, "chunk").sortWithinPartitions("chunk", F.col("slots").isNull(), "piece")
    if counts:
        heads = written(both.mapInArrow(lean(weights), "chunk long, piece int, data binary, lens binary, idf binary"), "term-weights", large=True)
        pieces = chunks.filter("piece >= 0").select("chunk", "piece", "keys", "docs", "term", "times")
        return spark.createDataFrame([], matrix_schema(kind)).unionByName(pieces, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    if packed:
        return both.mapInArrow(lean(weights), packed_schema(kind))
    return both.mapInArrow(lean(weights), f"`{key}` {kind}, " + "terms array<string>, tf array<int>, " * terms + "weights array<double>")
