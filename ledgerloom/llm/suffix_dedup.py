"""Suffix-array dedup: removes every byte of a string of ``length`` bytes that also starts earlier.

One suffix array over all bytes would hold one suffix for each byte. Here suffixes start at anchors only: in
each window of ``length`` bytes, the leftmost of its ``GRAM``-byte strings of smallest hash. Equal windows have
their anchor at the same place, and neighbouring windows share theirs, so an anchor stands for a run of windows,
and a suffix reads as tokens: its gram, the bytes under its run of windows, its document and place.

1. Suffixes are range-partitioned by leading tokens at sampled splitters and sorted in each bucket by multikey
   quicksort; runs that repeat an earlier one in full are found by comparing neighbours.
2. Where a gram repeats under different runs, or its suffixes touch the border of a bucket, the first suffix of
   each run is compared window by window with all such, which settles partial matches and those across borders.

Both steps compare 64-bit tokens from two independent hashes: 128 bits together.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.packed import BUCKET_SCHEMA, PIECE, bucketed, buffers, deal, held_until_full, mixed, multikey_order, range_hash, unpack
from ledgerloom.llm.shared import bounded_batches, lean, saved

#: Bytes of an anchor's gram; suffixes of a bucket aimed at; suffixes that give splitters, from all the table (about),
#: of so many times as many in the documents looked at.
GRAM, BUCKET_ROWS, SAMPLE, LOOKED_AT = 50, 1_000_000, 1 << 16, 8
SUFFIX = ["<u8", "<u8", "<i8", "<i8", "<i8", "<u2"]
SPANS = "doc_id long, text_hash long, lo long, hi long"


def anchors(buf: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, as (first window, last window, gram's token, run's token)."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    one, two = range_hash(1), range_hash(2)
    s1, s2 = one.sums(buf), two.sums(buf)
    grams = one.windows(s1, gram)
    # Places in the low bits, so that the smallest is also the leftmost of equal grams.
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # Windows that cross the end of a document are none.
    step = np.zeros(len(place) + 1, np.int32)
    fit = np.diff(starts) >= length
    np.add.at(step, starts[:-1][fit], 1)
    np.add.at(step, np.minimum(starts[1:][fit] - length + 1, len(place)), -1)
    valid = np.cumsum(step[:-1]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    end = valid.copy()
    end[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
    lo, hi = np.nonzero(new)[0], np.nonzero(end)[0]
    at = place[lo]
    shape = ((at - lo) << 20 | (hi - lo)).astype(np.uint64)
    return lo, hi, grams[at], mixed(two.ranges(s2, lo, hi + length) ^ mixed(shape))


def suffixes(b: pa.RecordBatch, length: int, gram: int) -> Iterator[list[np.ndarray]]:
    """(gram, run, doc_id, text_hash, first window's place in its document, windows - 1) of each anchor."""
    docs, hashes = (pc.fill_null(b.column(c), np.iinfo(np.int64).min if c == "doc_id" else 0).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_hash"))
    for buf, starts, rows in buffers(b):
        # A very long text is cut into overlapping pieces: every window lies in one of them.
        for at in range(0, max(1, len(buf) - length + 1), PIECE * 4):
            part = buf[at : at + PIECE * 4 + length - 1]
            inner = np.unique(np.concatenate([[0, len(part)], starts[(starts > at) & (starts < at + len(part))] - at]))
            lo, hi, t1, t2 = anchors(part, inner, length, gram)
            doc = np.searchsorted(starts, lo + at, side="right") - 1
            yield [t1, t2, docs[rows[doc]], hashes[rows[doc]], lo + at - starts[doc], (hi - lo).astype(np.uint16)]


def splitters(docs: DataFrame, length: int, gram: int, buckets: int, suffixes_in_all: int) -> list[tuple]:
    """Leading tokens that cut the sampled suffixes into equal parts; a frequent gram can be cut several times,
    by run, document and place. About SAMPLE suffixes go to the driver, however large the table: of documents drawn
    by hash, suffixes drawn by hash; all suffixes of a small table."""
    share = min(1.0, SAMPLE / max(1, suffixes_in_all))
    of_docs = min(1.0, LOOKED_AT * share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in suffixes(b, length, gram):
                pick = mixed(c[1] ^ mixed(c[2].view(np.uint64) + c[4].view(np.uint64) * np.uint64(31))) <= np.uint64(share / of_docs * (2**64 - 2**11))
                yield pa.RecordBatch.from_arrays([pa.array(x[pick].view(np.int64)) for x in (*c[:3], c[4])], names=["a", "b", "c", "d"])

    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 20)) < int(np.ceil(of_docs * (1 << 20))))
    got = drawn.mapInArrow(lean(run), "a long, b long, c long, d long").toArrow()
    a, b = (got[x].to_numpy().view(np.uint64) for x in "ab")
    sample = sorted(zip(a.tolist(), b.tolist(), got["c"].to_pylist(), got["d"].to_pylist(), strict=True))
    return [sample[i * len(sample) // buckets] for i in range(1, buckets)] if sample else []


def bucket_of(split: list[tuple], c: list[np.ndarray]) -> np.ndarray:
    """The bucket of each suffix: by its gram alone, but where a splitter has that gram by all tokens."""
    heads = np.array([s[0] for s in split], np.uint64)
    out = np.searchsorted(heads, c[0], side="left")
    if len(heads):
        cut = np.nonzero(heads[np.minimum(out, len(heads) - 1)] == c[0])[0]
        for i in cut.tolist():
            out[i] = bisect_left(split, (int(c[0][i]), int(c[1][i]), int(c[2][i]), int(c[4][i])))
    return out


def spans_found(kind: int, doc, text, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), pa.array(doc), pa.array(text), pa.array(lo), pa.array(hi)], names=["kind", "doc_id", "text_hash", "lo", "hi"])


def repeated_spans(df: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, text_hash and [lo, hi) of bytes to remove, saved: their union is what repeats. df: doc_id, text.

    Order is (doc_id, start), null doc_ids first. Rows of one doc_id and text are one document."""
    spark = df.sparkSession
    bounded_batches(spark)
    gram = max(1, min(GRAM, length // 2))
    docs = df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    suffixes_in_all = 2 * size // (length - gram + 2)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), suffixes_in_all // BUCKET_ROWS + 1)
    split = splitters(docs, length, gram, buckets, suffixes_in_all)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in held_until_full(x for b in batches for x in suffixes(b, length, gram)):
            yield from deal(bucket_of(split, c), c, buckets)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for b in batches for x in b.column("rows").to_pylist()]
        t1, t2, doc, text, lo, more = unpack(blobs, SUFFIX)
        blobs.clear()
        if not len(t1):
            return
        order = multikey_order([t1, t2, doc, lo])
        t1, t2, doc, text, lo, hi = t1[order], t2[order], doc[order], text[order], lo[order], lo[order] + more[order] + length
        first = np.concatenate([[True], (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])])
        head = np.nonzero(first)[0][np.cumsum(first) - 1]
        later = (doc != doc[head]) | (lo != lo[head])
        yield spans_found(0, doc[later], text[later], lo[later], hi[later])
        # Grams under several runs, and those at either border.
        gram_first = np.concatenate([[True], t1[1:] != t1[:-1]])
        group = np.cumsum(gram_first) - 1
        several = np.bincount(group, weights=first) > 1
        several[[0, -1]] = True
        again = ~later & several[group]
        yield spans_found(1, doc[again], text[again], lo[again], hi[again])

    kinds = f"kind int, {SPANS}"
    found = saved(bucketed(docs.mapInArrow(lean(send), BUCKET_SCHEMA), buckets).mapInArrow(lean(sort), kinds), "suffix-runs")

    # The runs in doubt, with their documents' texts.
    doubt = found.filter("kind = 1").groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    ids = F.coalesce("doc_id", F.lit(np.iinfo(np.int64).min))
    unsure = docs.withColumn("doc_id", ids).join(doubt.hint("shuffle_hash"), (F.col("doc_id") == F.col("d")) & (F.col("text_hash") == F.col("h"))).select("doc_id", "text_hash", "text", "runs")

    def windows(b: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        one, two = range_hash(1), range_hash(2)
        docs, hashes = b.column("doc_id").to_numpy(), b.column("text_hash").to_numpy()
        for i, runs in enumerate(b.column("runs").to_pylist()):
            buf = np.frombuffer(b.column("text")[i].as_buffer(), np.uint8)
            for r in runs:
                part = buf[r["lo"] : r["hi"]]
                n = len(part) - length + 1
                w1, w2 = (h.windows(h.sums(part), length) for h in (one, two))
                yield [w1, w2, np.full(n, docs[i]), np.full(n, hashes[i]), r["lo"] + np.arange(n)]

    def firsts(c: list[np.ndarray]) -> np.ndarray:
        """Which rows, sorted by window, document and place, aren't later than an equal window."""
        first = np.concatenate([[True], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])]) if len(c[0]) else np.zeros(0, bool)
        head = np.nonzero(first)[0][np.cumsum(first) - 1]
        return (c[2] == c[2][head]) & (c[4] == c[4][head])

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of equal windows of a task only the first is sent on by its hash, so frequent ones stay few; the
        others are later for certain and go along marked (their first token is 0)."""
        for c in held_until_full(x for b in batches for x in windows(b)):
            order = multikey_order([c[0], c[1], c[2], c[4]])
            c = [x[order] for x in c]
            ok = firsts(c)
            where = (c[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            where[~ok] = (mixed(c[2].view(np.uint64)) % np.uint64(buckets))[~ok]
            c[0], c[1] = np.where(ok, c[0] | np.uint64(1), np.uint64(0)), np.where(ok, c[1], np.uint64(0))
            yield from deal(where.astype(np.int64), c, buckets)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = unpack([x for b in batches for x in b.column("rows").to_pylist()], ["<u8", "<u8", "<i8", "<i8", "<i8"])
        c = [x[order] for order in [multikey_order([c[0], c[1], c[2], c[4]])] for x in c]
        later = (c[0] == 0) | ~firsts(c)
        doc, text, lo = c[2][later], c[3][later], c[4][later]
        order = np.lexsort((lo, text, doc))
        doc, text, lo = doc[order], text[order], lo[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (lo[1:] > lo[:-1] + length)]) if len(doc) else np.zeros(0, bool)
        at = np.nonzero(new)[0]
        ends = np.append(at[1:], len(doc)) - 1 if len(at) else at
        yield spans_found(0, doc[at], text[at], lo[at], lo[ends] + length)

    settled = saved(bucketed(unsure.mapInArrow(lean(send_windows), BUCKET_SCHEMA), buckets).mapInArrow(lean(settle), kinds), "suffix-windows")
    return found.filter("kind = 0").unionByName(settled).select("doc_id", "text_hash", "lo", "hi")


def merged(spans: list, n: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of [lo, hi)."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, min(hi, n)) for lo, hi in out]


def remove_repeats(df: DataFrame, length: int = 100) -> DataFrame:
    """df with kept (the remaining bytes), n_bytes, n_removed, n_spans and whole (the remaining text: bytes of
    characters that a cut would split stay in it), in place of its own columns of these names.

    A null text is empty. Rows of one doc_id and text are one document: they are cut alike and never remove
    each other. Every row stays, also one of which nothing remains."""
    others = [c for c in df.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans", "whole")]
    spans = repeated_spans(df, length).groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.collect_set(F.struct("lo", "hi")).alias("_spans"))
    key = F.coalesce("doc_id", F.lit(np.iinfo(np.int64).min)) == F.col("_d")
    joined = df.select(*others).join(spans.hint("shuffle_hash"), key & (F.xxhash64("text") == F.col("_h")), "left").drop("_d", "_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            text = b.column("text")
            for i, spans in enumerate(b.column("_spans").to_pylist()):
                data = text[i].as_py().encode("utf-8", "surrogatepass") if text[i].is_valid else b""
                cuts = merged([(s["lo"], s["hi"]) for s in spans or []], len(data))
                kept, whole, at, safe = [], [], 0, 0
                for lo, hi in cuts:
                    kept.append(data[at:lo])
                    at = hi
                    while lo < hi and data[lo] & 0xC0 == 0x80:
                        lo += 1
                    while hi < len(data) and hi > lo and data[hi] & 0xC0 == 0x80:
                        hi -= 1
                    whole.append(data[safe:lo])
                    safe = max(lo, hi)
                kept.append(data[at:])
                whole.append(data[safe:])
                for column, value in zip(out, (b"".join(kept), len(data), sum(hi - lo for lo, hi in cuts), len(cuts), b"".join(whole).decode("utf-8", "replace")), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in others] + [pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*others, "kept", "n_bytes", "n_removed", "n_spans", "whole"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in others)
    return joined.mapInArrow(lean(run), f"{fields}, kept binary, n_bytes long, n_removed long, n_spans long, whole string")

