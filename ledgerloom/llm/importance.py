"""Importance resampling towards a target distribution, over hashed word n-grams.

Words and their offsets come from an untrained pre-tokeniser of the tokenizers library, a Regex Split, over text whose
A-Z are lower-cased; windows of neighbouring offset pairs are the n-grams, whose CRC-32 picks a bucket. A document
keeps its distinct buckets with their counts. Histograms of all documents and of all target texts give each bucket a
gain; a document's weight is the sum of its features' gains, and seeded Gumbel noise on it draws without replacement.
Only the histogram, as long as there are buckets, passes through the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from ledgerloom.llm.shared import bounded_batches, lean, saved

#: What stands between words: ASCII other than digits and letters (A-Z are lower-cased before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Distinct n-grams whose buckets a task keeps before it forgets them all.
GRAMS_KEPT = 400_000
TEXTS_AT_ONCE = 64


def splitter() -> Tokenizer:
    """Nothing is trained: the model knows no word, only the pre-tokeniser's offsets are read."""
    t = Tokenizer(models.WordLevel({"?": 0}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.Split(Regex(BETWEEN), "removed")
    return t


class Buckets(dict):
    """Bucket of each n-gram."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, gram: str) -> int:
        self[gram] = found = zlib.crc32(gram.encode()) % self.buckets
        return found


def grams(text: str, offsets: list[tuple[int, int]], longest: int) -> list[str]:
    """All runs of 1 to ``longest`` words, joined by one space."""
    words = [text[a:b] for a, b in offsets]
    out = words
    for n in range(2, longest + 1):
        out = out + [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return out


def bucket_counts(df: DataFrame, longest: int, buckets: int) -> DataFrame:
    """df (doc_id, text, _tag) with n_words, n_features and the text's buckets and their counts, as little-endian
    32-bit integers. Null or empty texts have none."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, bucket = splitter(), Buckets(buckets)
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS_AT_ONCE):
                b = batch.slice(lo, TEXTS_AT_ONCE)
                # Bytes' lower() changes A-Z alone.
                texts = [x.encode().lower().decode() if x else "" for x in b.column("text").to_pylist()]
                words, sizes, which, counts = [], [], [], []
                for text, e in zip(texts, split.encode_batch(texts, add_special_tokens=False), strict=True):
                    offsets = e.offsets
                    found = grams(text, offsets, longest)
                    at, n = np.unique(np.fromiter(map(bucket.__getitem__, found), "<u4", len(found)), return_counts=True)
                    words.append(len(offsets))
                    sizes.append(len(found))
                    which.append(at.tobytes())
                    counts.append(n.astype("<u4").tobytes())
                    if len(bucket) > GRAMS_KEPT:
                        bucket.clear()
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_tag"), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(which, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "_tag", "n_words", "n_features", "buckets", "counts"])

    return df.select("doc_id", "_tag", "text").mapInArrow(lean(run), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, _tag long, n_words long, n_features long, buckets binary, counts binary")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All integers of a binary column, and where each row's begin and the last one's end."""
    parts = [x or b"" for x in column.to_pylist()]
    return np.frombuffer(b"".join(parts), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts], dtype=np.int64)])


def histogram(features: DataFrame, buckets: int) -> np.ndarray:
    """Features of all texts by bucket: summed in each task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            at, n = flat(batch.column("buckets"))[0], flat(batch.column("counts"))[0]
            total += np.bincount(at, n, buckets).astype(np.int64)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in features.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural logarithm of the smoothed ratio of both distributions, rounded down."""
    s_all, t_all, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: Column, seed: str) -> Column:
    """Seeded noise of each document, in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296))).cast("long")


def weighted(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, _tag, n_words, n_features and weight, the sum of the gains of all features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ends = flat(batch.column("buckets"))
            sums = np.concatenate([[0], np.cumsum(gains[at] * flat(batch.column("counts"))[0].astype(np.int64))])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "_tag", "n_words", "n_features")] + [pa.array(np.diff(sums[ends]), pa.int64())], names=["doc_id", "_tag", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, _tag long, n_words long, n_features long, weight long")


def importance_draw(df: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, min_words: int = 20, seed: str = "2024") -> DataFrame:
    """Every row of df (doc_id, text) with n_features, weight, score, and the rank of the rows that are drawn: of the
    N with ``min_words`` words, floor(percent * N / 100) highest scores, ties to the smaller doc_id. target has a
    column text.

    Null or empty texts have no features and weight 0. Rows that repeat are documents of their own; of equal ones any
    may be drawn. A null doc_id is seeded as ``null`` and comes last among ties. Other columns don't matter. Empty
    tables give no rows, or, as target, gains from the smoothing alone.

    Ranks come from one range shuffle of narrow rows, so no task orders more than its range; rows that can't be drawn
    follow in the same order. The driver gets one row a bucket and one a range."""
    spark = df.sparkSession
    features = saved(bucket_counts(df.select("doc_id", "text", F.monotonically_increasing_id().alias("_tag")), longest, buckets), "bucket-counts", "zstd")
    goal = bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("_tag")), longest, buckets)
    gains = bucket_gains(histogram(features, buckets), histogram(goal, buckets))
    scored = weighted(features, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("unfit", F.col("n_words") < min_words)
    order = [F.col("unfit"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_tag")]
    # The id of a sorted row holds its partition and its place there.
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = saved(placed.drop("n_words"), "importance-order").withColumn("_range", F.shiftright("_at", 33))
    ranges = sorted(map(tuple, placed.groupBy("_range").agg(F.count("*"), F.count_if(~F.col("unfit"))).collect()))
    starts = np.concatenate([[0], np.cumsum([n for _, n, _ in ranges])]).tolist()
    draws = percent * sum(fit for _, _, fit in ranges) // 100
    before = spark.createDataFrame([(r, s) for (r, _, _), s in zip(ranges, starts, strict=False)], "_range long, _start long")
    rank = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(before), "_range").select("doc_id", "n_features", "weight", "score", F.when(~F.col("unfit") & (rank <= draws), rank).alias("rank"))
