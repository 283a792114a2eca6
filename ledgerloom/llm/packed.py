"""Rows dealt to buckets as packed columns, and hashes of byte ranges: what the suffix and shingle operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of columns that a task holds before it sends them out; bytes of text hashed at once.
FLUSH_BYTES, PIECE = 16 << 20, 1 << 18
BUCKET_SCHEMA = "bucket int, rows binary"


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that lets every bit of h reach every other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RangeHash:
    """Hashes of any byte range of a buffer in constant time: running sums of byte values times powers."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**63)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.powers = self.backs = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, PIECE + 4096)
            for name, base in (("powers", self.base), ("backs", self.inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, buf: np.ndarray) -> np.ndarray:
        self.grow(len(buf) + 1)
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.values[buf] * self.powers[: len(buf)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((sums[hi] - sums[lo]) * self.backs[lo])

    def windows(self, sums: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n bytes from each place."""
        return mixed((sums[n:] - sums[:-n]) * self.backs[: len(sums) - n])


_hashes: dict[int, RangeHash] = {}


def range_hash(seed: int) -> RangeHash:
    """One for each seed in a worker; its tables are kept."""
    return _hashes.setdefault(seed, RangeHash(seed))


def pack(columns: list[np.ndarray], kind: int = 0) -> bytes:
    """Columns of equal length, byte planes of each together, so that what varies little compresses well. The
    first byte tells the kind of rows."""
    n = len(columns[0])
    return b"".join([bytes([kind]), n.to_bytes(8, "little"), *(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T).tobytes() if n else b"" for c in columns)])


def unpack(blobs: list[bytes], dtypes: list[str]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for blob in blobs:
        n, at = int.from_bytes(blob[1:9], "little"), 9
        for k, d in enumerate(dtypes):
            size = n * np.dtype(d).itemsize
            parts[k].append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, size, at).reshape(-1, n).T).reshape(-1).view(d) if n else np.zeros(0, d))
            at += size
    return [np.concatenate(p) if p else np.zeros(0, d) for p, d in zip(parts, dtypes, strict=True)]


def deal(bucket: np.ndarray, columns: list[np.ndarray], buckets: int, kind: int = 0) -> Iterator[pa.RecordBatch]:
    """One packed row for each bucket that has rows; within it, rows stay in their order."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets), side="right")
    ids, blobs, lo = [], [], 0
    for b, hi in enumerate(ends.tolist()):
        if hi > lo:
            ids.append(b)
            blobs.append(pack([c[order[lo:hi]] for c in columns], kind))
            lo = hi
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "rows"])


def held_until_full(parts: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Columns put together until they take FLUSH_BYTES."""
    held, n = [], 0
    for columns in parts:
        held.append(columns)
        n += sum(x.nbytes for x in columns)
        if n >= FLUSH_BYTES:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """Each bucket becomes one partition."""
    return df.repartitionById(buckets, "bucket")


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order by the first key, by the second only among rows whose first is equal, and so on."""
    order = np.argsort(keys[0], kind="quicksort")
    run = np.cumsum(np.concatenate([[False], keys[0][order][1:] != keys[0][order][:-1]])) if len(order) else order
    for key in keys[1:]:
        tied = np.concatenate([run[1:] == run[:-1], [False]]) if len(run) else np.zeros(0, bool)
        tied[1:] |= tied[:-1].copy()
        at = np.nonzero(tied)[0]
        if not len(at):
            break
        order[at] = order[at][np.lexsort((key[order[at]], run[at]))]
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (key[order][1:] != key[order][:-1])])
        run = np.cumsum(new)
    return order


def buffers(b: pa.RecordBatch, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The texts of a batch as (bytes, starts, rows): whole texts put together up to about ``piece`` bytes; a
    longer text stands alone. ``starts`` has one more entry than ``rows``. A null text is empty."""
    text = pc.fill_null(b.column("text"), "").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + piece, side="right")) - 1)
        yield data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], np.arange(lo, hi)
        lo = hi
