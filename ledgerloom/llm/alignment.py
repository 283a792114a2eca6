"""Alignment of two tokenizers over the bytes of each text, with document counts of the linked id pairs.

Texts are cut where neither tokenizer can reach over; each distinct chunk is encoded and aligned once a task, all new
chunks of a batch together: the ends that both sides share cut groups, and tokens whose byte ranges overlap are linked.
An array made once maps each id of A to the id of B with the same bytes. Links that it foresees are counted in a vector
as long as A's vocabulary; only other pairs are shuffled, one row for each block of documents, so no pair has more rows
than there are blocks. Their counts come back to the blocks, where documents add up their links.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from ledgerloom.llm.sentencepiece_codec import MARK, codec
from ledgerloom.llm.shared import bounded_batches, lean, saved

#: Documents of a block at most (its text is bounded by the batch's bytes), and distinct chunks that a task keeps.
BLOCK_ROWS, CHUNKS_KEPT = 1000, 250_000
#: A chunk ends where white space of these kinds follows anything that isn't white space.
CHUNK = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*|\s+")
#: Chunks of this form are encoded so many at once.
WORD, TOGETHER = re.compile(r" \S+"), 50
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of byte-level vocabularies: printable ones stand for themselves, the others follow from
    U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def joined(counts: np.ndarray) -> np.ndarray:
    """Where lists of these lengths begin, and where the last ends."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers of all ranges of these starts and lengths."""
    return np.repeat(starts - joined(counts)[:-1], counts) + np.arange(int(counts.sum()))


class Aligner:
    """Both tokenizers on one machine, with the chunks aligned so far."""

    def __init__(self, path_a: str, path_b: str):
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.piece = codec(path_b)
        self.b = self.piece.own
        alphabet, n = byte_alphabet(), self.a.get_vocab_size()
        self.bytes_a = [b""] * n
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else token.encode()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(MARK, " ").encode() for i in range(self.b.get_piece_size())]
        self.n_a, self.n_b = n, len(self.bytes_b)
        self.len_a, self.len_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # Ids as text with what may follow them: A's , and |, B's , and ; and a chunk's end.
        self.say = [f"{i}{end}" for n, ends in ((self.n_a, ",|"), (self.n_b, ",;\n")) for end in ends for i in range(n)]
        # Of pieces with the same bytes, one that isn't a single byte's.
        same: dict[bytes, int] = {}
        for i in sorted(range(self.n_b), key=lambda i: (self.b.is_byte(i), i)):
            if not self.b.is_control(i) and not self.b.is_unknown(i):
                same.setdefault(self.bytes_b[i], i)
        self.same = np.array([same.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)
        with open(path_a) as f:
            first = json.load(f)
        plain = first.get("normalizer") is None and {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items() <= (first.get("pre_tokenizer") or {}).items()
        lines = self.a.encode("\n", add_special_tokens=False).ids
        self.by_chunks = plain and self.piece.by_chunks and len(lines) == 1
        self.line_a = lines[0] if self.by_chunks else -1
        self.skip = len(self.piece.line)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.said: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)
        self.good = np.zeros(0, bool)
        self.codes, self.times, self.ends = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        return CHUNK.findall(" " + text) if self.by_chunks else [" " + text]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        if not self.by_chunks:
            return self.b.encode([c[1:] for c in texts], num_threads=1)
        # A line end is a piece of its own, so what follows is encoded as it is, without the space put before a text.
        return [x[self.skip :] for x in self.b.encode(["\n" + c for c in texts], num_threads=1)]

    def encode(self, chunks: list[str], together: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For either side, the ids of all chunks in a row and how many each has. Chunks that are one space and a word
        may go together, with a line end between them that is a token of its own on both sides."""
        lines = ["\n".join(chunks[i : i + together]) for i in range(0, len(chunks), together)]
        out = []
        for lists, line_end in (([e.ids for e in self.a.encode_batch_fast(lines, add_special_tokens=False)], self.line_a), (self.encode_b(lines), self.piece.newline)):
            if together == 1:
                out.append((np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))))
                continue
            ids = np.fromiter(chain.from_iterable(chain(x, (line_end,)) for x in lists), np.int64)
            ends = np.nonzero(ids == line_end)[0]
            out.append((ids[ids != line_end], np.diff(ends, prepend=-1) - 1))
        return out

    def spelt(self, sides: list[tuple[np.ndarray, np.ndarray]], chunks: list[str]) -> np.ndarray:
        """Whether the bytes of both sides' tokens are each chunk's."""
        want = [c.encode() for c in chunks]
        ends, whole, good = joined(np.fromiter(map(len, want), np.int64, len(want))), b"".join(want), np.ones(len(want), bool)
        for (ids, counts), table, lengths in zip(sides, (self.bytes_a, self.bytes_b), (self.len_a, self.len_b), strict=True):
            at, got = joined(lengths[ids])[joined(counts)], b"".join(map(table.__getitem__, ids.tolist()))
            if got != whole or (at != ends).any():
                at = at.tolist()
                good &= np.array([got[i:j] == w for i, j, w in zip(at, at[1:], want, strict=False)], bool)
        return good

    def learn(self, new: list[str]) -> None:
        """Encodes and aligns chunks; those whose tokens don't spell them are noted as bad."""
        simple = [c for c in new if WORD.fullmatch(c)] if self.by_chunks else []
        for chunks, together in ((simple, TOGETHER), (sorted(set(new).difference(simple)), 1)):
            if chunks:
                self.learn_alike(chunks, together)

    def learn_alike(self, new: list[str], together: int) -> None:
        (a, count_a), (b, count_b) = sides = self.encode(new, together)
        good = self.spelt(sides, new)
        if not good.all():
            a, b, count_a, count_b = a[np.repeat(good, count_a)], b[np.repeat(good, count_b)], count_a * good, count_b * good
        # All chunks' bytes in a row: a chunk's end is an end on both sides.
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        cut_a, cut_b = np.searchsorted(end_a, shared) + 1, np.searchsorted(end_b, shared) + 1
        chunk_of_a = np.repeat(np.arange(len(new)), count_a)
        chunk_of_group = chunk_of_a[cut_a - 1]
        n_groups = np.bincount(chunk_of_group, minlength=len(new))
        # Tokens of B that overlap each token of A.
        low = np.searchsorted(end_b, end_a - self.len_a[a], "right")
        many = np.searchsorted(end_b, end_a, "left") + 1 - low
        code = np.repeat(a, many) * self.n_b + b[spread(low, many)]
        chunk = np.repeat(chunk_of_a, many)
        n_links = np.bincount(chunk, minlength=len(new))
        whole = self.n_a * self.n_b
        pair, times = np.unique(chunk * whole + code, return_counts=True)
        # Groups as text: A's tokens of a group, then B's, each with what follows it.
        say = np.empty(len(a) + len(b), np.int64)
        follow_a, follow_b = np.zeros(len(a), np.int64), np.full(len(b), 2)
        follow_a[cut_a - 1], follow_b[cut_b - 1] = 1, 3
        follow_b[cut_b[np.cumsum(n_groups)[n_groups > 0] - 1] - 1] = 4
        say[np.arange(len(a)) + np.concatenate([[0], cut_b])[np.searchsorted(shared, end_a)]] = np.where(follow_a, self.n_a, 0) + a
        say[np.arange(len(b)) + cut_a[np.searchsorted(shared, end_b)]] = 2 * self.n_a + (follow_b - 2) * self.n_b + b
        said = iter("".join(map(self.say.__getitem__, say.tolist())).split("\n"))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.said += [next(said) if n else "" for n in n_groups.tolist()]
        self.sizes = np.concatenate([self.sizes, np.stack([count_a, count_b, n_groups, n_links], 1)])
        self.good = np.concatenate([self.good, good])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.bincount(pair // whole, minlength=len(new)))])
        self.codes, self.times = np.concatenate([self.codes, pair % whole]), np.concatenate([self.times, times])

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text: token, group and link counts and the hash of its groups; then all (text, pair, times)."""
        cut = [self.cut(t) for t in texts]
        if len(self.place) > CHUNKS_KEPT:
            self.forget()
        new = list(set().union(*cut).difference(self.place))
        for lo in range(0, len(new), 20_000):
            self.learn(new[lo : lo + 20_000])
        ids = [list(map(self.place.__getitem__, c)) for c in cut]
        if not self.good.all():
            ids = [x if self.good[x].all() else [] for x in ids]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, text = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), np.repeat(np.arange(len(ids)), n)
        sizes = np.stack([np.bincount(text, self.sizes[flat, k], len(ids)) for k in range(4)], 1).astype(np.int64)
        hashes = [sha256(";".join(map(self.said.__getitem__, x)).encode()).hexdigest() if x else "" for x in ids]
        # Chunks that repeat within a text, then pairs that repeat within it.
        span = max(1, len(self.place))
        seen, often = np.unique(text * span + flat, return_counts=True)
        text, flat = seen // span, seen % span
        many = self.ends[flat + 1] - self.ends[flat]
        at = spread(self.ends[flat], many)
        whole = self.n_a * self.n_b
        pair, inverse = np.unique(np.repeat(text, many) * whole + self.codes[at], return_inverse=True)
        times = np.bincount(inverse, np.repeat(often, many) * self.times[at], len(pair)).astype(np.int64)
        return sizes, hashes, pair // whole, pair % whole, times


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each pair of vocabularies in a worker, kept between tasks without its chunks."""
    key = (path_a, path_b)
    if key not in _aligners:
        _aligners[key] = Aligner(path_a, path_b)
    return _aligners[key]


BLOCK = (
    "block long, docs array<{id}>, sizes binary, hashes array<string>, ends binary, local binary, times binary, "
    "pairs array<long>, pair_docs array<long>, ident array<long>, ident_docs array<long>"
)


def aligned_blocks(df: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each block of documents, with its documents' links and the distinct irregular pairs in it, and at the
    end of each partition a row without block that holds its vector of foreseen pairs."""
    kind = df.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = aligner(path_a, path_b)
        w.forget()
        task, number, vector = TaskContext.get().partitionId(), 0, np.zeros(w.n_a, np.int64)
        types = [pa.int64(), pa.list_(pa.int64() if isinstance(kind, LongType) else None), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 4]
        names = [x.split()[0] for x in BLOCK.split(", ")]

        def row(**values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([values.get(n)], t) for n, t in zip(names, types, strict=True)], names=names)

        try:
            for batch in batches:
                types[1] = pa.list_(batch.column("doc_id").type)
                for lo in range(0, batch.num_rows, BLOCK_ROWS):
                    b = batch.slice(lo, BLOCK_ROWS)
                    sizes, hashes, text, code, times = w.align([x or "" for x in b.column("text").to_pylist()])
                    a = code // w.n_b
                    foreseen = w.same[a] == code % w.n_b
                    vector += np.bincount(a[foreseen], minlength=w.n_a)
                    pairs, at, docs = np.unique(code[~foreseen], return_inverse=True, return_counts=True)
                    local = a.copy()
                    local[~foreseen] = w.n_a + at
                    ends = joined(np.bincount(text, minlength=len(hashes)))
                    yield row(
                        block=(task << 32) + number, docs=b.column("doc_id").to_pylist(), sizes=sizes.astype("<i8").tobytes(), hashes=hashes, ends=ends.astype("<i8").tobytes(),
                        local=local.astype("<u4").tobytes(), times=times.astype("<u4").tobytes(), pairs=pairs.tolist(), pair_docs=docs.tolist(),
                    )
                    number += 1
            at = np.nonzero(vector)[0]
            yield row(ident=at.tolist(), ident_docs=vector[at].tolist())
        finally:
            w.forget()  # workers stay for other stages

    return df.select("doc_id", "text").mapInArrow(lean(run), BLOCK.format(id=kind.simpleString()))


def align_tokenizers(df: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each row of df (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    path_a names a byte-level BPE of the tokenizers library, path_b a SentencePiece model; both read a space and the
    text. A pair's count is the number of documents (rows) that hold it linked; n_best are the links whose count is the
    highest of their A id, ties included, and count_sum adds up the counts of all links. Texts that are null, empty, or
    that the tokens of either side don't spell byte by byte have no tokens: zeros and an empty hash. Rows that repeat
    count as documents of their own; other columns don't matter; an empty table gives no rows.

    The driver gets two vectors as long as A's vocabulary."""
    spark = df.sparkSession
    bounded_batches(spark)
    blocks = saved(aligned_blocks(df, path_a, path_b), "aligned-blocks", "zstd")
    w = aligner(path_a, path_b)
    n_a, n_b = w.n_a, w.n_b
    foreseen, best = np.zeros(n_a, np.int64), np.zeros(n_a, np.int64)
    held = blocks.select(F.explode(F.arrays_zip("ident", "ident_docs")).alias("x"))
    for a, n in held.groupBy("x.ident").agg(F.sum("x.ident_docs")).collect():
        foreseen[a] = best[a] = n
    pairs = blocks.filter("block is not null").select("block", F.posexplode(F.arrays_zip("pairs", "pair_docs")).alias("at", "x")).select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.pair_docs").alias("docs"))
    counts = saved(pairs.groupBy("pair").agg(F.sum("docs").alias("n")), "pair-counts")
    for a, n in counts.groupBy(F.floor(F.col("pair") / F.lit(n_b)).alias("a")).agg(F.max("n")).collect():
        best[a] = max(best[a], n)
    back = pairs.select("block", "at", "pair").join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "n")).alias("found"))
    back = back.select("block", F.col("found.at").alias("found_at"), F.col("found.n").alias("found_n"))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind).astype(np.int64)  # noqa: B023, E731
                listed = lambda name: batch.column(name)[i].values  # noqa: B023, E731
                sizes, ends, local, times = of("sizes", "<i8").reshape(-1, 4), of("ends", "<i8"), of("local", "<u4"), of("times", "<u4")
                pairs = listed("pairs").to_numpy()
                n = np.zeros(len(pairs), np.int64)
                if batch.column("found_at")[i].is_valid:
                    n[listed("found_at").to_numpy()] = listed("found_n").to_numpy()
                a = np.where(local < n_a, local, 0)
                own = local >= n_a
                count = foreseen[a]
                count[own], a[own] = n[local[own] - n_a], pairs[local[own] - n_a] // n_b
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * (count == best[a]), times * count)]
                columns = [*sizes.T, *[np.diff(s[ends]) for s in sums]]
                yield pa.RecordBatch.from_arrays([listed("docs"), *[pa.array(c, pa.int64()) for c in columns], listed("hashes")], names=["doc_id", *COLUMNS, "groups_sha256"])

    whole = blocks.filter("block is not null").drop("pair_docs", "ident", "ident_docs").join(back, "block", "left")
    return whole.mapInArrow(lean(run), f"doc_id {kind}, {', '.join(f'{c} long' for c in COLUMNS)}, groups_sha256 string")
