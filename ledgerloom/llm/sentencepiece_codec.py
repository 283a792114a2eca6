"""SentencePiece encoding and decoding by the tokenizers library.

The model file, a protobuf, is parsed here; from it the normaliser, the metaspace marker, the pieces with their
scores (unigram) or merges (BPE, in the order of the scores) and the byte fallback are rebuilt as a tokenizer.
Texts are encoded in batches, in several threads where the machine gives the process more than one. Between
pieces that can't be joined a text is cut into chunks; repeated chunks are looked up. All ids are the rebuilt
tokenizer's. Each chunk that a task sees for the first time is also encoded by the sentencepiece library itself, and
a document tells whether all its chunks agreed (parity). Decoding takes a document's own ids; whether these give its
text again is told by comparison with the text as it came.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from ledgerloom.llm.shared import bounded_batches, lean

MARK = "▁"
#: Fixed values of the model format: kinds of pieces, and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: Distinct chunks whose ids a task keeps before it forgets them all; chunks encoded in one go.
CHUNKS_KEPT, CHUNKS_AT_ONCE = 100_000, 50
THREADS = 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message: integers, or the bytes of anything else."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        """Fields of the public model format, by number; absent ones keep the format's defaults."""
        m = cls()
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                m.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(fields(value))
                m.kind, m.byte_fallback, m.unk_id = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
            elif number == 3:
                spec = dict(fields(value))
                m.charsmap, m.dummy_prefix, m.trim, m.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        return m


def merges(m: PieceModel) -> list[tuple[str, str]]:
    """Pairs of pieces that join, best score of the joined piece first, then by the left piece's id."""
    ids = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = [(-m.pieces[i][1], i, ids[p[:k]], ids[p[k:]], (p[:k], p[k:])) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    return [x[-1] for x in sorted(found)]


def rebuild(m: PieceModel) -> Tokenizer:
    """The tokenizer, without its normaliser."""
    unk = m.pieces[m.unk_id][0]
    if m.kind == BPE:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback)
    elif m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk_id, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"models of kind {m.kind} aren't known")
    return Tokenizer(model)


def normaliser(m: PieceModel) -> normalizers.Normalizer:
    steps: list = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.trim:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def decoder(m: PieceModel, late: bool = False) -> decoders.Decoder:
    """``late``: markers become spaces once in the whole text, not in every piece; the same but for ids that spell
    the marker in single bytes."""
    steps = [decoders.Replace(MARK, " ")] + [decoders.ByteFallback()] * m.byte_fallback + [decoders.Fuse()]
    if late:
        steps = steps[1:] + steps[:1]
    return decoders.Sequence(steps + [decoders.Strip(" ", 1, 0)] * m.dummy_prefix)


class Codec:
    """Encodes and decodes by one model file, on one machine."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:  # a vocabulary of every machine, not data
            self.model = m = PieceModel.parse(f.read())
        self.bare = rebuild(m)
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [p for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED)]
        # Chunks begin at the marker, and stand apart at line ends, if no piece reaches over either.
        marks = all(MARK not in p.lstrip(MARK) for p in normal)
        lines = not any("\n" in p for p in normal)
        self.by_chunks = marks and lines and m.byte_fallback and not m.charsmap and not m.trim and m.dummy_prefix and m.escape and not any(kind == USER_DEFINED for _, _, kind in m.pieces)
        self.chunks = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        self.width = 2 if len(m.pieces) < 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.line = self.own.encode("\n")
        self.newline = self.whole.encode("\n", add_special_tokens=False).ids[-1]
        marker = f"<0x{MARK.encode()[0]:02X}>"
        self.spells = {i for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE and p == marker}
        self.forget()

    @cached_property
    def late(self) -> Tokenizer:
        """For decoding ids that can't spell the marker in bytes."""
        t = rebuild(self.model)
        t.decoder = decoder(self.model, late=True)
        return t

    @cached_property
    def whole(self) -> Tokenizer:
        """With normaliser and decoder, for texts that aren't cut and for decoding."""
        t = rebuild(self.model)
        t.normalizer, t.decoder = normaliser(self.model), decoder(self.model)
        return t

    def forget(self) -> None:
        """Drops the chunks kept so far."""
        self.kept: dict[str, bytes] = {"\n": self.pack([self.newline])} if self.by_chunks else {}
        self.wrong: set[str] = set()

    def pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def encode_chunks(self, new: list[str]) -> dict[str, bytes]:
        """Ids of chunks by the rebuilt tokenizer; those that sentencepiece encodes otherwise are noted."""
        out: dict[str, bytes] = {}
        parts = [new[i : i + CHUNKS_AT_ONCE] for i in range(0, len(new), CHUNKS_AT_ONCE)]
        lines = ["\n".join(p) for p in parts]
        wants = self.own.encode(["\n" + x.replace(MARK, " ") for x in lines], num_threads=1)
        skip, w = len(self.line), self.width
        for part, e, want in zip(parts, self.bare.encode_batch_fast(lines, add_special_tokens=False), wants, strict=True):
            mine = e.ids
            ids = np.asarray(mine, self.dtype)
            # No piece reaches over a line end, so its ids stand between those of the chunks.
            ends = (np.nonzero(ids == self.newline)[0] * w).tolist()
            flat = ids.tobytes()
            out.update(zip(part, [flat[i:j] for i, j in zip([0, *(x + w for x in ends)], [*ends, len(flat)], strict=True)], strict=True))
            if mine != want[skip:]:
                each = self.own.encode(["\n" + c.replace(MARK, " ") for c in part], num_threads=1)
                self.wrong.update(c for c, x in zip(part, each, strict=True) if out[c] != self.pack(x[skip:]))
        return out

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of whole texts, and whether sentencepiece agrees on all of each."""
        if not self.by_chunks:
            got = [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]
            want = self.own.encode(texts, num_threads=1)
            return [self.pack(g) for g in got], [g == w for g, w in zip(got, want, strict=True)]
        cut = [self.chunks.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.kept) > CHUNKS_KEPT:
            self.forget()
        new = list(set().union(*cut).difference(self.kept))
        for lo in range(0, len(new), CHUNKS_KEPT):
            self.kept.update(self.encode_chunks(new[lo : lo + CHUNKS_KEPT]))
        return [b"".join(map(self.kept.__getitem__, cs)) for cs in cut], [not self.wrong or self.wrong.isdisjoint(cs) for cs in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [(self.late if self.spells.isdisjoint(x) else self.whole).decode(x, skip_special_tokens=False) for x in ids]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each model file in a worker, kept between tasks. The library's threads are THREADS unless the
    environment says otherwise: workers share an executor's cores."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def piece_encode(df: DataFrame, model: str, round_trip: bool = False) -> DataFrame:
    """df with ids (int array, the rebuilt tokenizer's), n_tokens and parity (sentencepiece agrees on every chunk), in
    place of its own columns of these names; with ``round_trip`` also whether the ids decode to the text again.

    Whole texts; a null or empty one has no ids; no shuffle; rows stay as they are, repeated ones too."""
    bounded_batches(df.sparkSession)
    made = ["ids", "n_tokens", "parity", *["round_trip"] * round_trip]
    others = [c for c in df.columns if c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        try:
            yield from encoded(c, batches)
        finally:
            c.forget()  # workers stay for other stages

    def encoded(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                texts = [x or "" for x in b.column("text").to_pylist()]
                ids, parity = c.encode(texts)
                n = np.array([len(x) // c.width for x in ids], np.int64)
                flat = np.frombuffer(b"".join(ids), c.dtype).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
                columns = [lists, pa.array(n), pa.array(parity, pa.bool_())]
                if round_trip:
                    back = c.decode([np.frombuffer(x, c.dtype).tolist() for x in ids])
                    columns.append(pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([b.column(x) for x in others] + columns, names=[*others, *made])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in others)
    return df.select(*others).mapInArrow(lean(run), f"{kinds}, ids array<int>, n_tokens long, parity boolean{', round_trip boolean' * round_trip}")


def piece_decode(df: DataFrame, model: str) -> DataFrame:
    """df with its ids decoded as text, in place of a column of that name. Null or no ids: an empty text."""
    others = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                texts = c.decode([x or [] for x in b.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(x) for x in others] + [pa.array(texts, pa.string())], names=[*others, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in others)
    return df.select(*others).mapInArrow(lean(run), f"{kinds}, text string")
