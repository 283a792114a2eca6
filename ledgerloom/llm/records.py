"""Token-ID output as length-delimited binary records, with an offset index beside each file.

A record is: length of the data (u64), masked checksum of those 8 bytes (u32), data, masked checksum of the data
(u32); all little-endian. Its data is the bytes of a token id (2 or 4; plus 16 where the document has no id), the
id (i64) and the token ids. Checksums are zlib's CRC-32, rotated right by 15 bits plus a constant, so that a checksum stored in
data isn't mistaken for one of its own. The index holds (offset of the record u64, tokens u64) for each record,
so single records can be read in any order. Files are written under the shared folder by the tasks themselves,
under a name of the attempt, and renamed when complete: a task that runs again replaces its own file only.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from ledgerloom.llm.shared import bounded_batches, lean, only, saved, scratch, shuffles_dropped

MASK = 0xA282EAD8
HEAD, TAIL, INDEX = "<QI", "<I", "<QQ"
#: Distinct words whose ids a worker keeps; later ones are encoded each time. Words encoded in one go.
WORDS_KEPT, WORDS_AT_ONCE = 400_000, 200
#: The split pattern that word_encoder knows: letters, single digits, other signs, and English endings.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of token ids aimed at in a file.
FILE_BYTES = 32 << 20
#: Texts for which splitting by words ahead of the tokenizer gives the same ids, if their lower case is such a text
#: too: no character that its normaliser would compose or whose lower case depends on its neighbours or is longer.
PLAIN_END = 0x300
PLAIN = re.compile(r"[\x00-\u012f\u0131-\u02ff]*")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return b"".join((size, struct.pack(TAIL, masked(size)), data, struct.pack(TAIL, masked(data))))


def read_record(stream, offset: int | None = None) -> bytes | None:
    """The record at ``offset``, or the next; None at the end. Raises ValueError on a wrong checksum."""
    if offset is not None:
        stream.seek(offset)
    head = stream.read(struct.calcsize(HEAD))
    if not head:
        return None
    size, crc = struct.unpack(HEAD, head)
    data = stream.read(size)
    if crc != masked(head[:8]) or len(data) != size or struct.unpack(TAIL, stream.read(4))[0] != masked(data):
        raise ValueError(f"damaged record of {size} bytes")
    return data


def plain_pattern(pattern: str) -> re.Pattern:
    """The pattern for plain texts: its properties, which stand in brackets, written as characters."""
    chars = [chr(c) for c in range(PLAIN_END)]
    for prop in (r"\p{L}", r"\p{N}", r"\s"):
        pattern = pattern.replace(prop, re.escape("".join(c for c in chars if regex.match(prop, c))))
    return re.compile(pattern)


def byte_letters() -> dict[int, str]:
    """For ``str.translate``: what the byte-level step makes of the characters of plain texts, spaces left alone."""
    same = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    letter = [chr(b if b in same else next(other)) for b in range(256)]
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(PLAIN_END) if c != 32}


#: The words a worker has encoded so far, for each tokenizer file; kept between tasks.
_kept: dict[tuple[str, str], dict[str, bytes]] = {}


def word_encoder(path: str, end_id: int) -> tuple[Callable[[list[str | None]], list[bytes]], int]:
    """Texts to token ids by the tokenizers file at ``path``, ``end_id`` after each, and the bytes of an id.

    Where the file splits by PATTERN and ends words by a suffix, each distinct word goes through the library's
    model once and repeats are looked up. A text for which that might differ goes through the library whole, as
    do all texts where the file splits or normalises in another way."""
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    tok = Tokenizer.from_file(path)
    spec, vocab = json.loads(tok.to_str()), tok.get_vocab()
    width = 2 if max(end_id, *vocab.values()) < 1 << 16 else 4
    dtype = f"<u{width}"
    suffix = spec["model"].get("end_of_word_suffix")
    split, norm = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}]), (spec["normalizer"] or {}).get("normalizers", [])
    by_words = bool(suffix) and [n["type"] for n in norm] == ["NFC", "Replace", "Lowercase"] and norm[1]["pattern"] == {"Regex": r"\s+"} and norm[1]["content"] == " "
    by_words = by_words and len(split) == 2 and split[0].get("type") == "Split" and split[0]["pattern"] == {"Regex": PATTERN} and split[0]["behavior"] == "Removed" and split[0]["invert"]
    by_words = by_words and split[1]["type"] == "ByteLevel" and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
    words, special = plain_pattern(PATTERN), re.compile("|".join(map(re.escape, (t["content"] for t in spec["added_tokens"]))) or r"(?!)")
    bare = Tokenizer(tok.model)
    bare.pre_tokenizer, letters = pre_tokenizers.WhitespaceSplit(), byte_letters()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
    kept, end = _kept.setdefault((path, dtype), {}), np.array([end_id], dtype).tobytes()

    def encode_words(new: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        parts = [new[i : i + WORDS_AT_ONCE] for i in range(0, len(new), WORDS_AT_ONCE)]
        for part, e in zip(parts, bare.encode_batch_fast([" ".join(p).translate(letters) for p in parts], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, np.int64)
            cuts = np.nonzero(ends[ids])[0] + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                data, at = ids.astype(dtype).tobytes(), [0, *(cuts * width).tolist()]
                out.update((w, data[i:j]) for w, i, j in zip(part, at[:-1], at[1:], strict=True))
            else:  # a word that has no token with the suffix
                out.update((w, np.asarray(x.ids, dtype).tobytes()) for w, x in zip(part, tok.encode_batch(part, add_special_tokens=False), strict=True))
        return out

    def encode(texts: list[str | None]) -> list[bytes]:
        out: list[bytes | tuple[list[str], list[bytes | None]]] = []
        new: set[str] = set()
        for text in texts:
            text = text or ""
            low = text.lower()
            plain = by_words and (text.isascii() or PLAIN.fullmatch(text) and PLAIN.fullmatch(low)) and not special.search(text)
            if not plain:
                out.append(np.asarray(tok.encode(text, add_special_tokens=False).ids, dtype).tobytes())
                continue
            found = words.findall(low)
            known = list(map(kept.get, found))
            if None in known:
                new.update(w for w, ids in zip(found, known, strict=True) if ids is None)
            out.append((found, known))
        fresh = encode_words(list(new)) if new else {}
        kept.update(islice(fresh.items(), max(0, WORDS_KEPT - len(kept))))

        def joined(found: list[str], known: list[bytes | None]) -> bytes:
            return b"".join([fresh[w] if ids is None else ids for w, ids in zip(found, known, strict=True)] if None in known else known)

        return [(x if isinstance(x, bytes) else joined(*x)) + end for x in out]

    return encode, width


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_records(df: DataFrame, encoder: Callable[[], tuple[Callable[[list[str | None]], list[bytes]], int]], files: int | None = None, out: str | None = None) -> tuple[str, list]:
    """Writes df (doc_id, text) in ascending doc_id order (null first, then by text) as record files
    with indexes and returns their folder and a row (file, records, tokens) for each, in order. Texts are encoded
    where they are read; only ids are shuffled (and the texts of documents that share a doc_id, for their order), to ``files`` files, or as many as give FILE_BYTES each. The driver
    sees one row a file, never one a document. ``out``: a URI that all executors can write to."""
    spark = df.sparkSession
    bounded_batches(spark)
    out = out or scratch(spark, "records")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = encoder()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary()), part.column("tie")], names=["doc_id", "width", "ids", "tie"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, folder = filesystem(out)
        fs.create_dir(folder, recursive=True)
        name, mine = f"part-{task.partitionId():06d}", f"_{task.partitionId()}-{task.taskAttemptId()}"
        records, tokens, at = 0, 0, 0
        with fs.open_output_stream(f"{folder}/{mine}.rec", buffer_size=1 << 20) as data, fs.open_output_stream(f"{folder}/{mine}.idx", buffer_size=1 << 16) as index:
            for b in batches:
                for doc, width, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "width", "ids")), strict=True):
                    record = frame(struct.pack("<bq", width + 16 * (doc is None), doc or 0) + ids)
                    index.write(struct.pack(INDEX, at, len(ids) // width))
                    data.write(record)
                    records, tokens, at = records + 1, tokens + len(ids) // width, at + len(record)
        for end in (".idx", ".rec"):
            fs.move(f"{folder}/{mine}{end}", f"{folder}/{name}{end}")
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [records], "tokens": [tokens]})

    docs, tie = df.select("doc_id", "text"), F.lit(None).cast("string")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("doc_id").alias("twin"))
    if not again.isEmpty():
        docs, tie = docs.join(again, F.col("doc_id").eqNullSafe(F.col("twin")), "left"), F.when(F.col("twin").isNotNull() | F.col("doc_id").isNull(), F.col("text"))
    coded = saved(docs.select("doc_id", "text", tie.alias("tie")).mapInArrow(lean(code), "doc_id long, width int, ids binary, tie string"), "token-ids", compression="zstd")
    files = files or int((coded.agg(F.sum(F.length("ids"))).first()[0] or 0) // FILE_BYTES) + 1
    dealt = coded.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    with shuffles_dropped(spark):
        return out, sorted(dealt.mapInArrow(lean(run), "file string, records long, tokens long").collect(), key=lambda r: r.file)


def read_documents(spark: SparkSession, folder: str, written: list) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of each record of the files."""
    before, rows = 0, []
    for r in written:
        rows.append((r.file, r.records, before))
        before += r.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for b in batches:
            for r in b.to_pylist():
                with fs.open_input_file(f"{path}/{r['file']}.idx") as index:
                    entries = np.frombuffer(index.read(), "<u8").reshape(-1, 2)
                if len(entries) != r["records"]:
                    raise ValueError(f"{r['file']}: {len(entries)} index entries for {r['records']} records")
                start = r["start"]
                with fs.open_input_stream(f"{path}/{r['file']}.rec", buffer_size=1 << 20) as data:
                    for lo in range(0, len(entries), 4096):
                        docs, starts, counts, sums = [], [], [], []
                        for n in entries[lo : lo + 4096, 1].tolist():
                            record = read_record(data)
                            kind, doc = struct.unpack_from("<bq", record)
                            ids = np.frombuffer(record, f"<u{kind & 15}", offset=9)
                            if len(ids) != n:
                                raise ValueError(f"{r['file']}: a record isn't the one of its index entry")
                            docs.append(None if kind & 16 else doc)
                            starts.append(start)
                            counts.append(n)
                            sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                            start += n
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(rows, "file string, records long, start long").repartition(max(1, len(rows)))
    return table.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(df: DataFrame, tokenizer: str, end_id: int, files: int | None = None) -> DataFrame:
    """Encodes the whole texts of df (doc_id, text) with the tokenizers file ``tokenizer``, ``end_id`` after
    each, writes them as records and returns what the files hold.

    A null text is empty: only the end id. A null doc_id comes first. Rows that repeat, and rows of one doc_id,
    are records of their own, by text. Other columns are left out."""
    with only(df.sparkSession):
        folder, written = write_records(df, lambda: word_encoder(tokenizer, end_id), files)
    return read_documents(df.sparkSession, folder, written)
