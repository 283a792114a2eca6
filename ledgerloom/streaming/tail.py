"""A stream over files that grow: each file is read on from the byte where the last batch stopped, at whole lines."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads, and that are looked at in one go for a line's end.
SPLIT_BYTES, LOOK_BYTES = 32 << 20, 1 << 20


def opened(path: str):
    """The file system that a path names (local, HDFS, S3, ...) and the path in it; no Spark session is needed, so
    tasks can call it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else FileSystem.from_uri(f"file://{path}")


def last_line_end(fs, path: str, low: int, high: int) -> int:
    """The byte after the last line end in [low, high), or low if there is none: a line that is being written waits."""
    with fs.open_input_file(path) as f:
        while high > low:
            start = max(low, high - LOOK_BYTES)
            if (found := f.read_at(high - start, start).rfind(b"\n")) >= 0:
                return start + found + 1
            high = start
    return low


@dataclass
class Split(InputPartition):
    """The lines of a file that begin in [start, end); stop is where the batch ends in this file."""

    path: str
    start: int
    end: int
    stop: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", ".jsonl")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def files(self) -> dict[str, int]:
        """Present files with their sizes, a growing file alone or those of a folder with the suffix."""
        from pyarrow.fs import FileSelector, FileType

        fs, path = opened(self.path)
        info = fs.get_file_info(path)
        if info.type == FileType.File:
            return {"": info.size}
        found = fs.get_file_info(FileSelector(path, allow_not_found=True))
        return {f.base_name: f.size for f in found if f.type == FileType.File and f.base_name.endswith(self.suffix)}

    def where(self, name: str) -> str:
        return f"{self.path}/{name}" if name else self.path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        # Only what lies behind the newest line end counts; the look goes back no further than a line is long.
        out = {}
        for name, size in self.files().items():
            fs, path = opened(self.where(name))
            out[name] = last_line_end(fs, path, 0, size)
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Splits of what was added. A file shorter than what was read of it isn't a ledger: the stream fails."""
        if shorter := sorted(n for n, low in start.items() if int(low) > int(end.get(n, 0))):
            raise ValueError(f"shorter than what was read, or gone: {', '.join(map(self.where, shorter))}")
        return [
            Split(self.where(name), low, min(low + self.split, stop), stop)
            for name, stop in sorted(end.items())
            for low in range(int(start.get(name, 0)), int(stop), self.split)
        ]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
        fs, path = opened(partition.path)
        name = partition.path.rsplit("/", 1)[-1]
        with fs.open_input_file(path) as raw:
            at = partition.start
            if at:
                # The line that holds the byte before belongs to the split before.
                raw.seek(at - 1)
                at -= 1
            f = io.BufferedReader(raw, LOOK_BYTES)
            if at:
                at += len(f.readline())
            while at < partition.end:
                line = f.readline()
                if not line:
                    return
                if text := line.strip():
                    yield name, at, text.decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        """Nothing is kept beside Spark's own offsets."""


class Tail(DataSource):
    """spark.readStream.format("tail").option("suffix", ".jsonl").load(path): (file, offset, line)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail(spark: SparkSession, path: str, suffix: str = ".jsonl", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, offset, line) of a growing file, or of the growing files of a folder: each line once, also over
    restarts, as offsets are bytes and Spark checkpoints them. Blank lines give no row, a line without its end none
    yet; bytes that aren't UTF-8 become replacement characters. Large additions are read by several tasks."""
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").option("suffix", suffix).option("splitBytes", split_bytes).load(path)


def grow_files(df: DataFrame, path: str, file: str, order: list[str | Column], line: str) -> int:
    """Writes a file for each value of ``file``, its lines in order, and returns how many there are; for ledgers whose
    earlier lines are the same in every call. A file is replaced by a move, so readers see it before or after, and a
    task that runs again writes the same. Lines of a file come to one task, sorted by Spark, and are never all held."""
    fs, root = opened(path)
    fs.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(path)
        now, out, n = None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(f"{root}/.{now}.tmp", f"{root}/{now}")

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != now:
                    close()
                    now, out, n = name, fs.open_output_stream(f"{root}/.{name}.tmp"), n + 1
                out.write(f"{text}\n".encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    ordered = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), file).sortWithinPartitions(file, *order).select(file, line)
    return sum(r.n for r in ordered.mapInArrow(run, "n long").collect())  # one row a task
