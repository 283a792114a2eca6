"""What the operators of this package share: tables, the shared folder, saved intermediate tables."""

from __future__ import annotations

import ctypes
import ctypes.util
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of one batch that goes to a Python worker: texts are long, and executors run several workers.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers (never raises) the session's limits on a batch to BATCH_ROWS and BATCH_BYTES."""
    for name, limit in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= limit:
            spark.conf.set(key, str(limit))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a Python worker that gives freed memory back to the machine when a partition is done: workers
    stay for later stages, several to an executor."""

    def f(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if found := ctypes.util.find_library("c"):
                getattr(ctypes.CDLL(found), "malloc_trim", lambda _: None)(0)

    return f


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset, as in
    local tests, a temporary folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Lists that take the paths of tables while they are saved.
_watching: list[list[str]] = []


@contextmanager
def only(spark: SparkSession, *tags: str) -> Iterator[None]:
    """Deletes the tables saved inside, but for those with one of the tags: what leaves the block must read no
    others."""
    made: list[str] = []
    _watching.append(made)
    try:
        yield
    finally:
        _watching.remove(made)
        for path in made:
            if not any(f"/{tag}-" in path for tag in tags):
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives its shuffle files back when it ends, not when the driver collects its garbage; a plan
    that runs again makes them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """df written as a table of the shared folder and read back: its lineage ends here and a lost executor
    costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    for made in _watching:
        made.append(path)
    with shuffles_dropped(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
