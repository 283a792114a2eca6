"""Tables written on the way: under the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir; only where that is unset, as in tests, in a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
        if spark.conf.isModifiable("spark.checkpoint.dir"):
            spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


#: Parquet's writer for rows of many megabytes: by default it holds a hundred before it looks at their size.
LARGE = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "8", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8"}


def written(df: DataFrame, tag: str, large: bool = False, made: list[str] | None = None) -> DataFrame:
    """df as a table that is written once: reruns of what follows, and lost executors, read the same rows. ``large``:
    its rows are packed batches of many megabytes. ``made`` gets its path, for ``dropped``."""
    path = scratch_path(df.sparkSession, tag)
    if made is not None:
        made.append(path)
    df.write.options(**LARGE if large else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, made: list[str], keep: int = 0) -> None:
    """Deletes tables that nothing reads any more: all paths but the last ``keep``."""
    while len(made) > keep:
        where = spark._jvm.org.apache.hadoop.fs.Path(made.pop(0))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def large_rows(spark: SparkSession) -> Iterator[None]:
    """For tables whose rows are packed batches of many megabytes: a task reads two at once, not thousands, and shuffle
    files go when a query ends; a plan that runs again makes them again."""
    held = {"spark.sql.parquet.columnarReaderBatchSize": "2", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
