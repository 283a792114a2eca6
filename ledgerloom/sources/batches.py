"""Limits on what goes to a Python worker at once."""

from __future__ import annotations

import ctypes
import ctypes.util
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of a batch: texts and lists are long, and an executor runs several workers.
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
