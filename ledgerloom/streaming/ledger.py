"""Incremental ledgers with Structured Streaming: running status, resumption, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerloom.functions.expressions import uniform


def ledger_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_status(rows: DataFrame, by: list[str], ok: Column) -> DataFrame:
    """Good and failed rows so far, by key."""
    return rows.groupBy(*by).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"))


def remaining_time(status: DataFrame, expected: int, elapsed_s: float) -> DataFrame:
    """Seconds left at each key's own rate; the slowest decides for all."""
    left = F.greatest(F.lit(0), expected - F.col("ok"))
    out = status.withColumn("eta_s", F.try_divide(left * F.lit(elapsed_s), F.col("ok")))
    return out.agg(F.max("eta_s").alias("eta_s"), F.sum("ok").alias("ok"), F.sum("errors").alias("errors"))


def windows(rows: DataFrame, ts: str, length: str, late: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; rows later than ``late`` behind the newest are dropped. A timestamp
    without zone is read as UTC (the session's zone), as watermarks need one."""
    at = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return at.groupBy(F.window(ts, length, slide) if slide else F.window(ts, length), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(rows: DataFrame, ts: str, gap: str, late: str, by: list[str]) -> DataFrame:
    at = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return at.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def attempts(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of a tail of JSON lines, with the file and the byte where each began; lines that don't parse are left
    out, as a writer that died leaves such."""
    row = F.from_json("line", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = lines.select("file", "offset", row.alias("r")).filter(F.col("r").isNotNull() & F.col("r._corrupt_record").isNull())
    return parsed.select("file", "offset", "r.*").drop("_corrupt_record")


def last_valid(rows: DataFrame, key: list[str], valid: Column, fields: list[str]) -> DataFrame:
    """Of each key its last valid row, by place in its file, and how often it was valid. On a stream this is keyed
    state that Spark keeps: a later failed retry changes nothing, an invalid key stays to be done."""
    place = F.struct("file", "offset")
    good = rows.filter(valid).dropna(subset=key)
    return good.groupBy(*key).agg(F.max(F.struct(place.alias("place"), *fields)).alias("last"), F.count("*").alias("n_valid")).select(*key, "last.place", *[F.col(f"last.{f}") for f in fields], "n_valid")


def keep_batches(stream: DataFrame, target: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Runs what is there through the stream; each batch is a folder of its own, so one that runs again replaces
    itself and nothing is read back."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, target: str, key: list[str]) -> DataFrame:
    """Of each key the row of its newest batch."""
    rows = spark.read.parquet(target)
    fields = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*fields), "batch").alias("r")).select(*key, "r.*")


def append_new(stream: DataFrame, target: str, key: list[str], checkpoint: str, valid: Column, run: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Appends what ``run`` makes of each key's first valid row. Keys seen are the stream's state, and a batch that runs
    again replaces its own folder: nothing is appended twice, and the target is never read. A target that another
    stream (with another checkpoint) has filled is asked once, before the first batch."""
    spark = stream.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    known = spark.read.parquet(target).select(*key).distinct() if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None
    fresh = stream.filter(valid).dropDuplicates(key)
    if known is not None:
        fresh = fresh.join(known, key, "left_anti")
    tag = F.xxhash64(F.lit(checkpoint))

    def put(batch: DataFrame, number: int) -> None:
        run(batch).withColumn("_stream", tag).withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_stream", "_batch").parquet(target)

    return fresh.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StatefulProcessor):
    """Good and failed rows of a key so far, when they came, and what stood before this batch."""

    def __init__(self, target: int):
        self.target = target

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", "ok long, errors long, first double, last double")

    def handleInputRows(self, key, rows, timer_values):
        ok, errors, first, last = self.state.get() if self.state.exists() else (0, 0, None, None)
        was_ok, was_last = ok, last
        for pdf in rows:
            good = int(pdf["good"].sum())
            ok, errors = ok + good, errors + len(pdf) - good
            if (at := pdf["at"].dropna()).size:
                first = float(at.min()) if first is None else min(first, float(at.min()))
                last = float(at.max()) if last is None else max(last, float(at.max()))
        self.state.update((ok, errors, first, last))
        hourly = lambda n, seconds: 3600 * n / seconds if seconds and seconds > 0 else None
        average = hourly(ok, last - first) if last is not None else None
        recent = hourly(ok - was_ok, last - was_last) if was_last is not None else None
        left = max(0, self.target - ok)
        eta = None if not average else left / average
        yield pd.DataFrame({"model": [key[0]], "ok": [ok], "errors": [errors], "remaining": [left], "average_per_hour": [average], "recent_per_hour": [recent], "eta_hours": [eta]}).astype({c: "float64" for c in ("average_per_hour", "recent_per_hour", "eta_hours")})

    def close(self) -> None:
        pass


def progress(rows: DataFrame, target: int) -> DataFrame:
    """A stream of (model, good, at in seconds) as a stream of updates: counts by model, rates by the rows' own time
    since the first row and since the batch before, and hours left. State is one small row a model."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy("model").transformWithStateInPandas(Progress(target), "model string, ok long, errors long, remaining long, average_per_hour double, recent_per_hour double, eta_hours double", "Update", "None")


def slowest(status: DataFrame) -> DataFrame:
    """All models in one row: they run side by side, so the slowest decides when all are done."""
    return status.agg(F.sum("ok").alias("ok"), F.sum("errors").alias("errors"), F.sum("remaining").alias("remaining"), F.sum("average_per_hour").alias("average_per_hour"), F.max("eta_hours").alias("eta_hours"))


def retry_delay(attempt: int, status: int | None, retry_after: float | None = None, base: float = 1.0, most: float = 60.0) -> float | None:
    """Seconds until the next try of a failed request, or None where trying again is of no use."""
    if status is not None and status != 429 and status < 500:
        return None
    return retry_after if retry_after is not None else min(most, base * 2**attempt)


#: Statuses and error names that another try may mend.
TRANSIENT_STATUSES = (408, 409, 429, 500, 502, 503, 504)
TRANSIENT_NAMES = ("timeout", "connection", "ratelimit", "internalserver")


def retry_plan(failures: DataFrame, key: str, seed: str, most: float = 60.0, jitter: float = 0.75) -> DataFrame:
    """failures (status, error, attempt from 1, retry_after as the server wrote it) with is_rate_limit, transient,
    retry_after_seconds (null if not a number, never below 0) and retry_delay_seconds: twice as long each attempt, at
    most ``most``, and a jitter from the hash of seed, key and attempt; never sooner than the server asks; null where
    trying again is of no use."""
    named = F.lower("error")
    transient = F.coalesce(F.col("status").isin(*TRANSIENT_STATUSES), F.lit(False))
    for name in TRANSIENT_NAMES:
        transient = transient | F.coalesce(named.contains(name), F.lit(False))
    asked = F.greatest(F.lit(0.0), F.col("retry_after").try_cast("double"))
    asked = F.when(F.col("retry_after").try_cast("double").isNotNull(), asked)
    wait = F.least(F.lit(most), F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col("attempt") - 1)))
    wait = wait + jitter * uniform(seed, F.col(key).cast("string"), F.col("attempt").cast("string"))
    out = failures.withColumns({"is_rate_limit": F.coalesce(F.col("status") == 429, F.lit(False)), "transient": transient, "retry_after_seconds": asked})
    return out.withColumn("retry_delay_seconds", F.when(F.col("transient"), F.greatest(wait, F.coalesce("retry_after_seconds", F.lit(0.0)))))
