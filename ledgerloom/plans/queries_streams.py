"""Ledgers that grow while they are read: a tail by byte offset, resumption, running status, and strict reads that
name the first bad line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.operators.contracts import ContractError, forbidden_keys
from ledgerloom.plans.register import query
from ledgerloom.sources.ledgers import bad_lines, freeze, read_yaml_lists
from ledgerloom.sources.scratch import scratch_path
from ledgerloom.sources.tables import table
from ledgerloom.streaming import ledger as R
from ledgerloom.streaming.tail import grow_files, tail

#: Files that the events are dealt to; a user's events stay in one file, in order.
FILES = 8


def ledger_files(spark: SparkSession, d: str, path: str, turns: int) -> None:
    """Events as growing JSON-lines files: what odd ids bring in the second turn stands behind the even ones."""
    e = table(spark, d, "events").withColumn("turn", F.col("event_id") % 2).filter(F.col("turn") < turns)
    fields = F.struct("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    lines = e.select(F.concat(F.lit("part-"), F.pmod("user_id", F.lit(FILES)), F.lit(".jsonl")).alias("file"), "turn", "event_id", F.to_json(fields).alias("line"))
    grow_files(lines, path, "file", ["turn", "event_id"], "line")


SCHEMA = "event_id long, user_id long, event_type string, value double, at long"


def grown(spark: SparkSession, d: str, tag: str, make) -> DataFrame:
    """Batches of the stream ``make`` over the ledger files, run after each turn and once more without news."""
    path = scratch_path(spark, tag)
    for turns in (1, 2, 2):
        ledger_files(spark, d, f"{path}/in", turns)
        R.keep_batches(make(R.attempts(tail(spark, f"{path}/in"), SCHEMA)), f"{path}/out", f"{path}/state").awaitTermination()
    return path


@query("s13_byte_offset_tail", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, sum(event_id)::BIGINT AS id_sum, count(*) FILTER (event_id % 2 = 1) AS later FROM events GROUP BY 1")
def s13_bytes(spark, d):
    """Files that grow between runs: each line comes once, the later ones in a later batch."""
    path = scratch_path(spark, "byte-tail")
    for turns in (1, 2, 2):
        ledger_files(spark, d, f"{path}/in", turns)
        R.keep_batches(R.attempts(tail(spark, f"{path}/in"), SCHEMA), f"{path}/out", f"{path}/state", "append").awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.sum("event_id").alias("id_sum"), F.count_if(F.expr("batch > 0")).alias("later"))


@query("r1_resume_stream", "SELECT user_id, event_type, arg_max(event_id, (event_id % 2, event_id)) AS event_id, arg_max(value, (event_id % 2, event_id)) AS value, count(*) AS n_valid FROM events WHERE value >= 1 GROUP BY 1, 2")
def r1_stream(spark, d):
    """The last valid attempt of each key, as state of a stream over growing files; what failed later changes nothing."""
    key = ["user_id", "event_type"]
    path = grown(spark, d, "resume", lambda rows: R.last_valid(rows, key, F.col("value") >= 1, ["event_id", "value"]))
    return R.newest(spark, f"{path}/out", key).drop("place")


_RATES = """
WITH m AS (SELECT event_type AS model, value >= 1 AS good, epoch_us(ts)::DOUBLE / 1000000 AS secs, event_id % 2 AS turn FROM events),
g AS (SELECT model, count(*) FILTER (good) AS ok, count(*) FILTER (NOT good) AS errors, max(secs) - min(secs) AS span,
    count(*) FILTER (good AND turn = 1) AS recent, max(secs) - max(secs) FILTER (turn = 0) AS since FROM m GROUP BY 1),
s AS (SELECT model, ok, errors, greatest(0, 1000000 - ok) AS remaining, CASE WHEN span > 0 THEN 3600.0::DOUBLE * ok / span END AS average_per_hour,
    CASE WHEN since > 0 THEN 3600.0::DOUBLE * recent / since END AS recent_per_hour FROM g)
"""


@query("r2_status_stream", _RATES + "SELECT model, ok, errors, remaining, round(average_per_hour, 6) AS average_per_hour, round(recent_per_hour, 3) AS recent_per_hour, round(CASE WHEN average_per_hour > 0 THEN remaining / average_per_hour END, 6) AS eta_hours FROM s")
def r2_stream(spark, d):
    """Running status of each model as keyed state: counts, hourly rates, hours left of a million."""
    out = R.newest(spark, f"{running(spark, d)}/out", ["model"])
    return out.select("model", "ok", "errors", "remaining", F.round("average_per_hour", 6).alias("average_per_hour"), F.round("recent_per_hour", 3).alias("recent_per_hour"), F.round("eta_hours", 6).alias("eta_hours"))


@query("r2_slowest_model", _RATES + "SELECT sum(ok)::BIGINT AS ok, sum(errors)::BIGINT AS errors, sum(remaining)::BIGINT AS remaining, round(sum(average_per_hour), 6) AS average_per_hour, round(max(CASE WHEN average_per_hour > 0 THEN remaining / average_per_hour END), 6) AS eta_hours FROM s")
def r2_slowest(spark, d):
    out = R.slowest(R.newest(spark, f"{running(spark, d)}/out", ["model"]))
    return out.withColumns({c: F.round(c, 6) for c in ("average_per_hour", "eta_hours")})


def running(spark, d) -> str:
    return grown(spark, d, "status", lambda rows: R.progress(rows.select(F.col("event_type").alias("model"), (F.col("value") >= 1).alias("good"), (F.col("at") / F.lit(1e6)).alias("at")), 1_000_000))


@query("s5_first_bad_lines", "WITH o AS (SELECT o_custkey % 8 AS f, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) AS line FROM orders) SELECT 'part-' || f || '.jsonl' AS file, min(line) AS line, arg_min(o_orderkey, line)::BIGINT AS o_orderkey FROM o WHERE o_orderkey % 101 = 0 GROUP BY f")
def s5_lines(spark, d):
    """Orders as JSON lines of which some are cut short: the first bad line of each file, by number."""
    path = scratch_path(spark, "strict")
    text = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    broken = F.when(F.col("o_orderkey") % 101 == 0, F.substring(text, 1, F.length(text) - 2)).otherwise(text)
    lines = table(spark, d, "orders").select(F.concat(F.lit("part-"), F.col("o_custkey") % FILES, F.lit(".jsonl")).alias("file"), "o_orderkey", broken.alias("line"))
    grow_files(lines, path, "file", ["o_orderkey"], "line")
    found = bad_lines(spark, path, "o_orderkey long, o_orderstatus string")
    return found.select(F.element_at(F.split("file", "/"), -1).alias("file"), "line", F.regexp_extract("text", r'"o_orderkey":(\d+)', 1).cast("long").alias("o_orderkey"))


_KEYS_SQL = r"""WITH p AS (SELECT CASE event_id % 3 WHEN 0 THEN '{"props": ' || props || ', "user": {"account_id": ' || user_id || '}}' WHEN 1 THEN '{"props": ' || props || ', "trace": [{"Reasoning": "a \"api_key\": b"}]}' ELSE props END AS payload FROM events),
k AS (SELECT unnest(list_distinct(regexp_extract_all(payload, '"((?:[^"\\]|\\.)*)"\s*:', 1))) AS key FROM p)
SELECT w AS word, key, count(*) AS n FROM k, (SELECT unnest(['account', 'api_key', 'reasoning']) AS w) WHERE contains(lower(key), w) GROUP BY ALL"""


@query("p17_forbidden_keys", _KEYS_SQL)
def p17_keys(spark, d):
    """Events whose JSON payload carries a forbidden key at any depth; a text that only mentions one doesn't count."""
    text = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    kind, props = F.col("event_id") % 3, F.col("props")
    payload = F.when(kind == 0, text('{"props": ', props, ', "user": {"account_id": ', F.col("user_id").cast("string"), "}}")).when(kind == 1, text('{"props": ', props, ', "trace": [{"Reasoning": "a \\"api_key\\": b"}]}')).otherwise(props)
    return forbidden_keys(table(spark, d, "events").select(payload.alias("payload")), "payload", ["account", "api_key", "reasoning"])


@query("s12_yaml_lists", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY 1")
def s12_yaml(spark, d):
    """Customers but for those of the nations that a YAML file lists."""
    path = scratch_path(spark, "yaml")
    line = F.concat(F.lit("  - id: "), F.col("n_nationkey").cast("string"), F.lit("  # left out\n    name: '"), F.col("n_name"), F.lit("'"))
    text = table(spark, d, "nation").filter("n_regionkey = 2").agg(F.concat(F.lit("version: 1\nexcluded:\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")))  # nations of a region: few
    text.coalesce(1).write.text(path)
    out = read_yaml_lists(spark, path).filter("list = 'excluded' and key = 'id'").select(F.col("value").cast("int").alias("c_nationkey"))
    return table(spark, d, "customer").join(out, "c_nationkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


_FAILED = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 429 WHEN 1 THEN 400 WHEN 2 THEN 503 WHEN 3 THEN 401 END AS status, CASE event_id % 6 WHEN 4 THEN 'APITimeoutError' WHEN 5 THEN 'ValueError' ELSE 'APIStatusError' END AS error,
    (event_id % 9 + 1)::INT AS attempt, CASE WHEN event_id % 4 = 0 THEN value::VARCHAR WHEN event_id % 4 = 1 THEN 'soon' END AS retry_after, value FROM events WHERE event_type = 'error'"""


@query("r4_retry_plan", f"""WITH f AS ({_FAILED}), t AS (SELECT *, coalesce(status IN (408, 409, 429, 500, 502, 503, 504), false) OR error = 'APITimeoutError' AS transient, CASE WHEN event_id % 4 = 0 THEN greatest(0, value) END AS asked,
    least(60, pow(2, attempt - 1)) + 0.75::DOUBLE * (('0x' || substr(sha256('r4|' || event_id || '|' || attempt), 1, 12))::UBIGINT / 281474976710656.0::DOUBLE) AS wait FROM f)
SELECT event_id, attempt, coalesce(status = 429, false) AS is_rate_limit, transient, round(asked, 9) AS retry_after_seconds, CASE WHEN transient THEN round(greatest(wait, coalesce(asked, 0)), 9) END AS retry_delay_seconds FROM t""")
def r4(spark, d):
    """When each failed event may be tried again, from its status, its error's name, its attempt and what the server asked."""
    e = table(spark, d, "events").filter("event_type = 'error'")
    i = F.col("event_id") % 6
    status = F.when(i == 0, 429).when(i == 1, 400).when(i == 2, 503).when(i == 3, 401)
    error = F.when(i == 4, "APITimeoutError").when(i == 5, "ValueError").otherwise("APIStatusError")
    asked = F.when(F.col("event_id") % 4 == 0, F.col("value").cast("string")).when(F.col("event_id") % 4 == 1, "soon")
    failed = e.select("event_id", status.alias("status"), error.alias("error"), (F.col("event_id") % 9 + 1).cast("int").alias("attempt"), asked.alias("retry_after"))
    return R.retry_plan(failed, "event_id", "r4").select("event_id", "attempt", "is_rate_limit", "transient", "retry_after_seconds", "retry_delay_seconds")


@query("k8_frozen_once", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS id_sum, true AS others_refused FROM events GROUP BY 1")
def k8(spark, d):
    """A table frozen under the hash of its inputs' ids: a second write with the same inputs leaves it, one with other
    inputs is refused."""
    e = table(spark, d, "events")
    path = scratch_path(spark, "frozen")
    content = lambda df: str(df.agg(F.sum(F.xxhash64("event_id", "event_type").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first())
    made = e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))
    freeze(made, path, content(e))
    freeze(made.limit(0), path, content(e.repartition("event_type")))
    try:
        freeze(made, path, content(e.filter("event_type <> 'error'")))
        refused = False
    except ContractError:
        refused = True
    return spark.read.parquet(f"{path}/data").withColumn("others_refused", F.lit(refused))
