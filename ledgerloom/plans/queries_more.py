"""Sources and sinks that write and read back, split searches, further designs and bootstraps, release steps, text
features and geometry of layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions import expressions as X
from ledgerloom.operators import designs as D, features as T, resample as B
from ledgerloom.operators.document_weights import document_weights
from ledgerloom.plans.frame import analysis_frame, with_frame
from ledgerloom.plans.queries_estimates import draws_sql, order_sums
from ledgerloom.plans.register import query
from ledgerloom.sources import ledgers as L
from ledgerloom.sources.scratch import scratch_path, written
from ledgerloom.sources.tables import table

_U = "(('0x' || substr(sha256({}), 1, 12))::UBIGINT / 281474976710656.0::DOUBLE)"
_RANK = "row_number() OVER (PARTITION BY {by} ORDER BY sha256('{seed}|' || {unit}), {unit})"
REPS = 500


# Sources and sinks.


@query("s9_k1_csv_gzip", "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1")
def s9_k1(spark, d):
    path = scratch_path(spark, "orders-csv")
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    L.write_csv(df, path)
    back = L.read_csv(spark, path, df._jdf.schema().toDDL())
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 4).alias("total"))


@query("k2_parquet_sink", "SELECT o_orderpriority, count(*) AS n, max(o_orderkey)::BIGINT AS last_key FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def k2(spark, d):
    path = scratch_path(spark, "orders-parquet")
    # Rows of a status go to as many files as tasks hold them; a later filter reads its folder only.
    table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).filter("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("o_orderkey").cast("long").alias("last_key"))


@query("s1_flat_json_lines", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1")
def s1(spark, d):
    path = scratch_path(spark, "orders-jsonl")
    nested = table(spark, d, "orders").select(F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("price")).alias("body")).alias("r")).select("r.*")
    nested.write.json(path)
    back = L.read_ledger(spark, path, "key long, body struct<status string, price double>", strict=True).select("key", "body.*")
    return back.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("price"), 4).alias("total"))


@query("s8_registry_scan", "SELECT CASE o_orderstatus WHEN 'F' THEN 'jsonl' WHEN 'O' THEN 'csv' ELSE 'parquet' END AS source_format, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def s8(spark, d):
    path = scratch_path(spark, "registry")
    df = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus")
    df.filter("o_orderstatus = 'F'").write.json(f"{path}/a")
    L.write_csv(df.filter("o_orderstatus = 'O'"), f"{path}/b")
    df.filter("o_orderstatus NOT IN ('F', 'O')").write.parquet(f"{path}/c")
    schema = "o_orderkey long, o_orderstatus string"
    found = L.read_registry(spark, [("jsonl", f"{path}/a", schema), ("csv", f"{path}/b", schema), ("parquet", f"{path}/c", schema)])
    return found.groupBy("source_format").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("s3_present_files", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s3(spark, d):
    path = scratch_path(spark, "events-json")
    table(spark, d, "events").select("event_type").write.json(f"{path}/here")
    return L.read_present(spark, [f"{path}/here", f"{path}/absent"], "event_type string").groupBy("event_type").agg(F.count("*").alias("n"))


@query("s11_prompt_document", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def s11(spark, d):
    path = scratch_path(spark, "prompts")
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows.groupBy("r_name").agg(F.collect_list(F.struct("n_name", "r_name")).alias("prompts")).write.partitionBy("r_name").json(path)  # a region's nations: few, and one document a region
    return L.read_prompts(spark, f"{path}/*", "n_name string, r_name string").groupBy("r_name").agg(F.count("*").alias("n"))


@query("s14_judge_folders", "SELECT CASE o_orderstatus WHEN 'F' THEN 'lab/f' ELSE 'lab/' || lower(o_orderstatus) END AS judge_model, count(*) AS n FROM orders GROUP BY 1")
def s14(spark, d):
    path = scratch_path(spark, "judges")
    for s in ("F", "O", "P"):
        table(spark, d, "orders").filter(F.col("o_orderstatus") == s).select("o_orderkey").write.json(f"{path}/lab__{s.lower()}")
    return L.read_judges(spark, path, "o_orderkey long").groupBy("judge_model").agg(F.count("*").alias("n"))


@query("s12_config_lists", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1 GROUP BY 1")
def s12(spark, d):
    path = scratch_path(spark, "config")
    deny = table(spark, d, "nation").filter("n_regionkey = 1").agg(F.array_sort(F.collect_list("n_name")).alias("denied"))  # nations of a region: few
    deny.write.json(path)
    named = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.join(L.read_config_list(spark, path, "denied"), F.col("n_name") == F.col("denied"), "left_anti").groupBy("n_name").agg(F.count("*").alias("n"))


@query("s13_incremental_tail", "SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 2 = 1) AS later FROM events GROUP BY 1")
def s13(spark, d):
    """A folder that grows: the second run of the stream reads only what came after the first."""
    path = scratch_path(spark, "tail")
    df = table(spark, d, "events").select("event_id", "event_type")
    stream = lambda: spark.readStream.schema("event_id long, event_type string").json(f"{path}/in")
    for turn in (0, 1):
        df.filter(F.col("event_id") % 2 == turn).write.mode("append").json(f"{path}/in")
        put = lambda batch, _, turn=turn: batch.withColumn("turn", F.lit(turn)).write.mode("append").parquet(f"{path}/out")
        stream().writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.expr("turn = 1")).alias("later"))


@query("k4_json_metadata", "SELECT 'orders' AS name, count(*) AS rows, min(o_orderkey)::BIGINT AS first_key, max(o_orderkey)::BIGINT AS last_key FROM orders")
def k4(spark, d):
    path = scratch_path(spark, "metadata")
    r = table(spark, d, "orders").agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")).first()
    L.write_metadata(spark, path, name="orders", **r.asDict())
    return L.read_ledger(spark, path, "name string, rows long, first_key long, last_key long", strict=True)


@query("k6_atomic_snapshot", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def k6(spark, d):
    path = scratch_path(spark, "snapshot")
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    L.replace_snapshot(df.filter("o_orderstatus = 'F'"), path)
    L.replace_snapshot(df, path)
    return L.read_snapshot(spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


# Derived columns, sorting and sets.


@query("p3_jurisdiction_map", "SELECT r_name AS jurisdiction, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def p3(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("r_name").alias("jurisdiction")).agg(F.count("*").alias("n"))


@query("p9_exclusive_cascade", with_frame("SELECT CASE WHEN y0 IS NULL THEN 'unknown' WHEN y = 1 AND y2 = 1 THEN 'both' WHEN y <> y0 THEN 'disputed' WHEN y = 1 THEN 'first' WHEN y2 = 1 THEN 'second' ELSE 'none' END AS class, count(*) AS n FROM frame GROUP BY 1"))
def p9(spark, d):
    y, y2, y0 = (F.col(c) for c in ("y", "y2", "y0"))
    cases = [(y0.isNull(), "unknown"), ((y == 1) & (y2 == 1), "both"), (y != y0, "disputed"), (y == 1, "first"), (y2 == 1, "second")]
    return analysis_frame(spark, d).groupBy(X.first_match(cases, "none").alias("class")).agg(F.count("*").alias("n"))


@query("p12_prefixes", "SELECT n_nationkey AS key, n_name AS nation_name, n_regionkey AS nation_regionkey FROM nation")
def p12(spark, d):
    df = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    bare = X.without_prefix(df, "n_")
    return X.with_prefix(bare, "nation_", keep=["nationkey"]).withColumnRenamed("nationkey", "key")


@query("p17_forbidden_columns", "SELECT 'acctbal' AS word, 2 AS columns UNION ALL SELECT 'comment', 0")
def p17(spark, d):
    """How many columns of customer and supplier each forbidden word would stop."""
    names = table(spark, d, "customer").limit(0).columns + table(spark, d, "supplier").limit(0).columns
    total = table(spark, d, "region").agg(F.count("*").alias("k"))
    words = total.select(F.explode(F.array(F.lit("acctbal"), F.lit("comment"))).alias("word"))
    return words.withColumn("columns", F.size(F.filter(F.array(*map(F.lit, names)), lambda c: c.contains(F.col("word")))))


@query("o1_rates_in_order", with_frame("SELECT model, rate, row_number() OVER (ORDER BY rate DESC, model)::INT AS place FROM (SELECT model, round(avg(y), 9) AS rate FROM frame GROUP BY 1)"))
def o1(spark, d):
    rates = analysis_frame(spark, d).groupBy("model").agg(F.round(F.avg("y"), 9).alias("rate"))
    return rates.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rate"), "model"))).orderBy("place")  # one row a model


@query("w10_first_unused", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def w10(spark, d):
    """Fifteen picks by price, no customer twice: taking each customer's best first is what the greedy loop does."""
    best = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("b"))
    return best.select("o_custkey", "b.*").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)


@query("w12_canonical_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS place FROM orders")
def w12(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("place"))


@query("u5_set_equality", "SELECT 0::BIGINT AS only_left, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS only_right")
def u5(spark, d):
    a, b = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct(), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "k", "full")
    return both.agg(F.count_if(F.expr("r IS NULL")).alias("only_left"), F.count_if(F.expr("l IS NULL")).alias("only_right"))


@query("u7_provenance_union", "SELECT CASE WHEN o_totalprice > 300000 THEN 'audit' WHEN o_orderstatus = 'F' THEN 'repair' ELSE 'primary' END AS provenance, count(*) AS n, true AS complete FROM orders GROUP BY 1")
def u7(spark, d):
    """Labelled parts by priority that together must be the population, each key once."""
    df = table(spark, d, "orders")
    audit, repair = df.filter("o_totalprice > 300000"), df.filter("o_orderstatus = 'F'")
    parts = [audit.withColumn("provenance", F.lit("audit")), repair.join(audit.select("o_orderkey"), "o_orderkey", "left_anti").withColumn("provenance", F.lit("repair"))]
    done = parts[0].unionByName(parts[1])
    all_rows = done.unionByName(df.join(done.select("o_orderkey"), "o_orderkey", "left_anti").withColumn("provenance", F.lit("primary")))
    counts = all_rows.groupBy("provenance").agg(F.count("*").alias("n"))
    whole = df.agg(F.count("*").alias("population"))
    sums = counts.agg(F.sum("n").alias("assembled"))
    return counts.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(sums)).select("provenance", "n", (F.col("population") == F.col("assembled")).alias("complete"))  # one row each


@query("t21_display_labels", "SELECT DISTINCT o_orderpriority, list_aggregate(list_transform(string_split(replace(lower(o_orderpriority), '-', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', ' ') AS label FROM orders")
def t21(spark, d):
    return table(spark, d, "orders").select("o_orderpriority").distinct().withColumn("label", F.initcap(F.replace(F.lower("o_orderpriority"), F.lit("-"), F.lit(" "))))


# Estimates and bootstraps.


@query("e21_rates_all_languages", with_frame("SELECT lang, jurisdiction, home_status, count(*) AS n, sum(y)::BIGINT AS events, round(avg(y), 9) AS rate FROM frame GROUP BY ALL"))
def e21(spark, d):
    return analysis_frame(spark, d).groupBy("lang", "jurisdiction", "home_status").agg(F.count("*").alias("n"), F.sum("y").alias("events"), F.avg("y").alias("rate"))


@query("e25_content_shares", with_frame(", m AS (SELECT model, lang, avg(y) AS share, avg(y2) AS other, avg(y - y2) AS signed FROM frame GROUP BY ALL) SELECT lang, count(*) AS models, round(avg(share), 9) AS share, round(avg(signed), 9) AS signed_mean, round(avg((share > other)::INT), 9) AS prevalence FROM m GROUP BY 1"))
def e25(spark, d):
    m = analysis_frame(spark, d).groupBy("model", "lang").agg(F.avg("y").alias("share"), F.avg("y2").alias("other"), F.avg(F.col("y") - F.col("y2")).alias("signed"))
    return m.groupBy("lang").agg(F.count("*").alias("models"), F.avg("share").alias("share"), F.avg("signed").alias("signed_mean"), F.avg((F.col("share") > F.col("other")).cast("int")).alias("prevalence"))


_CLUSTERS = ", st AS (SELECT cluster, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS n FROM frame GROUP BY 1)"


@query("b4_both_intervals", with_frame(draws_sql("b4", REPS) + _CLUSTERS + """, e AS (SELECT rep, sum(mult * s) / sum(mult * n) AS estimate FROM st JOIN dr USING (cluster) GROUP BY 1),
q AS (SELECT quantile_cont(estimate, 0.025) AS boot_low, quantile_cont(estimate, 0.975) AS boot_high FROM e), t AS (SELECT sum(s) AS s0, sum(n) AS n0, count(*) AS k FROM st),
j AS (SELECT s0 / n0 AS p, sqrt((k - 1) * var_pop((s0 - s) / (n0 - n))) AS se FROM st, t GROUP BY s0, n0, k), l AS (SELECT *, ln(p / (1 - p)) AS x, se / (p * (1 - p)) AS sx FROM j)
SELECT round(p, 9) AS estimate, round(se, 9) AS se, round(boot_low, 9) AS boot_low, round(boot_high, 9) AS boot_high, round(1 / (1 + exp(-(x - 1.959963984540054 * sx))), 9) AS logit_low, round(1 / (1 + exp(-(x + 1.959963984540054 * sx))), 9) AS logit_high FROM l, q"""))
def b4(spark, d):
    stats = written(analysis_frame(spark, d).groupBy("cluster").agg(F.sum("y").cast("double").alias("s"), F.count("*").cast("double").alias("n")), "cluster-stats")
    boot = B.percentile_interval(B.ratio(order_sums(spark, d, stats, [], ["s", "n"], REPS, "b4"), []), [], REPS).select(F.col("low").alias("boot_low"), F.col("high").alias("boot_high"))
    jack = B.jackknife(stats, "cluster").select("estimate", "se")
    x, p = F.ln(F.col("estimate") / (1 - F.col("estimate"))), F.col("estimate") * (1 - F.col("estimate"))
    bound = lambda z: 1 / (1 + F.exp(-(x + z * F.col("se") / p)))
    return jack.crossJoin(F.broadcast(boot)).withColumns({"logit_low": bound(-1.959963984540054), "logit_high": bound(1.959963984540054)})  # one row


@query("b5_rater_paired_bootstrap", with_frame(draws_sql("b5", REPS) + ", st AS (SELECT cluster, sum(y - y0) AS s, count(*) AS n FROM frame WHERE y0 IS NOT NULL GROUP BY 1), e AS (SELECT rep, sum(mult * s)::DOUBLE / sum(mult * n) AS estimate FROM st JOIN dr USING (cluster) GROUP BY 1) SELECT count(estimate) AS ok, round(quantile_cont(estimate, 0.025), 9) AS low, round(quantile_cont(estimate, 0.975), 9) AS high, 500 - count(estimate) AS failed, 500 - count(estimate) <= 10 AS reliable FROM e"))
def b5(spark, d):
    stats = analysis_frame(spark, d).filter("y0 IS NOT NULL").groupBy("cluster").agg(F.sum(F.col("y") - F.col("y0")).alias("s"), F.count("*").alias("n"))
    return B.percentile_interval(B.ratio(order_sums(spark, d, stats, [], ["s", "n"], REPS, "b5"), []), [], REPS)


@query("b6_reliability_bootstrap", with_frame(draws_sql("b6", REPS) + ", st AS (SELECT cluster, sum(2 * y * y0) AS s, sum(y + y0) AS n FROM frame WHERE y0 IS NOT NULL GROUP BY 1), e AS (SELECT rep, sum(mult * s)::DOUBLE / sum(mult * n) AS estimate FROM st JOIN dr USING (cluster) GROUP BY 1) SELECT count(estimate) AS ok, round(quantile_cont(estimate, 0.025), 9) AS low, round(quantile_cont(estimate, 0.975), 9) AS high, 500 - count(estimate) AS failed, 500 - count(estimate) <= 10 AS reliable FROM e"))
def b6(spark, d):
    """Positive specific agreement 2a / (2a + b + c) of two raters."""
    stats = analysis_frame(spark, d).filter("y0 IS NOT NULL").groupBy("cluster").agg(F.sum(2 * F.col("y") * F.col("y0")).alias("s"), F.sum(F.col("y") + F.col("y0")).alias("n"))
    return B.percentile_interval(B.ratio(order_sums(spark, d, stats, [], ["s", "n"], REPS, "b6"), []), [], REPS)


@query("b8_f1_difference", with_frame(draws_sql("b8", 2000) + """, st AS (SELECT cluster, sum(2 * y * y2) AS a, sum(y + y2) AS b, sum(2 * y * y0) AS c, sum(y + y0) AS e FROM frame WHERE y0 IS NOT NULL GROUP BY 1),
f AS (SELECT rep, sum(mult * a)::DOUBLE / sum(mult * b) - sum(mult * c)::DOUBLE / sum(mult * e) AS d FROM st JOIN dr USING (cluster) GROUP BY 1)
SELECT count(d) AS ok, round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high, round(avg((d > 0)::INT), 9) AS above FROM f"""))
def b8(spark, d):
    """F1 of one prediction less that of another, both against y, inside each replicate."""
    y, y2, y0 = F.col("y"), F.col("y2"), F.col("y0")
    st = analysis_frame(spark, d).filter("y0 IS NOT NULL").groupBy("cluster").agg(F.sum(2 * y * y2).alias("a"), F.sum(y + y2).alias("b"), F.sum(2 * y * y0).alias("c"), F.sum(y + y0).alias("e"))
    sums = order_sums(spark, d, st, [], ["a", "b", "c", "e"], 2000, "b8")
    per = sums.select((F.try_divide("a", "b") - F.try_divide("c", "e")).alias("d"))
    return per.agg(F.count("d").alias("ok"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.avg((F.col("d") > 0).cast("int")).alias("above"))


@query("b11_multiplier_band", with_frame(f""", c AS (SELECT cluster, lang, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS n, coalesce(var_pop(y) * count(*), 0) AS w FROM frame GROUP BY ALL),
g AS (SELECT lang, sum(s) AS total, sum(n) AS n0, sum(w) AS within FROM c GROUP BY 1), r AS (SELECT c.cluster, c.lang, n0, s - n * total / n0 AS r FROM c JOIN g USING (lang)),
b AS (SELECT lang, sqrt(sum(r * r)) / any_value(n0) AS se FROM r GROUP BY 1), m AS (SELECT cluster, rep, CASE WHEN {_U.format("'b11|' || rep || '|' || cluster")} < 0.5 THEN -1 ELSE 1 END AS m FROM (SELECT DISTINCT cluster FROM r), range(1, 301) t(rep)),
t AS (SELECT rep, lang, sum(m * r) / any_value(n0) AS mv FROM r JOIN m USING (cluster) GROUP BY ALL), f AS (SELECT quantile_cont(t, 0.95) AS factor FROM (SELECT rep, max(abs(mv / se)) AS t FROM t JOIN b USING (lang) GROUP BY 1))
SELECT lang, round(total / n0, 9) AS estimate, round(se, 9) AS se, round(sqrt(within) / n0, 9) AS se_within, round(factor, 9) AS factor, round(total / n0 - factor * se, 9) AS low, round(total / n0 + factor * se, 9) AS high FROM g JOIN b USING (lang), f"""))
def b11(spark, d):
    c = analysis_frame(spark, d).groupBy("cluster", "lang").agg(F.sum("y").cast("double").alias("s"), F.count("*").cast("double").alias("n"), (F.var_pop("y") * F.count("*")).alias("w"))
    return B.multiplier_band(written(c, "cluster-scores"), "cluster", "lang", 300, "b11")


@query("b14_beta_yields", with_frame(", g AS (SELECT model, sum(y) + 0.5::DOUBLE AS a, count(*) - sum(y) + 0.5::DOUBLE AS b FROM frame WHERE y0 IS NOT NULL GROUP BY 1) SELECT model, round(a / (a + b), 9) AS mean, round(sqrt(a * b / (pow(a + b, 2) * (a + b + 1))), 9) AS sd, round(200 * a / (a + b), 9) AS expected, round(sqrt(200 * a * b * (a + b + 200) / (pow(a + b, 2) * (a + b + 1))), 9) AS predictive_sd FROM g"))
def b14(spark, d):
    """Jeffreys posterior of each model's rate, and the yield to expect of 200 more rows (beta-binomial)."""
    g = analysis_frame(spark, d).filter("y0 IS NOT NULL").groupBy("model").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    return g.select("model", *X.beta_yield(F.col("k"), F.col("n"), 200))


# Designs.


@query("d5_capped_sample", f"SELECT o_orderpriority, o_orderstatus, o_orderkey FROM (SELECT *, {_RANK.format(by='o_orderpriority, o_orderstatus', seed='d5', unit='o_orderkey')} AS k, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS n FROM orders) WHERE k <= least(25, ceil(n * 0.1))")
def d5(spark, d):
    """A tenth of each cell, 25 at most."""
    by = ["o_orderpriority", "o_orderstatus"]
    return D.srswor(table(spark, d, "orders").select("o_orderkey", *by), by, "o_orderkey", F.least(F.lit(25), F.ceil(F.col("stratum_n") * F.lit(0.1))), "d5").filter("drawn").select(*by, "o_orderkey")


@query("d9_pilot_design", f"""WITH a AS (SELECT o_orderkey, o_orderpriority, o_orderstatus = 'P' AS urgent, count(*) OVER () AS n0, count(*) OVER (PARTITION BY o_orderpriority) AS n1, count(*) OVER (PARTITION BY o_orderstatus = 'P') AS n2,
    {_RANK.format(by="1", seed='d9g', unit='o_orderkey')} AS k0, {_RANK.format(by='o_orderpriority', seed='d9c', unit='o_orderkey')} AS k1, {_RANK.format(by="o_orderstatus = 'P'", seed='d9p', unit='o_orderkey')} AS k2 FROM orders),
u AS (SELECT *, 1 - (1 - least(150, n0) / n0) * (1 - least(30, n1) / n1) * (1 - CASE WHEN urgent THEN least(40, n2) / n2 ELSE 0 END) AS pi FROM a WHERE k0 <= 150 OR k1 <= 30 OR urgent AND k2 <= 40)
SELECT o_orderkey, round(pi, 9) AS pi, row_number() OVER (ORDER BY sha256('d9r|' || o_orderkey), o_orderkey) <= 20 AS repeated FROM u""")
def d9(spark, d):
    """Global, cell and priority draws together, exact inclusion, and twenty drawn rows that are asked twice."""
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "P").alias("urgent"), F.lit(1).alias("every"))
    df, base = df.select("o_orderkey"), df
    for name, by, size in (("d9g", "every", F.lit(150)), ("d9c", "o_orderpriority", F.lit(30)), ("d9p", "urgent", F.when(F.col("urgent"), 40).otherwise(0))):
        drawn = D.srswor(base.select("o_orderkey", by), [by], "o_orderkey", size, name)
        df = df.join(drawn.select("o_orderkey", F.col("pi").alias(f"pi_{name}"), F.col("drawn").alias(f"in_{name}")), "o_orderkey")
    df = df.filter("in_d9g OR in_d9c OR in_d9p").withColumn("pi", 1 - (1 - F.col("pi_d9g")) * (1 - F.col("pi_d9c")) * (1 - F.col("pi_d9p")))
    drawn = written(df.select("o_orderkey", "pi"), "pilot")
    again = drawn.orderBy(F.sha2(F.concat_ws("|", F.lit("d9r"), F.col("o_orderkey").cast("string")), 256), "o_orderkey").limit(20).select("o_orderkey", F.lit(True).alias("r"))
    return drawn.join(again, "o_orderkey", "left").select("o_orderkey", "pi", F.coalesce("r", F.lit(False)).alias("repeated"))


@query("d10_candidate_probabilities", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(least(1, 40 / count(*)), 9) AS cell_pi, round(1 - (1 - least(1, 40 / count(*))) * (1 - least(1, 300 / sum(count(*)) OVER ())), 9) AS pi FROM orders GROUP BY ALL")
def d10(spark, d):
    cells = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("all_n"))
    cell, everywhere = F.least(F.lit(1.0), 40 / F.col("n")), F.least(F.lit(1.0), 300 / F.col("all_n"))
    return cells.crossJoin(F.broadcast(total)).select("o_orderpriority", "o_orderstatus", "n", cell.alias("cell_pi"), (1 - (1 - cell) * (1 - everywhere)).alias("pi"))  # one row


@query("d15_control_sample", f"""WITH a AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS n, {_RANK.format(by='o_orderpriority, o_orderstatus', seed='d15', unit='o_orderkey')} AS k FROM orders),
r AS (SELECT *, {_RANK.format(by='k = 1', seed='d15t', unit='o_orderkey')} AS t, (SELECT count(*) FROM a WHERE k > 1) AS rest FROM a)
SELECT o_orderkey, k = 1 AS first, round(1 / n + (1 - 1 / n) * least(100, rest) / rest, 9) AS pi FROM r WHERE k = 1 OR t <= 100""")
def d15(spark, d):
    """One of each cell, and a hundred of the rest; a unit comes in by its cell's draw, or else by the second."""
    by = ["o_orderpriority", "o_orderstatus"]
    df = D.srswor(table(spark, d, "orders").select("o_orderkey", *by), by, "o_orderkey", F.lit(1), "d15").select("o_orderkey", F.col("pi").alias("p1"), F.col("drawn").alias("first"))
    df = D.srswor(written(df, "control"), ["first"], "o_orderkey", F.when(F.col("first"), F.lit(0)).otherwise(100), "d15t")
    rest = F.max(F.when(~F.col("first"), F.col("pi")))
    df = df.withColumnRenamed("pi", "p2").crossJoin(F.broadcast(df.agg(rest.alias("top"))))  # one row
    return df.filter("first OR drawn").select("o_orderkey", "first", (F.col("p1") + (1 - F.col("p1")) * F.col("top")).alias("pi"))


def _split_sql(table_sql: str, parts: int, tries: int, seed: str, by: str = "") -> str:
    b = f", {by}" if by else ""
    on = f"USING ({by})" if by else "ON true"
    return f"""WITH g AS ({table_sql}), a AS (SELECT *, floor({_U.format(f"'{seed}|' || try || '|' || grp")} * {parts})::INT AS part FROM g, range(1, {tries + 1}) t(try)),
w AS (SELECT sum(v)::DOUBLE / {parts} AS want{b} FROM g {f'GROUP BY {by}' if by else ''}), s AS (SELECT try, part{b}, sum(v) AS v FROM a GROUP BY ALL),
o AS (SELECT try{b}, sum(abs(v - want)) + ({parts} - count(*)) * any_value(want) AS off FROM s JOIN w {on} GROUP BY ALL), best AS (SELECT try, round(sum(off), 6) AS off FROM o GROUP BY 1 ORDER BY 2, 1 LIMIT 1)
SELECT DISTINCT grp, part, off, try::INT AS try FROM a JOIN best USING (try)"""


@query("d16_group_split", _split_sql("SELECT c_nationkey::INT AS grp, count(*) AS v FROM customer GROUP BY 1", 2, 10000, "d16"))
def d16(spark, d):
    groups = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("int").alias("grp")).agg(F.count("*").alias("v"))
    return D.balanced_split(written(groups, "groups"), "grp", "v", 2, 10000, "d16")


@query("d17_class_balanced_split", _split_sql("SELECT c_nationkey::INT AS grp, c_mktsegment AS class, count(*) AS v FROM customer GROUP BY ALL", 2, 100_000, "d17", "class"))
def d17(spark, d):
    groups = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("int").alias("grp"), F.col("c_mktsegment").alias("class")).agg(F.count("*").alias("v"))
    return D.balanced_split(written(groups, "groups"), "grp", "v", 2, 100_000, "d17", by="class")


@query("d18_balanced_folds", _split_sql("SELECT c_nationkey::INT AS grp, count(*) AS v FROM customer GROUP BY 1", 5, 20000, "d18"))
def d18(spark, d):
    groups = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("int").alias("grp")).agg(F.count("*").alias("v"))
    return D.balanced_split(written(groups, "groups"), "grp", "v", 5, 20000, "d18")


@query("d19_greedy_diverse")
def d19(spark, d):
    """For each priority and status the dearest order, no customer twice. Of a cell only its first rows of as many
    customers as there are cells can matter: these go to the driver."""
    df = table(spark, d, "orders").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("cell"), "o_custkey", "o_orderkey", "o_totalprice")
    best = df.groupBy("cell", "o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("b")).select("cell", "o_custkey", "b.*")
    cells = df.select("cell").distinct().count()
    order = [F.desc("o_totalprice"), "o_orderkey"]
    top = best.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy(*order))).filter(F.col("k") <= cells).orderBy("cell", "k")
    picks = D.greedy_diverse([tuple(r)[:4] for r in top.collect()], cells)
    return spark.createDataFrame(picks, top.select("cell", "o_custkey", "o_orderkey", "o_totalprice").schema)


@query("d20_first_wave", "WITH s AS (SELECT o_orderpriority AS stratum, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT *, n * 400 / sum(n) OVER () AS x FROM s), r AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, stratum) AS k, 400 - sum(floor(x)) OVER () AS l FROM x), a AS (SELECT stratum, n, (floor(x) + (k <= l)::INT)::BIGINT AS allocated FROM r) SELECT o_orderkey, round(allocated / n, 9) AS pi FROM (SELECT o_orderkey, allocated, n, " + _RANK.format(by="o_orderpriority", seed="d20", unit="o_orderkey") + " AS k FROM orders JOIN a ON o_orderpriority = stratum) WHERE k <= allocated")
def d20(spark, d):
    """The first wave's probabilities, from its allocation and the same seeded draw."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    strata = orders.groupBy(F.col("o_orderpriority").alias("stratum")).agg(F.count("*").alias("n"))
    wave = D.proportional_allocation(strata, "stratum", "n", 400).select(F.col("stratum").alias("o_orderpriority"), "allocated")
    drawn = D.srswor(orders.join(F.broadcast(wave), "o_orderpriority"), ["o_orderpriority", "allocated"], "o_orderkey", F.col("allocated"), "d20")  # one row a stratum
    return drawn.filter("drawn").select("o_orderkey", "pi")


@query("d25_plan_simulation", "WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT *, least(1, 30 / n) AS pi FROM c) SELECT o_orderpriority, round(sum(n * pi), 9) AS expected_n, round(sum(n * pi * (1 - pi)), 9) AS variance, round(min(1 - pow(1 - pi, n)), 9) AS least_coverage FROM p GROUP BY 1")
def d25(spark, d):
    """What a plan of thirty a cell gives by priority: units expected, their variance, and the chance that the
    least covered cell is seen at all."""
    cells = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).withColumn("pi", F.least(F.lit(1.0), 30 / F.col("n")))
    n, pi = F.col("n"), F.col("pi")
    return cells.groupBy("o_orderpriority").agg(F.sum(n * pi).alias("expected_n"), F.sum(n * pi * (1 - pi)).alias("variance"), F.min(1 - F.pow(1 - pi, n)).alias("least_coverage"))


_DRAWN = f"WITH a AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, (o_totalprice > 200000)::INT AS y, (o_totalprice > 180000)::INT AS y1, count(*) OVER (PARTITION BY o_orderpriority) AS big, {_RANK.format(by='o_orderpriority', seed='h', unit='o_orderkey')} AS k FROM orders), s AS (SELECT *, least(80, big) AS m, least(80, big) / big AS pi FROM a WHERE k <= 80)"


def _drawn(spark, d) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", (F.col("o_totalprice") > 200000).cast("int").alias("y"), (F.col("o_totalprice") > 180000).cast("int").alias("y1"))
    return D.srswor(df, ["o_orderpriority"], "o_orderkey", F.lit(80), "h").filter("drawn")


@query("h9_complement", _DRAWN + " SELECT o_orderstatus, round(sum(y / pi) / sum(1 / pi), 9) AS rate, round(1 - sum(y / pi) / sum(1 / pi), 9) AS complement FROM s GROUP BY 1")
def h9(spark, d):
    rate = F.sum(F.col("y") / F.col("pi")) / F.sum(1 / F.col("pi"))
    return _drawn(spark, d).groupBy("o_orderstatus").agg(rate.alias("rate"), (1 - rate).alias("complement"))


_BATTERY = (("level", "1"), ("later", "CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END"), ("contrast", "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END"))


@query("h14_estimand_battery", _DRAWN + f""", z AS ({' UNION ALL '.join(f"SELECT '{n}' AS estimand, o_orderpriority, big, m, ({c}) * y AS z, ({c}) <> 0 AS used FROM s" for n, c in _BATTERY)}),
g AS (SELECT estimand, o_orderpriority, any_value(big) AS big, count(*) AS m, avg(z) AS mean, coalesce(var_samp(z), 0) AS v, sum(used::INT) AS used FROM z GROUP BY ALL)
SELECT estimand, round(sum(big * mean), 6) AS total, round(sqrt(sum(big::DOUBLE * big * (1 - m / big) * v / m)), 6) AS se, sum(used)::BIGINT AS support, sum(used) < 30 AS thin, sqrt(sum(big::DOUBLE * big * (1 - m / big) * v / m)) * 1.959963984540054 > 0.5 * abs(sum(big * mean)) AS wide FROM g GROUP BY 1""")
def h14(spark, d):
    """Linear estimands sum(a * y / pi) of one stratified sample: totals, their design errors, and whether rows or
    precision are short."""
    s = _drawn(spark, d)
    terms = F.array(*[F.struct(F.lit(n).alias("estimand"), F.expr(c).alias("a")) for n, c in _BATTERY])
    z = s.withColumn("e", F.explode(terms)).select("e.*", "o_orderpriority", "stratum_n", (F.col("e.a") * F.col("y")).alias("z"))
    g = z.groupBy("estimand", "o_orderpriority").agg(F.first("stratum_n").alias("big"), F.count("*").alias("m"), F.avg("z").alias("mean"), F.coalesce(F.var_samp("z"), F.lit(0.0)).alias("v"), F.count_if(F.expr("a <> 0")).alias("used"))
    big, m = F.col("big"), F.col("m")
    out = g.groupBy("estimand").agg(F.sum(big * F.col("mean")).alias("total"), F.sqrt(F.sum(big * big * (1 - m / big) * F.col("v") / m)).alias("se"), F.sum("used").alias("support"))
    return out.withColumns({"thin": F.col("support") < 30, "wide": F.col("se") * 1.959963984540054 > 0.5 * F.abs("total")}).withColumns({"total": F.round("total", 6), "se": F.round("se", 6)})


@query("m17_design_difference", _DRAWN + ", g AS (SELECT o_orderpriority, any_value(big) AS big, count(*) AS m, avg(y1 - y) AS mean, coalesce(var_samp(y1 - y), 0) AS v FROM s GROUP BY 1), e AS (SELECT sum(big * mean) / sum(big) AS x, sqrt(sum(big::DOUBLE * big * (1 - m / big) * v / m)) / sum(big) AS se FROM g) SELECT round(x, 9) AS difference, round(se, 9) AS se, round(x - 1.959963984540054 * se, 9) AS low, round(x + 1.959963984540054 * se, 9) AS high FROM e")
def m17(spark, d):
    g = _drawn(spark, d).groupBy("o_orderpriority").agg(F.first("stratum_n").alias("big"), F.count("*").alias("m"), F.avg(F.col("y1") - F.col("y")).alias("mean"), F.coalesce(F.var_samp(F.col("y1") - F.col("y")), F.lit(0.0)).alias("v"))
    big, m, z = F.col("big"), F.col("m"), 1.959963984540054
    e = g.agg((F.sum(big * F.col("mean")) / F.sum(big)).alias("difference"), (F.sqrt(F.sum(big * big * (1 - m / big) * F.col("v") / m)) / F.sum(big)).alias("se"))
    return e.withColumns({"low": F.col("difference") - z * F.col("se"), "high": F.col("difference") + z * F.col("se")})


@query("m5_weighted_binary", with_frame(", c AS (SELECT sum(CASE WHEN y = 1 AND y2 = 1 THEN l_quantity END)::DOUBLE AS tp, sum(CASE WHEN y = 0 AND y2 = 1 THEN l_quantity END)::DOUBLE AS fp, sum(CASE WHEN y = 1 AND y2 = 0 THEN l_quantity END)::DOUBLE AS fn, sum(CASE WHEN y = 0 AND y2 = 0 THEN l_quantity END)::DOUBLE AS tn, sum(l_quantity)::DOUBLE AS w FROM frame), k AS (SELECT *, (tp + tn) / w AS o, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (w * w) AS e FROM c) SELECT round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(o, 9) AS accuracy, round((o - e) / (1 - e), 9) AS kappa FROM k"))
def m5(spark, d):
    w = lambda a, b: F.sum(F.when((F.col("y") == a) & (F.col("y2") == b), F.col("l_quantity"))).cast("double")
    c = analysis_frame(spark, d).agg(w(1, 1).alias("tp"), w(0, 1).alias("fp"), w(1, 0).alias("fn"), w(0, 0).alias("tn"), F.sum("l_quantity").cast("double").alias("w"))
    k = c.withColumns({"o": F.expr("(tp + tn) / w"), "e": F.expr("((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (w * w)")})
    # Agreement that chance makes certain has no kappa: NaN.
    return k.select(F.expr("tp / (tp + fp)").alias("precision"), F.expr("tp / (tp + fn)").alias("recall"), F.col("o").alias("accuracy"), F.when(F.col("e") == 1, float("nan")).otherwise(F.expr("(o - e) / (1 - e)")).alias("kappa"))


@query("m19_pairwise_exact", with_frame(", r AS (SELECT 'y' AS rater_left, 'y0' AS rater_right, y AS a, y0 AS b FROM frame WHERE y0 IS NOT NULL UNION ALL SELECT 'y', 'y2', y, y2 FROM frame WHERE y0 IS NOT NULL UNION ALL SELECT 'y0', 'y2', y0, y2 FROM frame WHERE y0 IS NOT NULL) SELECT rater_left, rater_right, count(*) AS n, round(avg((a = b)::INT), 9) AS exact, round(sum((a = 1 AND b = 1)::INT) / sum((a = 1 OR b = 1)::INT), 9) AS positive FROM r GROUP BY ALL"))
def m19(spark, d):
    """Agreement of each pair of raters. A row holds all its raters' labels, so pairs are made in the row."""
    raters = ["y", "y0", "y2"]
    pairs = F.array(*[F.struct(F.lit(a).alias("rater_left"), F.lit(b).alias("rater_right"), F.col(a).alias("l"), F.col(b).alias("r")) for i, a in enumerate(raters) for b in raters[i + 1 :]])
    rows = analysis_frame(spark, d).filter("y0 IS NOT NULL").select(F.inline(pairs))
    return rows.groupBy("rater_left", "rater_right").agg(F.count("*").alias("n"), F.avg((F.col("l") == F.col("r")).cast("int")).alias("exact"), F.try_divide(F.count_if(F.expr("l = 1 AND r = 1")), F.count_if(F.expr("l = 1 OR r = 1"))).alias("positive"))


@query("m19_unanimity", with_frame("SELECT 1 + (y <> y0 OR y <> y2)::INT AS predictions, y = y0 AND y = y2 AS unanimous, count(*) AS n FROM frame WHERE y0 IS NOT NULL GROUP BY ALL"))
def m19u(spark, d):
    rows = analysis_frame(spark, d).filter("y0 IS NOT NULL").select(F.size(F.array_distinct(F.array("y", "y0", "y2"))).alias("predictions"))
    return rows.groupBy("predictions", (F.col("predictions") == 1).alias("unanimous")).agg(F.count("*").alias("n"))


# Reruns and releases.

_HEX = "(('0x' || substr(sha256({}), 1, 12))::UBIGINT::BIGINT)"


def payload_hash(df: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Rows and a hash of their content for each group, whatever the order and files of the rows."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in fields]), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.pmod(F.sum(h), F.lit(2**40).cast("decimal(20,0)")).cast("long").alias("payload"))


_PAYLOAD_SQL = f"SELECT o_orderstatus, count(*) AS n, (sum({_HEX.format('o_orderkey || chr(124) || o_custkey || chr(124) || o_orderpriority')}) % 1099511627776)::BIGINT AS payload FROM orders GROUP BY 1"


@query("r6_payload_rehash", f"SELECT *, true AS same FROM ({_PAYLOAD_SQL})")
def r6(spark, d):
    """A rerun that wrote other files in another order has the same logical payload."""
    fields = ["o_orderkey", "o_custkey", "o_orderpriority"]
    df = table(spark, d, "orders").select("o_orderstatus", *fields)
    again = written(df.repartition(5, "o_custkey"), "rerun")
    a, b = payload_hash(df, ["o_orderstatus"], fields), payload_hash(again, ["o_orderstatus"], fields)
    return a.join(b.select("o_orderstatus", F.col("payload").alias("again")), "o_orderstatus").select("o_orderstatus", "n", "payload", (F.col("payload") == F.col("again")).alias("same"))


@query("g5_inherited_estimates", "SELECT o_orderstatus, count(*) AS n, 0::BIGINT AS changed FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*), count(*) FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def g5(spark, d):
    """Rows whose content hash differs between two releases: a release of figures only must have none."""
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", X.row_hash(F.col("o_custkey").cast("string"), F.col("o_orderpriority")).alias("h"))
    new = table(spark, d, "orders").select("o_orderkey", X.row_hash(F.col("o_custkey").cast("string"), F.when(F.col("o_orderstatus") == "P", "changed").otherwise(F.col("o_orderpriority"))).alias("g"))
    both = old.join(new, "o_orderkey", "left")
    return both.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(~F.col("h").eqNullSafe(F.col("g"))).alias("changed"))


@query("g6_release_swap", _PAYLOAD_SQL)
def g6(spark, d):
    """Stage, verify, swap: the staged table replaces the released one only if its payload is the source's."""
    fields = ["o_orderkey", "o_custkey", "o_orderpriority"]
    df, path = table(spark, d, "orders").select("o_orderstatus", *fields), scratch_path(spark, "release")
    df.write.parquet(f"{path}/staged")
    want, got = (payload_hash(x, ["o_orderstatus"], fields) for x in (df, spark.read.parquet(f"{path}/staged")))
    if want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty():
        L.replace_snapshot(spark.read.parquet(f"{path}/staged"), f"{path}/current")
    return payload_hash(L.read_snapshot(spark, f"{path}/current"), ["o_orderstatus"], fields)


@query("g7_replication_check", "SELECT o_orderstatus AS name, CASE WHEN o_orderstatus = 'P' THEN 'unregistered' ELSE 'PASS' END AS verdict FROM orders GROUP BY 1 UNION ALL SELECT 'X', 'missing'")
def g7(spark, d):
    """Counts and hashes against a registry written before; what either side lacks is told too."""
    fields = ["o_orderkey", "o_custkey", "o_orderpriority"]
    now = payload_hash(table(spark, d, "orders"), ["o_orderstatus"], fields).withColumnRenamed("o_orderstatus", "name")
    absent = now.agg(F.lit("X").alias("name"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("payload"))
    registry = written(now.filter("name <> 'P'").unionByName(absent), "registry").select("name", F.col("n").alias("n0"), F.col("payload").alias("h0"))
    both = now.join(registry, "name", "full")
    verdict = F.when(F.col("n0").isNull(), "unregistered").when(F.col("n").isNull(), "missing").when((F.col("n") == F.col("n0")) & (F.col("payload") == F.col("h0")), "PASS").otherwise("FAIL")
    return both.select("name", verdict.alias("verdict"))


@query("g11_republished_audit", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
def g11(spark, d):
    """An external table is published on only if its payload is the one it was frozen with."""
    fields = ["o_orderkey", "o_orderpriority"]
    audit = written(table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderstatus", *fields), "audit")
    frozen, now = payload_hash(table(spark, d, "orders").filter("o_orderstatus = 'P'"), ["o_orderstatus"], fields), payload_hash(audit, ["o_orderstatus"], fields)
    if not frozen.exceptAll(now).isEmpty():
        raise L.ContractError("the audit differs from what was frozen")
    return audit.select(*fields)


# Features and layouts.


@query("v7_procrustes", "WITH e AS (SELECT embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS y1, embedding[2]::DOUBLE AS x2, (embedding[3] - embedding[1])::DOUBLE AS y2 FROM embeddings), c AS (SELECT x1 - avg(x1) OVER () AS x1, y1 - avg(y1) OVER () AS y1, x2 - avg(x2) OVER () AS x2, y2 - avg(y2) OVER () AS y2 FROM e), m AS (SELECT count(*) AS n, sum(x1 * x2) AS a, sum(x1 * y2) AS b, sum(y1 * x2) AS c, sum(y1 * y2) AS d, sum(x1 * x1 + y1 * y1) AS s1, sum(x2 * x2 + y2 * y2) AS s2 FROM c), t AS (SELECT *, sqrt(a * a + b * b + c * c + d * d + 2 * abs(a * d - b * c)) AS t FROM m) SELECT n, round(sqrt(greatest(0, s1 - t * t / s2) / n), 9) AS rmse, round(t / s2, 9) AS scale FROM t")
def v7(spark, d):
    e = table(spark, d, "embeddings").select(*[F.get("embedding", F.lit(i)).cast("double").alias(f"c{i}") for i in range(3)])
    return T.procrustes(e.select(F.col("c0").alias("x1"), F.col("c1").alias("y1"), F.col("c1").alias("x2"), (F.col("c2") - F.col("c0")).alias("y2")))


@query("v8_region_medoids", "WITH e AS (SELECT vec_id, label, embedding FROM embeddings), u AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM e), c AS (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL), s AS (SELECT vec_id, label, round(sum(x * m), 9) AS s FROM u JOIN c USING (label, i) GROUP BY ALL) SELECT label, arg_max(vec_id, (s, -vec_id)) AS medoid, count(*) AS n FROM s GROUP BY 1")
def v8(spark, d):
    return T.medoids(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), "vec_id", "label", "embedding")


_WORDS_SQL = "regexp_extract_all(lower(text), '[a-z]+')"


@query("v10_tfidf", f"WITH w AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM w), i AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM f, n GROUP BY 1) SELECT doc_id, count(*) AS terms, round(sqrt(sum(pow(tf * idf, 2))), 6) AS norm, round(max(tf * idf), 6) AS top FROM f JOIN i USING (term) GROUP BY 1")
def v10(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)).alias("words"))
    rows = document_weights(docs, "doc_id", "words", "pairs")
    norm = F.sqrt(F.aggregate("weights", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("doc_id", F.size("weights").cast("long").alias("terms"), F.round(norm, 6).alias("norm"), F.round(F.array_max("weights"), 6).alias("top"))


@query("v11_l2_logistic")
def v11(spark, d):
    """Chance of y from imputed, scaled and one-hot features: coefficients of an L2 logistic regression."""
    return T.logistic_coefficients(_features(spark, d), ["y0", "l_quantity", "l_tax"], ["lang", "route"], "y", "w", strength=0.01)


@query("v12_cross_fit")
def v12(spark, d):
    """Predictions of each fold's rows by a fit on the others, with weights capped at their 99th percentile."""
    out = T.cross_fitted(_features(spark, d), ["y0", "l_quantity", "l_tax"], ["lang", "route"], "y", "w", "fold", 3, strength=0.01)
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("brier"))


def _features(spark, d) -> DataFrame:
    f = analysis_frame(spark, d)
    number = lambda c: F.col(c).cast("double").alias(c)
    return f.select(number("y"), number("y0"), number("l_quantity"), number("l_tax"), "lang", "route", (1 / (1 + F.col("l_quantity"))).cast("double").alias("w"), F.pmod(F.col("cluster"), F.lit(3)).cast("int").alias("fold"))
