"""Joins and their contracts, ledgers, gates and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import contracts as K, descriptive as D
from ledgerloom.plans import release as G
from ledgerloom.plans.frame import analysis_frame, with_frame
from ledgerloom.plans.register import query
from ledgerloom.sources import ledgers as L
from ledgerloom.sources.tables import table
from ledgerloom.streaming import ledger as R


@query("s6_contract_violations", "SELECT * FROM (SELECT 'enum:event_type' AS \"check\", '' AS detail, sum((event_type NOT IN ('click', 'view', 'purchase'))::INT)::BIGINT AS n FROM events UNION ALL SELECT 'row:value', '', sum((NOT coalesce(value >= 1, false))::INT)::BIGINT FROM events UNION ALL SELECT 'key', 'user_id, event_type', count(*) FROM (SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) > 1)) WHERE n > 0")
def s6(spark, d):
    contract = K.Contract(columns=["event_id", "ts"], key=["user_id", "event_type"], enums={"event_type": ["click", "view", "purchase"]}, checks={"value": F.col("value") >= 1})
    return contract.violations(table(spark, d, "events"))


@query("s7_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def s7(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_quantity")


@query("s2_drop_error_lines", "SELECT event_id, (json_extract(props, '$.k'))::INT AS k FROM events WHERE NOT contains(props, '7')")
def s2(spark, d):
    return table(spark, d, "events").filter(~F.col("props").contains("7")).select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("s4_tolerant_parse", "SELECT count(*) AS lines, sum((event_id % 5 <> 0)::INT)::BIGINT AS parsed FROM events")
def s4(spark, d):
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{bad "), "props")).otherwise(F.col("props"))
    got = F.from_json(line, "k int, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return table(spark, d, "events").select(got.alias("r")).agg(F.count("*").alias("lines"), F.count_if(F.col("r._corrupt_record").isNull()).alias("parsed"))


@query("s10_wide_to_vector", "SELECT l_orderkey, round(sqrt(sum(l_tax * l_tax + l_discount * l_discount)), 9) AS norm FROM lineitem GROUP BY 1")
def s10(spark, d):
    df = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_tax") * F.col("l_tax")).alias("v2"), F.sum(F.col("l_discount") * F.col("l_discount")).alias("v1"))
    return L.wide_to_vector(df, "l_orderkey", "v").select("l_orderkey", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)).alias("norm"))


@query("k3_json_array", "SELECT '[' || string_agg('{\"r_regionkey\":' || r_regionkey || ',\"n\":' || n || '}', ',' ORDER BY r_regionkey) || ']' AS json FROM (SELECT n_regionkey AS r_regionkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)")
def k3(spark, d):
    df = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    return L.json_array(df, ["r_regionkey"])


@query("k7_upsert", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'orders' ELSE 'customer' END AS origin FROM customer")
def k7(spark, d):
    old = table(spark, d, "customer").select("c_custkey", F.lit("customer").alias("origin"))
    return L.upsert(old, table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("origin", F.lit("orders")), ["c_custkey"])


@query("j1_left_join_drop", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey WHERE p_brand IS NOT NULL")
def j1(spark, d):
    parts = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, "l_partkey", "left").filter("p_brand is not null")


@query("j2_metadata_agreement", "SELECT count(*) AS checked, sum((d.n_chars <> length(d.text))::INT)::BIGINT AS disagree FROM documents d JOIN labels l USING (doc_id)")
def j2(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return df.agg(F.count("*").alias("checked"), F.count_if(F.col("n_chars") != F.length("text")).alias("disagree"))


@query("j3_exact_key_join", "SELECT a.c_custkey, a.c_mktsegment, b.c_acctbal FROM customer a JOIN customer b USING (c_custkey)")
def j3(spark, d):
    c = table(spark, d, "customer")
    return K.exact_key_join(c.select("c_custkey", "c_mktsegment"), c.select("c_custkey", "c_acctbal"), ["c_custkey"])


@query("j5_checked_many_to_one", "SELECT o_orderstatus, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def j5(spark, d):
    joined = K.checked_join(table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), table(spark, d, "customer").withColumnRenamed("c_custkey", "k"), ["k"])
    return joined.groupBy("o_orderstatus", "c_mktsegment").agg(F.count("*").alias("n"))


@query("j6_match_report", "SELECT CASE WHEN a.doc_id IS NULL THEN 'right_only' WHEN b.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id GROUP BY 1")
def j6(spark, d):
    return K.match_report(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).groupBy("side").agg(F.count("*").alias("n"))


@query("j7_missing_partition", "SELECT lang, count(*) AS missing FROM documents ANTI JOIN labels USING (doc_id) GROUP BY 1")
def j7(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("missing"))


@query("j8_tuple_exclusion", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = lineitem.l_orderkey AND b.l_suppkey = lineitem.l_suppkey AND b.l_returnflag = 'R') GROUP BY ALL")
def j8(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    return df.join(df.filter("l_returnflag = 'R'").select("l_orderkey", "l_suppkey").distinct(), ["l_orderkey", "l_suppkey"], "left_anti").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))


@query("j9_disjointness", "SELECT count(*) = 0 AS disjoint, count(*) AS shared FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1)")
def j9(spark, d):
    lab = table(spark, d, "labels")
    both = lab.filter("quality = 1").select("doc_id").distinct().join(lab.filter("toxic = 1"), "doc_id", "left_semi")
    return both.agg((F.count("*") == 0).alias("disjoint"), F.count("*").alias("shared"))


@query("j12_grid_left_join", with_frame("SELECT g.m AS model, g.l AS lang, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT model AS m FROM frame), (SELECT DISTINCT lang AS l FROM frame)) g LEFT JOIN (SELECT model, lang, count(*) AS n FROM frame WHERE y = 1 AND y2 = 1 GROUP BY ALL) f ON g.m = f.model AND g.l = f.lang"))
def j12(spark, d):
    df = analysis_frame(spark, d)
    n = df.filter("y = 1 and y2 = 1").groupBy("model", "lang").agg(F.count("*").alias("n"))
    return D.grid(df, "model", "lang").join(n, ["model", "lang"], "left").select("model", "lang", F.coalesce("n", F.lit(0)).alias("n"))


@query("j13_suffix_join", "SELECT doc_id, a.quality AS quality_first, b.toxic AS quality_second FROM labels a JOIN labels b USING (doc_id)")
def j13(spark, d):
    a = table(spark, d, "labels")
    return a.select("doc_id", F.col("quality").alias("quality_first")).join(a.select("doc_id", F.col("toxic").alias("quality_second")), "doc_id")


@query("j14_lookup_conflicts", "SELECT text_hash, n, langs FROM (SELECT md5(text) AS text_hash, count(*) AS n, count(DISTINCT source) AS langs FROM documents GROUP BY 1) WHERE langs > 1")
def j14(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("text_hash")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("langs")).filter("langs > 1")


@query("j15_relational_division", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def j15(spark, d):
    o = table(spark, d, "orders")
    k = o.agg(F.countDistinct("o_orderpriority").alias("k"))
    return o.groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("have")).crossJoin(F.broadcast(k)).filter("have = k").select("o_custkey")  # one row


@query("j16_two_hop_join", "SELECT c_mktsegment, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def j16(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_quantity").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return df.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@query("j17_drift", "SELECT doc_id, a.h AS old, b.h AS new FROM (SELECT doc_id, lang AS h FROM documents) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'xx' ELSE lang END AS h FROM documents WHERE doc_id % 70 <> 0) b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h")
def j17(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    new = docs.filter("doc_id % 70 <> 0").withColumn("lang", F.when(F.col("doc_id") % 50 == 0, "xx").otherwise(F.col("lang")))
    return K.drift(docs, new, ["doc_id"], "lang")


@query("r1_resume", "SELECT event_id FROM events WHERE value >= 1 AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click' AND value >= 1)")
def r1(spark, d):
    e = table(spark, d, "events").filter("value >= 1")
    return e.select("event_id").join(e.filter("event_type = 'click'").select("event_id"), "event_id", "left_anti")


@query("r2_running_status", "SELECT event_type, count(*) FILTER (value >= 1) AS ok, count(*) FILTER (NOT value >= 1) AS errors FROM events GROUP BY 1")
def r2(spark, d):
    return R.running_status(table(spark, d, "events"), ["event_type"], F.col("value") >= 1)


@query("r7_event_windows", "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def r7(spark, d):
    out = R.windows(table(spark, d, "events"), "ts", "6 hours", "1 hour", ["event_type"])
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz"), "total": F.round("total", 6)})


@query("r7_sessions", "WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTES, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS \"end\", count(*) AS n FROM s GROUP BY user_id, s")
def r7s(spark, d):
    out = R.sessions(table(spark, d, "events"), "ts", "30 minutes", "1 hour", ["user_id"])
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("g1_acceptance", "SELECT 'quantity_positive' AS \"check\", CASE WHEN sum((l_quantity <= 0)::INT) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, sum((l_quantity <= 0)::INT)::BIGINT AS bad FROM lineitem UNION ALL SELECT 'discount_low', CASE WHEN sum((l_discount > 0.05)::INT) = 0 THEN 'PASS' ELSE 'FAIL' END, sum((l_discount > 0.05)::INT)::BIGINT FROM lineitem")
def g1(spark, d):
    df = table(spark, d, "lineitem")
    return G.acceptance([G.check(df, "quantity_positive", F.col("l_quantity") <= 0), G.check(df, "discount_low", F.col("l_discount") > 0.05)])


@query("g2_shares_sum_to_one", with_frame(", s AS (SELECT model, lang, count(*) / sum(count(*)) OVER (PARTITION BY model) AS share FROM frame GROUP BY model, lang) SELECT model, round(sum(share), 9) AS s, abs(sum(share) - 1) <= 1e-10 AS ok FROM s GROUP BY 1"))
def g2(spark, d):
    return G.sums_to_one(D.value_shares(analysis_frame(spark, d), ["model", "lang"], ["model"]), ["model"], "share")


@query("g3_inventory", "SELECT name, problem FROM (SELECT DISTINCT source AS name, 'unexpected' AS problem FROM documents WHERE source NOT IN ('src0', 'src1', 'src2', 'srcX') UNION ALL SELECT x, 'missing' FROM (VALUES ('src0'), ('src1'), ('src2'), ('srcX')) v(x) WHERE x NOT IN (SELECT source FROM documents)) WHERE name IS NOT NULL")
def g3(spark, d):
    expected = spark.createDataFrame([("src0",), ("src1",), ("src2",), ("srcX",)], "name string")
    found = table(spark, d, "documents").select(F.col("source").alias("name"))
    out = G.inventory(found, expected, "name")
    return out


@query("g4_content_manifest", "WITH h AS (SELECT sha256(c_custkey::VARCHAR || chr(0) || c_mktsegment) AS h, c_custkey FROM customer) SELECT 'customer' AS kind, count(*) AS rows, count(DISTINCT c_custkey) AS keys, sum(('0x' || substr(h, 1, 8))::BIGINT)::VARCHAR || '-' || sum(('0x' || substr(h, 9, 8))::BIGINT)::VARCHAR AS digest FROM h")
def g4(spark, d):
    return G.content_manifest(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "customer", ["c_custkey"])


@query("g10_contract_summary", with_frame("SELECT count(*) AS n, count(DISTINCT model) AS models, count(DISTINCT cluster) AS clusters, count(DISTINCT lang) AS langs, sum(y)::BIGINT AS events, count(y0) AS original_known FROM frame"))
def g10(spark, d):
    return analysis_frame(spark, d).agg(F.count("*").alias("n"), F.countDistinct("model").alias("models"), F.countDistinct("cluster").alias("clusters"), F.countDistinct("lang").alias("langs"), F.sum("y").alias("events"), F.count("y0").alias("original_known"))


@query("g12_text_hashes", "SELECT lang, count(*) AS rows, count(DISTINCT sha256(text)) AS texts, min(sha256(text)) AS first_hash FROM documents GROUP BY 1")
def g12(spark, d):
    h = F.sha2("text", 256)
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("rows"), F.countDistinct(h).alias("texts"), F.min(h).alias("first_hash"))
