"""Scans, derivations, aggregates, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions import expressions as X
from ledgerloom.operators import descriptive as D
from ledgerloom.operators.quantiles import exact_quantiles
from ledgerloom.plans.frame import analysis_frame, with_frame
from ledgerloom.plans.register import query
from ledgerloom.sources.tables import table

R = "round({}, 9)"


@query("home_rates", with_frame("SELECT jurisdiction, home_status, count(*) AS n, count(y) AS known, sum(y)::BIGINT AS events, round(avg(y), 9) AS rate FROM frame GROUP BY ALL"))
def home_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rates(analysis_frame(spark, sf_dir), ["jurisdiction", "home_status"], "y")


@query("p1_validity_filter", "SELECT event_type, count(*) AS n, sum(((json_extract(props, '$.k'))::INT BETWEEN 1 AND 5)::INT)::BIGINT AS valid FROM events GROUP BY ALL")
def p1(spark, d):
    code = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(X.in_range(code).cast("int")).alias("valid"))


@query("p2_ordered_case", "SELECT CASE WHEN l_quantity <= 10 THEN 'low' WHEN l_quantity <= 25 THEN 'middle' WHEN l_quantity <= 40 THEN 'high' ELSE 'top' END AS category, count(*) AS n, CASE min(l_quantity) WHEN 0 THEN 0 ELSE (CASE WHEN max(l_quantity) <= 10 THEN 1 WHEN max(l_quantity) <= 25 THEN 2 WHEN max(l_quantity) <= 40 THEN 3 ELSE 4 END) END AS place FROM lineitem GROUP BY 1")
def p2(spark, d):
    q = F.col("l_quantity")
    names = ["low", "middle", "high", "top"]
    category = X.first_match([(q <= 10, "low"), (q <= 25, "middle"), (q <= 40, "high")], "top")
    place = F.array_position(F.array(*map(F.lit, names)), F.col("category")).cast("int")
    return table(spark, d, "lineitem").select(category.alias("category")).groupBy("category").agg(F.count("*").alias("n")).withColumn("place", place)


@query("p4_default_if_empty", "SELECT doc_id, CASE WHEN source IS NULL OR source = '' OR source = 'src0' THEN 'unknown' ELSE source END AS source, coalesce(nullif(lang, ''), 'en') AS lang FROM documents")
def p4(spark, d):
    source = X.default_if_empty(F.when(F.col("source") != "src0", F.col("source")), "unknown")
    return table(spark, d, "documents").select("doc_id", source.alias("source"), X.default_if_empty(F.col("lang"), "en").alias("lang"))


@query("p5_home_status", with_frame("SELECT region_focus, jurisdiction, home_status, count(*) AS n FROM frame GROUP BY ALL"))
def p5(spark, d):
    return analysis_frame(spark, d).groupBy("region_focus", "jurisdiction", "home_status").agg(F.count("*").alias("n"))


_LABELS = """labels_ AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'explicit' WHEN quality = 0 THEN 'implicit' ELSE 'none' END AS substantive,
    CASE WHEN quality = 1 THEN 'coherent' WHEN doc_id % 2 = 0 THEN 'partly_coherent' ELSE 'incoherent_garbled' END AS quality,
    CASE WHEN doc_id % 11 = 0 THEN 'wrong_language' ELSE 'same' END AS fidelity, CASE WHEN doc_id % 13 = 0 THEN 'truncated' ELSE 'none' END AS technical FROM labels)"""


def seven_fields(spark: SparkSession, d: str) -> DataFrame:
    """Label fields derived from the two ratings and the id."""
    i = F.col("doc_id")
    return table(spark, d, "labels").select(
        "doc_id", X.first_match([(F.col("toxic") == 1, "explicit"), (F.col("quality") == 0, "implicit")], "none").alias("substantive"),
        X.first_match([(F.col("quality") == 1, "coherent"), (i % 2 == 0, "partly_coherent")], "incoherent_garbled").alias("quality"),
        F.when(i % 11 == 0, "wrong_language").otherwise("same").alias("fidelity"), F.when(i % 13 == 0, "truncated").otherwise("none").alias("technical"),
    )


@query("p6_refusal_and_failure", f"WITH {_LABELS} SELECT doc_id, substantive IN ('explicit', 'implicit') AND quality IN ('coherent', 'partly_coherent') AS refusal, fidelity = 'wrong_language' OR quality = 'incoherent_garbled' OR technical <> 'none' AS failure, fidelity = 'wrong_language' OR quality = 'incoherent_garbled' AS failure_v22 FROM labels_")
def p6(spark, d):
    c = [F.col(x) for x in ("fidelity", "quality", "technical")]
    return seven_fields(spark, d).select("doc_id", X.genuine_refusal(F.col("substantive"), F.col("quality")).alias("refusal"), X.capability_failure(*c).alias("failure"), X.capability_failure(*c, version="2.2").alias("failure_v22"))


@query("p7_overlap_state", f"WITH {_LABELS}, s AS (SELECT substantive IN ('explicit', 'implicit') AND quality IN ('coherent', 'partly_coherent') AS r, fidelity = 'wrong_language' OR quality = 'incoherent_garbled' OR technical <> 'none' AS f FROM labels_) SELECT CASE WHEN r AND f THEN 'both' WHEN r THEN 'refusal_only' WHEN f THEN 'failure_only' ELSE 'neither' END AS state, count(*) AS n FROM s GROUP BY 1")
def p7(spark, d):
    r, f = X.genuine_refusal(F.col("substantive"), F.col("quality")), X.capability_failure(*[F.col(x) for x in ("fidelity", "quality", "technical")])
    return seven_fields(spark, d).select(X.overlap_state(r, f).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query("p8_priority_class", with_frame("SELECT CASE WHEN y0 = 1 THEN 'original_nonengagement' WHEN y2 = 1 AND tier = 'O' THEN 'predicted_capability' WHEN y = 1 THEN 'predicted_refusal' WHEN l_tax >= 0.07 THEN 'predicted_pivot' WHEN l_quantity < 3 THEN 'diagnostic_flag' ELSE 'ordinary_control' END AS class, count(*) AS n FROM frame GROUP BY 1"))
def p8(spark, d):
    cases = [(F.col("y0") == 1, "original_nonengagement"), ((F.col("y2") == 1) & (F.col("tier") == "O"), "predicted_capability"), (F.col("y") == 1, "predicted_refusal"), (F.col("l_tax") >= 0.07, "predicted_pivot"), (F.col("l_quantity") < 3, "diagnostic_flag")]
    return analysis_frame(spark, d).select(X.first_match(cases, "ordinary_control").alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("p10_routing_strata", with_frame("SELECT CASE WHEN y = 1 AND y2 = 1 THEN 'joint' WHEN y2 = 1 THEN 'diagnostic' WHEN y = 1 THEN 'primary' WHEN tier = 'O' THEN 'boundary' ELSE 'regular' END AS stratum, count(*) AS n FROM frame GROUP BY 1"))
def p10(spark, d):
    y, y2 = F.col("y") == 1, F.col("y2") == 1
    return analysis_frame(spark, d).select(X.last_match([(F.col("tier") == "O", "boundary"), (y, "primary"), (y2, "diagnostic"), (y & y2, "joint")], "regular").alias("stratum")).groupBy("stratum").agg(F.count("*").alias("n"))


@query("p11_argmax_strata", "SELECT CASE WHEN greatest(l_discount * 10, l_tax * 12.5, l_quantity / 50) < 0.9 THEN 'none' WHEN l_discount * 10 = greatest(l_discount * 10, l_tax * 12.5, l_quantity / 50) THEN 'discount' WHEN l_tax * 12.5 = greatest(l_discount * 10, l_tax * 12.5, l_quantity / 50) THEN 'tax' ELSE 'quantity' END AS stratum, count(*) AS n FROM lineitem GROUP BY 1")
def p11(spark, d):
    scores = {"discount": F.col("l_discount") * 10, "tax": F.col("l_tax") * 12.5, "quantity": F.col("l_quantity") / 50}
    return table(spark, d, "lineitem").select(X.argmax_name(scores, 0.9, "none").alias("stratum")).groupBy("stratum").agg(F.count("*").alias("n"))


@query("p13_percent_points", with_frame("SELECT model, round(100 * avg(y), 9) AS rate_pp FROM frame GROUP BY 1"))
def p13(spark, d):
    return analysis_frame(spark, d).groupBy("model").agg(X.percent_points(F.avg("y")).alias("rate_pp"))


@query("p14_row_hash", "SELECT conv_id, turn, sha256(role || chr(0) || text) AS hash, substr(sha256(conv_id::VARCHAR || chr(0) || turn::VARCHAR), 1, 24) AS id, conv_id || '‖' || turn AS key FROM conversations")
def p14(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.row_hash(F.col("role"), F.col("text")).alias("hash"), X.short_id(F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), X.key_string(F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"))


@query("p18_length_bands", "WITH c AS (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS c FROM documents) SELECT (CASE WHEN n_chars > c[3] THEN 3 WHEN n_chars > c[2] THEN 2 WHEN n_chars > c[1] THEN 1 ELSE 0 END) AS band, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM documents, c GROUP BY 1")
def p18(spark, d):
    return D.length_bands(table(spark, d, "documents").select("n_chars"), "n_chars").groupBy("band").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("p19_facet_search", "SELECT conv_id, turn, role, length(text) AS chars FROM conversations WHERE role IN ('user', 'assistant') AND contains(lower(text), 'the')")
def p19(spark, d):
    return table(spark, d, "conversations").filter(F.col("role").isin("user", "assistant") & F.lower("text").contains("the")).select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query("p20_candidate_mask", with_frame("SELECT model, tier, count(*) AS n FROM frame WHERE y0 IS NOT NULL AND y0 <> y AND lang <> 'N' GROUP BY ALL"))
def p20(spark, d):
    df = analysis_frame(spark, d).filter(F.col("y0").isNotNull() & (F.col("y0") != F.col("y")) & (F.col("lang") != "N"))
    return df.groupBy("model", "tier").agg(F.count("*").alias("n"))


@query("p21_area_classify", "SELECT CASE WHEN regexp_matches(lower(url), '/(de|fr)/') THEN regexp_extract(lower(url), '/(de|fr)/', 1) WHEN contains(lower(url), 'spam') THEN 'disputed' ELSE 'none' END AS area, count(*) AS n FROM pages GROUP BY 1")
def p21(spark, d):
    url = F.lower("url")
    code = F.regexp_extract(url, "/(de|fr)/", 1)
    return table(spark, d, "pages").select(F.when(code != "", code).when(url.contains("spam"), "disputed").otherwise("none").alias("area")).groupBy("area").agg(F.count("*").alias("n"))


@query("p22_contention_score", "SELECT o_orderkey, round(log10(1 + o_totalprice) / 6, 9) AS raw, least(1.0::DOUBLE, round(log10(1 + o_totalprice) / 6, 9)) AS score FROM orders")
def p22(spark, d):
    raw = F.round(F.log10(1 + F.col("o_totalprice")) / 6, 9)
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw"), F.least(F.lit(1.0), raw).alias("score"))


@query("p23_viability_gate", with_frame("SELECT model, lang, count(*) AS n, round(avg(y), 9) AS rate, CASE WHEN avg(y) <= 0.14 THEN 'approve' WHEN avg(y) <= 0.15 THEN 'conditional' ELSE 'reject' END AS gate FROM frame GROUP BY ALL"))
def p23(spark, d):
    df = analysis_frame(spark, d).groupBy("model", "lang").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))
    return df.withColumn("gate", X.first_match([(F.col("rate") <= 0.14, "approve"), (F.col("rate") <= 0.15, "conditional")], "reject"))


@query("p24_conditional_update", "SELECT c_custkey, CASE WHEN k IS NOT NULL THEN 'flagged' ELSE c_mktsegment END AS segment FROM customer LEFT JOIN (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON c_custkey = k")
def p24(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), F.lit("flagged").alias("new")).distinct()
    return table(spark, d, "customer").join(big, "c_custkey", "left").select("c_custkey", F.coalesce("new", "c_mktsegment").alias("segment"))


@query("p25_delivery_status", "SELECT event_id, CASE WHEN (json_extract(props, '$.k'))::INT IS NULL THEN 'empty' WHEN (json_extract(props, '$.k'))::INT % 10 = 0 THEN 'blocked' WHEN value < 1 THEN 'failed' ELSE 'delivered' END AS status FROM events")
def p25(spark, d):
    props = F.from_json("props", "k int")
    return table(spark, d, "events").select("event_id", X.first_match([(props["k"].isNull(), "empty"), (props["k"] % 10 == 0, "blocked"), (F.col("value") < 1, "failed")], "delivered").alias("status"))


@query("p26_harmonise", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'low' END, CASE WHEN d.n_chars > 4000 THEN 'long' END, CASE WHEN d.lang = 'fr' THEN 'french' END) AS label, CASE WHEN l.quality = 0 THEN 'labels' WHEN d.n_chars > 4000 THEN 'length' WHEN d.lang = 'fr' THEN 'lang' END AS origin FROM documents d LEFT JOIN labels l USING (doc_id)")
def p26(spark, d):
    df = table(spark, d, "documents").select("doc_id", "n_chars", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    found = {"labels": F.when(F.col("quality") == 0, "low"), "length": F.when(F.col("n_chars") > 4000, "long"), "lang": F.when(F.col("lang") == "fr", "french")}
    return df.select("doc_id", F.coalesce(*found.values()).alias("label"), F.coalesce(*[F.when(c.isNotNull(), n) for n, c in found.items()]).alias("origin"))


@query("a1_grouped_rates", with_frame("SELECT model, lang, count(*) AS n, count(y0) AS known, coalesce(sum(y0), 0)::BIGINT AS events, round(avg(y0), 9) AS rate FROM frame GROUP BY ALL"))
def a1(spark, d):
    return D.rates(analysis_frame(spark, d), ["model", "lang"], "y0")


@query("a2_rates_long", with_frame(", u AS (SELECT jurisdiction, home_status, 'y' AS outcome, y AS v FROM frame UNION ALL SELECT jurisdiction, home_status, 'y2', y2 FROM frame UNION ALL SELECT jurisdiction, home_status, 'y0', y0 FROM frame) SELECT jurisdiction, home_status, outcome, count(v) AS n, coalesce(sum(v), 0)::BIGINT AS events, round(coalesce(sum(v), 0)::DOUBLE / nullif(count(v), 0), 9) AS rate FROM u GROUP BY ALL"))
def a2(spark, d):
    return D.rates_long(analysis_frame(spark, d), ["jurisdiction", "home_status"], ["y", "y2", "y0"])


@query("a3_scopes", with_frame("SELECT CASE WHEN grouping(jurisdiction) = 1 THEN 'ALL' ELSE jurisdiction END AS jurisdiction, CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS lang, CASE WHEN grouping(model) = 1 THEN 'ALL' ELSE model END AS model, CASE WHEN grouping(tier) = 1 THEN 'ALL' ELSE tier END AS tier, count(*) AS n, sum(y)::BIGINT AS events, round(avg(y), 9) AS rate FROM frame GROUP BY GROUPING SETS ((), (model), (lang), (tier), (jurisdiction), (model, lang), (jurisdiction, tier))"))
def a3(spark, d):
    return D.scopes(analysis_frame(spark, d), [[], ["model"], ["lang"], ["tier"], ["jurisdiction"], ["model", "lang"], ["jurisdiction", "tier"]], "y")


@query("a4_value_shares", with_frame("SELECT domain, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share, round(count(*) / sum(count(*)) OVER (), 9) AS of_all FROM frame GROUP BY 1"))
def a4(spark, d):
    return D.value_shares(analysis_frame(spark, d), ["domain"], [])


@query("a5_marginals", with_frame(", u AS (SELECT unnest(['tier', 'lang', 'route', 'domain']) AS field, unnest([tier, lang, route, domain]) AS value FROM frame) SELECT field, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY field), 9) AS share FROM u GROUP BY field, value"))
def a5(spark, d):
    return D.marginals(analysis_frame(spark, d), ["tier", "lang", "route", "domain"])


@query("a6_shares_within", with_frame("SELECT jurisdiction, tier, y, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY jurisdiction, tier), 9) AS share, round(count(*) / sum(count(*)) OVER (), 9) AS of_all FROM frame GROUP BY jurisdiction, tier, y"))
def a6(spark, d):
    return D.value_shares(analysis_frame(spark, d), ["jurisdiction", "tier", "y"], ["jurisdiction", "tier"])


@query("a7_conditional_composition", with_frame("SELECT model, domain, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY model), 9) AS share, round(count(*) / sum(count(*)) OVER (), 9) AS of_all FROM frame WHERE y = 1 GROUP BY model, domain"))
def a7(spark, d):
    return D.value_shares(analysis_frame(spark, d).filter("y = 1"), ["model", "domain"], ["model"])


@query("a8_rates_distinct", with_frame("SELECT model, lang, count(*) AS n, count(DISTINCT cluster) AS clusters, round(avg(y), 9) AS rate FROM frame GROUP BY ALL"))
def a8(spark, d):
    return analysis_frame(spark, d).groupBy("model", "lang").agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("clusters"), F.avg("y").alias("rate"))


@query("a9_mean_of_means", with_frame(", a AS (SELECT cluster, lang, jurisdiction, model, avg(y) AS m FROM frame GROUP BY ALL), b AS (SELECT cluster, lang, jurisdiction, avg(m) AS m FROM a GROUP BY ALL), c AS (SELECT cluster, lang, avg(m) AS m FROM b GROUP BY ALL) SELECT lang, round(avg(m), 9) AS mean FROM c GROUP BY 1"))
def a9(spark, d):
    return D.mean_of_means(analysis_frame(spark, d), [["cluster", "lang", "jurisdiction", "model"], ["cluster", "lang", "jurisdiction"], ["cluster", "lang"], ["lang"]], "y")


@query("a10_equal_model_mean", with_frame(", a AS (SELECT jurisdiction, model, avg(y) AS m FROM frame GROUP BY ALL) SELECT jurisdiction, round(avg(m), 9) AS mean FROM a GROUP BY 1"))
def a10(spark, d):
    return D.mean_of_means(analysis_frame(spark, d), [["jurisdiction", "model"], ["jurisdiction"]], "y")


@query("a11_complete_arms", with_frame("SELECT cluster, model, count(*) FILTER (tier = 'F') AS n_first, count(*) FILTER (tier = 'O') AS n_second, round(avg(y) FILTER (tier = 'F'), 9) AS mean_first, round(avg(y) FILTER (tier = 'O'), 9) AS mean_second, count(*) FILTER (tier = 'F') >= 2 AND count(*) FILTER (tier = 'O') >= 2 AS complete FROM frame GROUP BY ALL"))
def a11(spark, d):
    return D.complete_arms(analysis_frame(spark, d), ["cluster", "model"], "tier", "F", "O", "y", least=2)


@query("a12_count_of_counts", with_frame(", a AS (SELECT l_partkey, model, max(y) AS a FROM frame GROUP BY ALL), b AS (SELECT l_partkey, sum(a)::BIGINT AS members FROM a GROUP BY 1) SELECT members, count(*) AS units, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM b GROUP BY 1"))
def a12(spark, d):
    return D.count_of_counts(analysis_frame(spark, d), "l_partkey", "model", "y")


@query("a13_distinct_counts", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS keys FROM lineitem")
def a13(spark, d):
    df = table(spark, d, "lineitem")
    return df.agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_orderkey", "l_linenumber").alias("keys"))


@query("a14_quantiles", "SELECT l_returnflag AS lang, round(median(l_extendedprice), 9) AS median, round(quantile_cont(l_extendedprice, 0.05), 9) AS p05, round(quantile_cont(l_extendedprice, 0.95), 9) AS p95 FROM lineitem GROUP BY 1")
def a14(spark, d):
    return exact_quantiles(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "lang"), ["lang"], "l_extendedprice", {"median": 0.5, "p05": 0.05, "p95": 0.95})


@query("a15_coverage", with_frame("SELECT model, count(*) AS expected, count(y0) AS observed, count(*) - count(y0) AS missing, coalesce(max(y0) = 1, false) AS any_event FROM frame GROUP BY 1"))
def a15(spark, d):
    return analysis_frame(spark, d).groupBy("model").agg(F.count("*").alias("expected"), F.count("y0").alias("observed"), (F.count("*") - F.count("y0")).alias("missing"), F.coalesce(F.bool_or(F.col("y0") == 1), F.lit(False)).alias("any_event"))


@query("a16_unit_summary", with_frame("SELECT cluster, count(*) AS size, round(avg(y), 9) AS mean, count(DISTINCT y) AS values, count(DISTINCT model) AS models FROM frame GROUP BY 1"))
def a16(spark, d):
    return analysis_frame(spark, d).groupBy("cluster").agg(F.count("*").alias("size"), F.avg("y").alias("mean"), F.countDistinct("y").alias("values"), F.countDistinct("model").alias("models"))


@query("a17_crosstab", with_frame("SELECT domain, count(*) FILTER (lang = 'A') AS A, count(*) FILTER (lang = 'N') AS N, count(*) FILTER (lang = 'R') AS R FROM frame GROUP BY 1"))
def a17(spark, d):
    return analysis_frame(spark, d).groupBy("domain").pivot("lang", ["A", "N", "R"]).agg(F.count("lang")).fillna(0)


@query("a18_pivot_means", with_frame("SELECT model, round(avg(y) FILTER (lang = 'A'), 9) AS A, round(avg(y) FILTER (lang = 'N'), 9) AS N, round(avg(y) FILTER (lang = 'R'), 9) AS R FROM frame GROUP BY 1"))
def a18(spark, d):
    return analysis_frame(spark, d).groupBy("model").pivot("lang", ["A", "N", "R"]).agg(F.avg("y"))


@query("a19_filter_pattern", "SELECT user_id, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, bool_and(value > 0) AS all_positive, bool_or(value > 50) AS any_large FROM events GROUP BY 1")
def a19(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.concat_ws(",", F.sort_array(F.collect_set("event_type"))).alias("types"), F.bool_and(F.col("value") > 0).alias("all_positive"), F.bool_or(F.col("value") > 50).alias("any_large"))


@query("a20_bounds", with_frame("SELECT jurisdiction, round(coalesce(sum((y0 = 1)::INT), 0) / count(*), 9) AS low, round((coalesce(sum((y0 = 1)::INT), 0) + sum((y0 IS NULL)::INT)) / count(*), 9) AS high FROM frame GROUP BY 1"))
def a20(spark, d):
    yes, unknown = F.count_if(F.col("y0") == 1), F.count_if(F.col("y0").isNull())
    return analysis_frame(spark, d).groupBy("jurisdiction").agg((yes / F.count("*")).alias("low"), ((yes + unknown) / F.count("*")).alias("high"))


@query("a21_effective_size", "SELECT l_suppkey, round(pow(sum(l_quantity), 2) / sum(l_quantity * l_quantity), 9) AS ess FROM lineitem GROUP BY 1")
def a21(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(D.effective_size("l_quantity").alias("ess"))


@query("a22_merge_editions", "WITH r AS (SELECT text, doc_id, lang, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS k FROM documents), e AS (SELECT text, string_agg(DISTINCT source, ',' ORDER BY source) AS editions, count(DISTINCT source) AS n_editions, count(*) AS copies FROM documents GROUP BY 1) SELECT r.doc_id, r.lang, e.editions, e.n_editions, e.copies FROM r JOIN e USING (text) WHERE k = 1")
def a22(spark, d):
    df = table(spark, d, "documents").groupBy("text").agg(F.min_by(F.struct("doc_id", "lang"), F.struct("source", "doc_id")).alias("pick"), F.sort_array(F.collect_set("source")).alias("s"), F.count("*").alias("copies"))
    return df.select("pick.doc_id", "pick.lang", F.concat_ws(",", "s").alias("editions"), F.size("s").cast("long").alias("n_editions"), "copies")


@query("a24_event_rollup", "SELECT user_id, count(*) AS n, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) AS last_ts FROM events GROUP BY 1")
def a24(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("last_ts"))


@query("a25_flag_counts", "SELECT unnest(string_split(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '/')) AS part, count(*) AS n FROM pages GROUP BY 1")
def a25(spark, d):
    return table(spark, d, "pages").select(F.explode(F.split(F.regexp_replace("url", "^[a-z]+://|[?#].*$", ""), "/")).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("a26_ledger_qa", "WITH k AS (SELECT user_id, event_type, count(*) AS n, sum((value < 1)::INT) AS errors, arg_max(value < 1, (ts, event_id)) AS last_bad FROM events GROUP BY ALL) SELECT event_type, count(*) AS keys, sum((n > 1)::INT)::BIGINT AS duplicated, sum((errors > 0)::INT)::BIGINT AS with_errors, sum((errors = n)::INT)::BIGINT AS unhealed, sum(last_bad::INT)::BIGINT AS last_is_error FROM k GROUP BY 1")
def a26(spark, d):
    bad = F.col("value") < 1
    k = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(bad).alias("errors"), F.max_by(bad, F.struct("ts", "event_id")).alias("last_bad"))
    return k.groupBy("event_type").agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("duplicated"), F.count_if(F.col("errors") > 0).alias("with_errors"), F.count_if(F.col("errors") == F.col("n")).alias("unhealed"), F.count_if("last_bad").alias("last_is_error"))


@query("a27_cost_rollup", "SELECT o_orderpriority, count(*) AS requests, round(sum(o_totalprice), 6) AS cost, quantile_disc(o_totalprice, 0.95) AS p95, round(quantile_disc(o_totalprice, 0.95) * count(*), 6) AS projected FROM orders GROUP BY 1")
def a27(spark, d):
    orders = table(spark, d, "orders")
    df = orders.groupBy("o_orderpriority").agg(F.count("*").alias("requests"), F.round(F.sum("o_totalprice"), 6).alias("cost"))
    df = df.join(exact_quantiles(orders, ["o_orderpriority"], "o_totalprice", {"p95": 0.95}, nearest=True), "o_orderpriority", "left")
    return df.withColumn("projected", F.round(F.col("p95") * F.col("requests"), 6))


@query("w1_w2_concentration", with_frame(", t AS (SELECT model, l_partkey, sum(y)::BIGINT AS total FROM frame GROUP BY ALL) SELECT model, l_partkey, total, row_number() OVER (PARTITION BY model ORDER BY total DESC, l_partkey) AS rank, sum(total) OVER (PARTITION BY model ORDER BY total DESC, l_partkey)::BIGINT AS cumulative, round(sum(total) OVER (PARTITION BY model ORDER BY total DESC, l_partkey) / nullif(sum(total) OVER (PARTITION BY model), 0), 9) AS share FROM t"))
def w1(spark, d):
    return D.concentration(analysis_frame(spark, d), "l_partkey", "y", ["model"])


@query("w3_last_any", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def w3(spark, d):
    return D.last_per_key(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("w4_last_valid", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value >= 1) WHERE k = 1")
def w4(spark, d):
    return D.last_per_key(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], F.col("value") >= 1).select("user_id", "event_type", "event_id", "value")


@query("w5_group_size", "SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem")
def w5(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.count("*").over(Window.partitionBy("l_orderkey")).alias("size"))


@query("w6_percentile_rank", "SELECT p_partkey, round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2) / count(*) OVER (PARTITION BY p_brand), 9) AS pct FROM part")
def w6(spark, d):
    return table(spark, d, "part").select("p_partkey", D.percentile_rank(["p_brand"], F.col("p_size")).alias("pct"))


@query("w7_bands", "SELECT o_orderkey, least(4, floor((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1) * 5 / count(*) OVER (PARTITION BY o_orderpriority)))::INT AS band FROM orders")
def w7(spark, d):
    return table(spark, d, "orders").select("o_orderkey", D.band(["o_orderpriority"], ["o_totalprice", "o_orderkey"]).alias("band"))


@query("w8_sector_index", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT AS sector, count(*) OVER (PARTITION BY s_nationkey) AS sectors FROM supplier")
def w8(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey")
    return table(spark, d, "supplier").select("s_suppkey", F.row_number().over(w.orderBy("s_suppkey")).alias("sector"), F.count("*").over(w).alias("sectors"))


@query("w11_canonical_record", "SELECT c_nationkey, arg_min(c_custkey, (c_mktsegment, -c_acctbal, c_custkey)) AS pick FROM customer GROUP BY 1")
def w11(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct("c_mktsegment", -F.col("c_acctbal"), "c_custkey")).alias("pick"))


@query("w13_reference_value", with_frame(", a AS (SELECT model, lang, avg(y) AS m FROM frame GROUP BY ALL) SELECT model, lang, round(m, 9) AS mean, round(m - max(CASE WHEN lang = 'N' THEN m END) OVER (PARTITION BY model), 9) AS over_reference FROM a"))
def w13(spark, d):
    from pyspark.sql import Window

    a = analysis_frame(spark, d).groupBy("model", "lang").agg(F.avg("y").alias("mean"))
    return a.withColumn("over_reference", F.col("mean") - F.max(F.when(F.col("lang") == "N", F.col("mean"))).over(Window.partitionBy("model")))


@query("w14_threshold_sweep", "WITH t AS (SELECT l_quantity AS threshold, sum((l_discount >= 0.09)::INT) AS pos, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(n) OVER (ORDER BY threshold DESC) AS flagged, sum(pos) OVER () AS positives FROM t) SELECT threshold, tp::BIGINT AS tp, flagged::BIGINT AS flagged, round(2 * tp / (flagged + positives), 9) AS f1 FROM c ORDER BY f1 DESC, threshold LIMIT 1")
def w14(spark, d):
    from ledgerloom.operators.agreement import threshold_frontier

    df = table(spark, d, "lineitem").select("l_quantity", (F.col("l_discount") >= 0.09).cast("int").alias("y"))
    return threshold_frontier(df, "l_quantity", "y").select("threshold", "tp", "flagged", F.round("f1", 9).alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


@query("o2_multi_key_sort", "SELECT l_orderkey, count(*) AS n, coalesce(sum(l_tax), 0) >= 0.3 AS heavy FROM lineitem GROUP BY 1 ORDER BY n DESC, heavy, l_orderkey")
def o2(spark, d):
    df = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), (F.coalesce(X.exact_sum(F.col("l_tax")), F.lit(0)) >= 0.3).alias("heavy"))
    return df.orderBy(F.desc("n"), "heavy", "l_orderkey")


@query("o3_cluster_limit", "WITH c AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY sha256('limit|' || o_custkey), o_custkey LIMIT 100) SELECT o_orderkey, o_custkey FROM orders SEMI JOIN c USING (o_custkey)")
def o3(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    first = orders.select("o_custkey").distinct().orderBy(F.sha2(F.concat_ws("|", F.lit("limit"), F.col("o_custkey").cast("string")), 256), "o_custkey").limit(100)
    return orders.join(first, "o_custkey", "left_semi")


@query("u1_union_by_name", "SELECT doc_id AS id, text, lang, NULL::VARCHAR AS role FROM documents UNION ALL SELECT conv_id, text, NULL, role FROM conversations")
def u1(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return a.unionByName(table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "text", "role"), allowMissingColumns=True)


@query("u2_union_of_samples", "SELECT o_orderkey AS id, bool_or(a) AS first, bool_or(b) AS second FROM (SELECT o_orderkey, o_totalprice > 250000 AS a, o_orderpriority = '1-URGENT' AS b FROM orders) WHERE a OR b GROUP BY 1")
def u2(spark, d):
    o = table(spark, d, "orders")
    a, b = o.filter("o_totalprice > 250000"), o.filter("o_orderpriority = '1-URGENT'")
    return a.select(F.col("o_orderkey").alias("id"), F.lit(True).alias("first"), F.lit(False).alias("second")).unionByName(b.select(F.col("o_orderkey").alias("id"), F.lit(False).alias("first"), F.lit(True).alias("second"))).groupBy("id").agg(F.bool_or("first").alias("first"), F.bool_or("second").alias("second"))


@query("u3_set_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def u3(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("u4_intersection", "SELECT doc_id AS id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def u4(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id")).intersect(table(spark, d, "labels").filter("quality = 1").select("doc_id"))


@query("u6_distinct", with_frame("SELECT DISTINCT model, jurisdiction, lang FROM frame"))
def u6(spark, d):
    return analysis_frame(spark, d).select("model", "jurisdiction", "lang").distinct()
