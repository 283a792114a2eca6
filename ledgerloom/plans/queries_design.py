"""Sampling designs and estimates from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import expressions as X
from ledgerloom.operators import design_estimation as H, designs as D
from ledgerloom.plans.register import query
from ledgerloom.sources.tables import table

_RANK = "row_number() OVER (PARTITION BY {by} ORDER BY sha256('{seed}|' || {unit}), {unit})"
_U = "(('0x' || substr(sha256({}), 1, 12))::UBIGINT / 281474976710656.0::DOUBLE)"


@query("d1_proportional_allocation", "WITH s AS (SELECT o_orderpriority AS stratum, count(*) AS size FROM orders GROUP BY 1), x AS (SELECT *, size * 997 / sum(size) OVER () AS x FROM s), r AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, stratum) AS k, 997 - sum(floor(x)) OVER () AS l FROM x) SELECT stratum, size, (floor(x) + (k <= l)::INT)::BIGINT AS allocated FROM r")
def d1(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stratum")).agg(F.count("*").alias("size"))
    return D.proportional_allocation(s, "stratum", "size", 997)


@query("d2_stratified_sample", f"SELECT c_mktsegment, c_custkey FROM (SELECT *, {_RANK.format(by='c_mktsegment', seed='d2', unit='c_custkey')} AS k FROM customer) WHERE k <= 20")
def d2(spark, d):
    return D.srswor(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], "c_custkey", F.lit(20), "d2").filter("drawn").select("c_mktsegment", "c_custkey")


@query("d3_balanced_quota")
def d3(spark, d):
    """Largest draw of customers by nation and segment within demand and quota (the small table of counts is
    solved on the driver), then the seeded draw itself."""
    customers = table(spark, d, "customer")
    counts = customers.groupBy("c_nationkey", "c_mktsegment").count().collect()
    supply: dict[str, dict[str, int]] = {}
    for r in counts:
        supply.setdefault(str(r[0]), {})[r[1]] = r[2]
    segments = sorted({r[1] for r in counts})
    total = sum(r[2] for r in counts)
    picks = D.balanced_quota(supply, {n: total // 60 for n in supply}, {s: total // 14 for s in segments})
    quota = spark.createDataFrame([(int(n), s, k) for (n, s), k in picks.items()], "c_nationkey int, c_mktsegment string, quota int")
    cells = ["c_nationkey", "c_mktsegment"]
    wanted = customers.select(F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_mktsegment", "c_custkey").join(F.broadcast(quota), cells)  # one row a cell
    return D.srswor(wanted, [*cells, "quota"], "c_custkey", F.col("quota"), "d3").filter("drawn").select(*cells, "c_custkey")


@query("d6_denylist", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def d6(spark, d):
    deny = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(deny, "c_custkey", "left_anti")


@query("d7_srswor", f"WITH k AS (SELECT o_orderkey, o_orderpriority, count(*) OVER (PARTITION BY o_orderpriority) AS stratum_n, {_RANK.format(by='o_orderpriority', seed='d7', unit='o_orderkey')} AS k FROM orders) SELECT o_orderkey, o_orderpriority, stratum_n, least(50, stratum_n) AS draw_n, round(least(50, stratum_n) / stratum_n, 9) AS pi FROM k WHERE k <= 50")
def d7(spark, d):
    out = D.srswor(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey", F.lit(50), "d7")
    return out.filter("drawn").select("o_orderkey", "o_orderpriority", "stratum_n", "draw_n", "pi")


_UNION = f"""WITH a AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice, count(*) OVER () AS N0, count(*) OVER (PARTITION BY o_orderpriority) AS N1, row_number() OVER (ORDER BY sha256('g|' || o_orderkey), o_orderkey) AS k0, {_RANK.format(by='o_orderpriority', seed='c', unit='o_orderkey')} AS k1 FROM orders),
u AS (SELECT *, 1 - (1 - least(200, N0) / N0) * (1 - least(60, N1) / N1) AS pi FROM a WHERE k0 <= 200 OR k1 <= 60)"""


@query("d8_union_probability", _UNION + " SELECT o_orderkey, round(pi, 9) AS pi, round(1 / pi, 9) AS weight FROM u")
def d8(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.lit(1).alias("every"))
    whole = D.srswor(df.select("o_orderkey", "every"), ["every"], "o_orderkey", F.lit(200), "g").select("o_orderkey", F.col("pi").alias("pi0"), F.col("drawn").alias("in0"))
    cells = D.srswor(df.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey", F.lit(60), "c").join(whole, "o_orderkey").filter("in0 or drawn")
    pi = X.union_probability(F.col("pi0"), F.col("pi"))
    return cells.select("o_orderkey", pi.alias("pi"), (1 / pi).alias("weight"))


_NEYMAN = """WITH s AS (SELECT o_orderpriority, count(*) AS size, stddev_samp(o_totalprice) AS spread FROM orders GROUP BY 1), b AS (SELECT sum(least(2, size)) AS base, least(300, sum(size)) AS total FROM s),
g AS (SELECT o_orderpriority, unnest(range(2, least(size, 300))) AS k, size, spread FROM s), r AS (SELECT o_orderpriority, row_number() OVER (ORDER BY pow(size * spread, 2) * (1 / k - 1 / (k + 1)) DESC, o_orderpriority) AS place FROM g)
SELECT o_orderpriority, any_value(size) AS size, (least(2, any_value(size)) + count(*) FILTER (place <= (SELECT total - base FROM b)))::BIGINT AS allocated FROM s LEFT JOIN r USING (o_orderpriority) GROUP BY 1"""


@query("d11_integer_neyman", _NEYMAN)
def d11(spark, d):
    """Allocation over order priorities (a handful of strata) by size and spread of the price."""
    s = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("size"), F.stddev_samp("o_totalprice").alias("spread")).orderBy("o_orderpriority").collect()
    n = D.neyman([r.size for r in s], [r.spread for r in s], min(300, sum(r.size for r in s)), 2)
    return spark.createDataFrame([(r.o_orderpriority, r.size, k) for r, k in zip(s, n, strict=True)], "o_orderpriority string, size long, allocated long")


_LEVEL = """WITH s AS (SELECT l_suppkey, count(*)::DOUBLE AS size, coalesce(count(*) * stddev_samp(l_extendedprice), 0) AS rate, least(2.0::DOUBLE, count(*)) AS low FROM lineitem GROUP BY 1),
t AS (SELECT low / rate AS turn, rate AS slope, -low AS base FROM s WHERE rate > 0 AND size > low UNION ALL SELECT size / rate, -rate, size FROM s WHERE rate > 0 AND size > low),
c AS (SELECT turn, sum(slope) OVER w AS slope, (SELECT sum(low) FROM s) + sum(base) OVER w AS base FROM t WINDOW w AS (ORDER BY turn, slope DESC ROWS UNBOUNDED PRECEDING)),
v AS (SELECT coalesce((SELECT (600 - base) / slope FROM c WHERE turn * slope + base <= 600 AND slope > 0 ORDER BY turn DESC, slope LIMIT 1), 0) AS level),
x AS (SELECT l_suppkey, size, round(least(greatest(level * rate, low), size), 9) AS x FROM s, v),
r AS (SELECT *, round(x - floor(x), 9) AS rest, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, l_suppkey) AS k, 600 - sum(floor(x)) OVER () AS l FROM x)
SELECT l_suppkey, size, (floor(x) + (k <= l AND rest > 0)::INT)::BIGINT AS allocated FROM r"""


@query("d12_bounded_neyman", _LEVEL)
def d12(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("size"), F.stddev_samp("l_extendedprice").alias("spread"))
    return D.bounded_neyman(s, "l_suppkey", "size", "spread", 600, 2).select("l_suppkey", "size", "allocated")


@query("d13_census_and_sample", f"WITH s AS (SELECT o_orderkey, o_totalprice > 350000 AS census, count(*) OVER (PARTITION BY o_totalprice > 350000) AS n, {_RANK.format(by='o_totalprice > 350000', seed='d13', unit='o_orderkey')} AS k FROM orders) SELECT census, count(*) AS drawn, round(sum(CASE WHEN census THEN 1 ELSE n / least(100, n) END), 6) AS weight FROM s WHERE census OR k <= 100 GROUP BY 1")
def d13(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") > 350000).alias("census"))
    out = D.srswor(df, ["census"], "o_orderkey", F.when(F.col("census"), F.lit(2**40)).otherwise(100), "d13")
    return out.filter("drawn").groupBy("census").agg(F.count("*").alias("drawn"), F.round(F.sum(1 / F.col("pi")), 6).alias("weight"))


@query("d14_bernoulli", f"SELECT o_orderkey, round(CASE WHEN o_orderpriority = '1-URGENT' THEN 0.2 ELSE 0.05 END, 9)::DOUBLE AS pi FROM orders WHERE {_U.format('''concat('d14|', o_orderkey)''')} < CASE WHEN o_orderpriority = '1-URGENT' THEN 0.2::DOUBLE ELSE 0.05::DOUBLE END")
def d14(spark, d):
    q = F.when(F.col("o_orderpriority") == "1-URGENT", 0.2).otherwise(0.05)
    return D.bernoulli(table(spark, d, "orders"), "o_orderkey", q, "d14").filter("drawn").select("o_orderkey", "pi")


@query("d21_shards", "SELECT (('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 15))::BIGINT % 40) AS shard, count(*) AS n FROM orders GROUP BY 1")
def d21(spark, d):
    return table(spark, d, "orders").select(D.shard(F.col("o_orderkey"), 40).alias("shard")).groupBy("shard").agg(F.count("*").alias("n"))


@query("d22_cluster_subsample", "WITH c AS (SELECT DISTINCT o_custkey FROM orders), k AS (SELECT o_custkey, row_number() OVER (ORDER BY sha256('d22|' || o_custkey), o_custkey) AS k, count(*) OVER () AS n FROM c) SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT o_custkey FROM k WHERE k <= ceil(n * 0.25)) USING (o_custkey)")
def d22(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = orders.select("o_custkey", F.lit(1).alias("every")).distinct()
    keep = D.srswor(c, ["every"], "o_custkey", F.ceil(F.col("stratum_n") * F.lit(0.25)), "d22").filter("drawn").select("o_custkey")
    return orders.join(keep, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("d23_precision_proxy", "WITH s AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderpriority, n, round(1.959963984540054 * sqrt(0.25 / least(100, n) * (1 - least(100, n) / n)), 9) AS half_width FROM s")
def d23(spark, d):
    s = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    k = F.least(F.lit(100), F.col("n"))
    return s.withColumn("half_width", 1.959963984540054 * F.sqrt(0.25 / k * (1 - k / F.col("n"))))


@query("d24_expected_se", "WITH s AS (SELECT o_orderpriority AS h, count(*) AS n, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT sum(n) AS t FROM s) SELECT b AS budget, round(sqrt(sum(pow(n / t, 2) * v / (b * n / t) * (1 - b / t))), 9) AS se FROM s, t, (SELECT unnest([50, 100, 200]) AS b) GROUP BY 1")
def d24(spark, d):
    from pyspark.sql import Window

    s = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.var_samp("o_totalprice").alias("v")).withColumn("t", F.sum("n").over(Window.partitionBy()))
    s = s.withColumn("budget", F.explode(F.array(F.lit(50), F.lit(100), F.lit(200))))
    share = F.col("n") / F.col("t")
    return s.groupBy("budget").agg(F.sqrt(F.sum(share * share * F.col("v") / (F.col("budget") * share) * (1 - F.col("budget") / F.col("t")))).alias("se"))


@query("d26_smallest_size", """WITH s AS (SELECT o_orderpriority, count(*) AS size, avg((o_totalprice > 250000)::INT) AS p FROM orders GROUP BY 1)
SELECT o_orderpriority, size, list_min(list_filter(range(10, size + 1, 10), lambda n: 1.959963984540054::DOUBLE * sqrt(p * (1 - p) / n * (1 - n / size)) <= 0.06::DOUBLE AND n * p >= 5))::INT AS smallest FROM s""")
def d26(spark, d):
    """Smallest feasible audit of each priority: a narrow interval and enough expected events."""
    s = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("size"), F.avg((F.col("o_totalprice") > 250000).cast("int")).alias("p")).orderBy("o_orderpriority").collect()
    return spark.createDataFrame([(r.o_orderpriority, r.size, D.smallest_size(r.size, r.p, 0.06, 5)) for r in s], "o_orderpriority string, size long, smallest int")


_SAMPLE = f"WITH s AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, (o_totalprice > 200000)::INT AS y, count(*) OVER (PARTITION BY o_orderpriority) AS big, least(80, count(*) OVER (PARTITION BY o_orderpriority)) AS small, {_RANK.format(by='o_orderpriority', seed='h', unit='o_orderkey')} AS k FROM orders), a AS (SELECT *, small / big AS pi FROM s WHERE k <= small)"


def audited(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey", (F.col("o_totalprice") > 200000).cast("int").alias("y"))
    return D.srswor(df, ["o_orderpriority"], "o_orderkey", F.lit(80), "h")


@query("h1_horvitz_thompson", _SAMPLE + " SELECT o_orderstatus, count(*) AS n, round(sum(1 / pi), 6) AS n_hat, round(sum(y / pi), 6) AS total, round(sum(y / pi) / sum(1 / pi), 9) AS mean, round(pow(sum(1 / pi), 2) / sum(1 / (pi * pi)), 6) AS ess FROM a GROUP BY 1")
def h1(spark, d):
    out = H.horvitz_thompson(audited(spark, d).filter("drawn"), ["o_orderstatus"], "y", "pi")
    return out.withColumns({c: F.round(c, 6) for c in ("n_hat", "total", "ess")})


@query("h2_union_variance", f"""WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, (o_totalprice > 200000)::INT::DOUBLE AS y, count(*) OVER (PARTITION BY o_orderpriority)::DOUBLE AS b1, count(*) OVER ()::DOUBLE AS b0,
    row_number() OVER (ORDER BY sha256('g|' || o_orderkey), o_orderkey) AS r0, {_RANK.format(by='o_orderpriority', seed='c', unit='o_orderkey')} AS r1 FROM orders),
q AS (SELECT *, 1 - (1 - n0 / b0) * (1 - n1 / b1) AS pi FROM (SELECT *, least(200, b0) AS n0, least(60, b1) AS n1 FROM o WHERE r0 <= 200 OR r1 <= 60)),
x AS (SELECT a.y / a.pi * b.y / b.pi AS zz, a.pi * b.pi AS pp, a.pi + b.pi - 1 + (a.b0 - a.n0) * (a.b0 - a.n0 - 1) / (a.b0 * (a.b0 - 1))
    * CASE WHEN a.p = b.p THEN (a.b1 - a.n1) * (a.b1 - a.n1 - 1) / (a.b1 * (a.b1 - 1)) ELSE (1 - a.n1 / a.b1) * (1 - b.n1 / b.b1) END AS pij FROM q a JOIN q b ON a.k <> b.k)
SELECT (SELECT round(sum(y / pi), 6) FROM q) AS total, round(greatest(0, (SELECT sum(CASE WHEN pij > 0 THEN 1 - pp / pij ELSE 0 END * zz) FROM x) + (SELECT sum(y * y / (pi * pi) * (1 - pi)) FROM q)), 3) AS variance""")
def h2(spark, d):
    """Total and its variance under the union of a global and a stratified draw, from exact pair probabilities."""
    df = union_sample_columns(spark, d)
    out = H.pairwise_terms(df, "o_orderkey", [([], "big0", "small0"), (["o_orderpriority"], "big1", "small1")], "y")
    return out.select(F.round("total", 6).alias("total"), F.round("variance", 3).alias("variance"))


def union_sample_columns(spark, d):
    from pyspark.sql import Window

    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") > 200000).cast("double").alias("y"))
    n = df.count()
    first = df.orderBy(F.sha2(F.concat_ws("|", F.lit("g"), F.col("o_orderkey").cast("string")), 256), "o_orderkey").limit(200).select("o_orderkey", F.lit(True).alias("g"))
    df = df.join(first, "o_orderkey", "left").withColumn("big1", F.count("*").over(Window.partitionBy("o_orderpriority"))).withColumn("k1", D.seeded_rank("c", "o_orderkey", ["o_orderpriority"]))
    df = df.filter(F.col("g") | (F.col("k1") <= 60))
    return df.withColumns({"big0": F.lit(n), "small0": F.lit(min(200, n)), "small1": F.least(F.lit(60), F.col("big1"))})


@query("h4_ratio_metrics", _SAMPLE + ", g AS (SELECT y, (o_orderstatus = 'F')::INT AS p, pi FROM a) SELECT round(sum(y * p / pi) / sum(p / pi), 9) AS precision, round(sum(y * p / pi) / sum(y / pi), 9) AS recall, round(2 * sum(y * p / pi) / (sum(y / pi) + sum(p / pi)), 9) AS f1, round(sum((y = p)::INT / pi) / sum(1 / pi), 9) AS accuracy FROM g")
def h4(spark, d):
    g = audited(spark, d).filter("drawn").select("y", (F.col("o_orderstatus") == "F").cast("int").alias("p"), "pi")
    w, y, p = 1 / F.col("pi"), F.col("y"), F.col("p")
    return g.agg((F.sum(y * p * w) / F.sum(p * w)).alias("precision"), (F.sum(y * p * w) / F.sum(y * w)).alias("recall"), (2 * F.sum(y * p * w) / (F.sum(y * w) + F.sum(p * w))).alias("f1"), (F.sum((y == p).cast("int") * w) / F.sum(w)).alias("accuracy"))


@query("h5_calibrated_confusion", _SAMPLE + ", c AS (SELECT o_orderstatus AS guess, y AS truth, sum(1 / pi) AS w FROM a GROUP BY ALL), t AS (SELECT o_orderstatus AS guess, count(*) AS total FROM orders GROUP BY 1) SELECT guess, truth, round(w * total / sum(w) OVER (PARTITION BY guess), 6) AS \"count\" FROM c JOIN t USING (guess)")
def h5(spark, d):
    totals = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("guess")).agg(F.count("*").alias("total"))
    out = H.calibrated_confusion(audited(spark, d).filter("drawn").withColumnsRenamed({"o_orderstatus": "guess", "y": "truth"}), "truth", "guess", "pi", totals)
    return out.withColumn("count", F.round("count", 6))


@query("h6_stratified_mean", _SAMPLE + ", h AS (SELECT o_orderpriority, big, count(*) AS n, avg(y) AS m, coalesce(var_samp(y), 0) AS v FROM a GROUP BY ALL) SELECT sum(n)::BIGINT AS n, sum(big)::BIGINT AS population, round(sum(big * m) / sum(big), 9) AS mean, round(sqrt(sum(big::DOUBLE * big * (1 - n / big) * v / n)) / sum(big), 9) AS se FROM h")
def h6(spark, d):
    return H.stratified_mean(audited(spark, d).filter("drawn"), ["o_orderpriority"], "y", "stratum_n")


@query("h7_marginal_estimates", _SAMPLE + " SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'ALL' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN grouping(o_orderstatus) = 1 THEN 'ALL' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, round(sum(y / pi) / sum(1 / pi), 9) AS mean FROM a GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def h7(spark, d):
    a = audited(spark, d).filter("drawn")
    out = a.cube("o_orderpriority", "o_orderstatus").agg(F.grouping("o_orderpriority").alias("gp"), F.grouping("o_orderstatus").alias("gs"), F.count("*").alias("n"), (F.sum(F.col("y") / F.col("pi")) / F.sum(1 / F.col("pi"))).alias("mean"))
    return out.select(F.when(F.col("gp") == 1, "ALL").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"), F.when(F.col("gs") == 1, "ALL").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "n", "mean")


@query("h8_certainty_stratum", "WITH s AS (" + _SAMPLE.split("WITH s AS (", 1)[1].rsplit(", a AS", 1)[0] + " SELECT count(*) FILTER (o_orderstatus = 'P') AS certain, coalesce(sum(y) FILTER (o_orderstatus = 'P'), 0)::DOUBLE AS certain_total, round(coalesce(sum(y / (small / big)) FILTER (o_orderstatus <> 'P' AND k <= small), 0), 6)::DOUBLE AS rest_total FROM s")
def h8(spark, d):
    out = H.certainty_plus_sample(audited(spark, d), F.col("o_orderstatus") == "P", "drawn", "pi", "y")
    return out.withColumn("rest_total", F.round("rest_total", 6))


@query("h10_difference_estimator", "WITH s AS (" + _SAMPLE.split("WITH s AS (", 1)[1].rsplit(", a AS", 1)[0] + ", p AS (SELECT o_orderstatus, 0.3::DOUBLE AS m, CASE WHEN k <= small THEN 0.3 + (y - 0.3) / (small / big) ELSE 0.3 END AS z, k <= small AS drawn FROM s) SELECT o_orderstatus, count(*) AS n, sum(drawn::INT)::BIGINT AS audited, round(avg(m), 9) AS naive, round(avg(z), 9) AS estimate, round(stddev_samp(z) / sqrt(count(*)), 9) AS se FROM p GROUP BY 1")
def h10(spark, d):
    return H.difference_estimator(audited(spark, d).withColumn("m", F.lit(0.3)), ["o_orderstatus"], "m", "y", "pi", "drawn")


@query("h11_design_brier", _SAMPLE + " SELECT o_orderpriority, round(sum(pow(y - 0.3::DOUBLE, 2) / pi) / sum(1 / pi), 9) AS brier, round(sum((y - 0.3::DOUBLE) / pi) / sum(1 / pi), 9) AS residual FROM a GROUP BY 1")
def h11(spark, d):
    w, r = 1 / F.col("pi"), F.col("y") - 0.3
    return audited(spark, d).filter("drawn").groupBy("o_orderpriority").agg((F.sum(r * r * w) / F.sum(w)).alias("brier"), (F.sum(r * w) / F.sum(w)).alias("residual"))


@query("h12_cross_fitted", "WITH s AS (" + _SAMPLE.split("WITH s AS (", 1)[1].rsplit(", a AS", 1)[0].replace("o_orderkey, o_orderpriority", "o_custkey % 5 AS fold, o_orderkey, o_orderpriority", 1) + ", g AS (SELECT o_orderstatus, fold, sum(y) AS s, count(*) AS n FROM s WHERE k <= small GROUP BY ALL), o AS (SELECT o_orderstatus, fold, (sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0) AS m FROM g WINDOW w AS (PARTITION BY o_orderstatus)), q AS (SELECT s.*, coalesce(m, (SELECT avg(y) FROM s WHERE k <= small)) AS m FROM s LEFT JOIN o ON s.o_orderstatus = o.o_orderstatus AND s.fold = o.fold), z AS (SELECT o_orderpriority, m, k <= small AS drawn, CASE WHEN k <= small THEN m + (y - m) / (small / big) ELSE m END AS z FROM q) SELECT o_orderpriority, count(*) AS n, sum(drawn::INT)::BIGINT AS audited, round(avg(m), 9) AS naive, round(avg(z), 9) AS estimate, round(stddev_samp(z) / sqrt(count(*)), 9) AS se FROM z GROUP BY 1")
def h12(spark, d):
    df = audited(spark, d).withColumn("fold", F.col("o_custkey") % 5)
    return H.difference_estimator(H.cross_fitted_means(df, "fold", ["o_orderstatus"], "y", "drawn"), ["o_orderpriority"], "m", "y", "pi", "drawn")


@query("h13_error_grid", "WITH g AS (SELECT p, s FROM (SELECT DISTINCT o_orderpriority AS p FROM orders), (SELECT DISTINCT o_orderstatus AS s FROM orders)), e AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n, sum((o_totalprice > 300000)::INT) AS e FROM orders WHERE o_totalprice > 100000 GROUP BY ALL) SELECT p, s, coalesce(n, 0) AS n, round(e / n, 9) AS rate, CASE WHEN n IS NULL THEN 'empty' ELSE 'observed' END AS status FROM g LEFT JOIN e USING (p, s)")
def h13(spark, d):
    from ledgerloom.operators.descriptive import grid

    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), "o_totalprice")
    e = o.filter("o_totalprice > 100000").groupBy("p", "s").agg(F.count("*").alias("n"), F.avg((F.col("o_totalprice") > 300000).cast("int")).alias("rate"))
    return grid(o, "p", "s").join(e, ["p", "s"], "left").select("p", "s", F.coalesce("n", F.lit(0)).alias("n"), "rate", F.when(F.col("n").isNull(), "empty").otherwise("observed").alias("status"))

