"""Weights, contrasts, standardization, resampling and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import expressions as X
from ledgerloom.operators import agreement as M, contrasts as C, resample as B, standardize as S
from ledgerloom.operators.batched_fits import bootstrap_contrasts
from ledgerloom.plans.frame import analysis_frame, with_frame
from ledgerloom.plans.register import query
from ledgerloom.sources.scratch import scratch_path, written
from ledgerloom.sources.tables import table

NESTED = """, cell AS (SELECT model, cluster, count(*) AS r FROM frame GROUP BY ALL), per AS (SELECT model, count(*) AS i FROM cell GROUP BY 1),
wt AS (SELECT frame.*, 1.0::DOUBLE / (SELECT count(*) FROM per) / per.i / cell.r AS w FROM frame JOIN cell ON frame.model = cell.model AND frame.cluster = cell.cluster JOIN per ON frame.model = per.model)"""


@query("e1_nested_weights", with_frame(NESTED + " SELECT model, count(*) AS n, count(DISTINCT cluster) AS clusters, round(sum(w), 9) AS weight FROM wt GROUP BY 1"))
def e1(spark, d):
    return C.nested_weights(analysis_frame(spark, d), "model", "cluster").groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("clusters"), F.sum("w").alias("weight"))


@query("e2_equal_model_weights", with_frame(", per AS (SELECT model, count(*) AS n FROM frame GROUP BY 1) SELECT jurisdiction, round(sum(1.0::DOUBLE / (SELECT count(*) FROM per) / n), 9) AS weight FROM frame JOIN per ON frame.model = per.model GROUP BY 1"))
def e2(spark, d):
    return C.equal_model_weights(analysis_frame(spark, d), "model").groupBy("jurisdiction").agg(F.sum("w").alias("weight"))


_ARMS = "sum(w * {o}) FILTER (home_status = '{a}' AND {o} IS NOT NULL) / nullif(sum(w) FILTER (home_status = '{a}' AND {o} IS NOT NULL), 0)"


def arms_sql(outcome: str, by: str, source: str = "wt") -> str:
    on, off = (_ARMS.format(o=outcome, a=a) for a in ("home", "away"))
    return f"SELECT {by}, count(*) FILTER (home_status = 'home') AS n_treated, count(*) FILTER (home_status = 'away') AS n_control, round({on}, 9) AS level_treated, round({off}, 9) AS level_control, round({on} - {off}, 9) AS difference FROM {source} GROUP BY {by}"


@query("e3_home_away_difference", with_frame(NESTED + " " + arms_sql("y", "jurisdiction")))
def e3(spark, d):
    return C.arm_difference(C.nested_weights(analysis_frame(spark, d), "model", "cluster"), ["jurisdiction"], "home_status", "home", "away", "y", "w")


def pairs_sql(target: str) -> str:
    return f""", p AS (SELECT cluster, model, avg(y) FILTER (lang = '{target}') AS target, avg(y) FILTER (lang = 'N') AS reference FROM frame WHERE lang IN ('{target}', 'N') GROUP BY ALL),
pp AS (SELECT *, CASE WHEN target IS NULL THEN 'no_target' WHEN reference IS NULL THEN 'no_reference' ELSE 'paired' END AS status, target - reference AS d FROM p)"""


def language_pairs(spark, d, target: str):
    return C.paired(analysis_frame(spark, d), ["cluster", "model"], "lang", target, "N", "y")


@query("e4_paired_language", with_frame(pairs_sql("A") + ", m AS (SELECT model, avg(d) AS d, avg(target) AS t, avg(reference) AS r, count(*) AS n FROM pp WHERE status = 'paired' GROUP BY 1) SELECT count(*) AS models, sum(n)::BIGINT AS pairs, round(avg(t), 9) AS level_target, round(avg(r), 9) AS level_reference, round(avg(d), 9) AS contrast FROM m"))
def e4(spark, d):
    return C.paired_contrast(language_pairs(spark, d, "A"), "model")


@query("e5_paired_response_weighted", with_frame(pairs_sql("R") + " SELECT count(*) AS pairs, round(avg(d), 9) AS contrast FROM pp WHERE status = 'paired'"))
def e5(spark, d):
    return language_pairs(spark, d, "R").filter("status = 'paired'").agg(F.count("*").alias("pairs"), F.avg("d").alias("contrast"))


@query("e6_paired_by_model", with_frame(pairs_sql("A") + " SELECT model, count(*) AS pairs, round(avg(d), 9) AS contrast, round(stddev_samp(d) / sqrt(count(*)), 9) AS se FROM pp WHERE status = 'paired' GROUP BY 1"))
def e6(spark, d):
    return language_pairs(spark, d, "A").filter("status = 'paired'").groupBy("model").agg(F.count("*").alias("pairs"), F.avg("d").alias("contrast"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"))


@query("j11_pair_status", with_frame(pairs_sql("A") + " SELECT model, status, count(*) AS n FROM pp GROUP BY ALL"))
def j11(spark, d):
    return language_pairs(spark, d, "A").groupBy("model", "status").agg(F.count("*").alias("n"))


_BLOCKS = ", b AS (SELECT cluster, model, count(*) FILTER (tier = 'F') AS nf, count(*) FILTER (tier = 'O') AS no, avg(y) FILTER (tier = 'F') AS f, avg(y) FILTER (tier = 'O') AS o FROM frame GROUP BY ALL)"


def framing(spark, d):
    from ledgerloom.operators.descriptive import complete_arms

    return complete_arms(analysis_frame(spark, d), ["cluster", "model"], "tier", "O", "F", "y", least=2)


@query("e7_framing", with_frame(_BLOCKS + " SELECT nf >= 2 AND no >= 2 AS complete, count(*) AS blocks, round(avg(o - f), 9) AS contrast FROM b GROUP BY 1"))
def e7(spark, d):
    return framing(spark, d).groupBy("complete").agg(F.count("*").alias("blocks"), F.avg(F.col("mean_first") - F.col("mean_second")).alias("contrast"))


@query("e8_framing_by_model", with_frame(_BLOCKS + " SELECT model, count(*) AS blocks, round(avg(o), 9) AS level_first, round(avg(f), 9) AS level_second, round(avg(o - f), 9) AS contrast FROM b WHERE nf >= 2 AND no >= 2 GROUP BY 1"))
def e8(spark, d):
    return framing(spark, d).filter("complete").groupBy("model").agg(F.count("*").alias("blocks"), F.avg("mean_first").alias("level_first"), F.avg("mean_second").alias("level_second"), F.avg(F.col("mean_first") - F.col("mean_second")).alias("contrast"))


@query("e9_estimable", with_frame(", e AS (SELECT model, count(*) FILTER (home_status = 'home') AS n_treated, count(*) FILTER (home_status = 'away') AS n_control, coalesce(sum(y) FILTER (home_status = 'home'), 0)::BIGINT AS events_treated, coalesce(sum(y) FILTER (home_status = 'away'), 0)::BIGINT AS events_control FROM frame GROUP BY 1) SELECT *, CASE WHEN n_treated = 0 OR n_control = 0 THEN 'one_arm' WHEN events_treated + events_control < 5 THEN 'few_events' WHEN events_treated + events_control = n_treated + n_control THEN 'no_variation' WHEN events_treated = 0 OR events_treated = n_treated OR events_control = 0 OR events_control = n_control THEN 'separated' ELSE 'ok' END AS reason FROM e"))
def e9(spark, d):
    return C.estimable(analysis_frame(spark, d), ["model"], "home_status", "home", "away", "y")


COVARIATES = ["tier", "domain", "route"]


def home_cells(spark, d, by):
    df = C.with_arms(analysis_frame(spark, d), "home_status", "home", "away")
    return S.cells(df, by, "home_status", "home", COVARIATES, "cluster", "y")


@query("e14_g_computation")
def e14(spark, d):
    """Standardized home contrast of each jurisdiction, with its diagnosis."""
    return S.g_computation(S.without_cluster(home_cells(spark, d, ["jurisdiction"]), ["jurisdiction"], COVARIATES), ["jurisdiction"], COVARIATES)


@query("e10_model_formula", with_frame("""SELECT jurisdiction, lang, concat_ws(' + ', CASE WHEN count(DISTINCT model) > 1 THEN 'y ~ home * model' ELSE 'y ~ home' END, CASE WHEN count(DISTINCT tier) > 1 THEN 'tier' END, CASE WHEN count(DISTINCT domain) > 1 THEN 'domain' END, CASE WHEN count(DISTINCT route) > 1 THEN 'route' END) AS formula,
    concat_ws(',', CASE WHEN count(DISTINCT tier) <= 1 THEN 'tier' END, CASE WHEN count(DISTINCT domain) <= 1 THEN 'domain' END, CASE WHEN count(DISTINCT route) <= 1 THEN 'route' END) AS dropped FROM frame GROUP BY ALL"""))
def e10(spark, d):
    """The formula that each jurisdiction's rows of a language can carry."""
    return S.model_terms(analysis_frame(spark, d), ["jurisdiction", "lang"], COVARIATES, model="model")


_FITS = """, c AS (SELECT l_suppkey, lang, domain, tier, count(*) FILTER (home_status = 'home') AS n1, count(*) FILTER (home_status = 'away') AS n0, coalesce(sum(y) FILTER (home_status = 'home'), 0) AS e1, coalesce(sum(y) FILTER (home_status = 'away'), 0) AS e0 FROM frame WHERE home_status IN ('home', 'away') GROUP BY ALL),
f AS (SELECT *, e1 IN (0, n1) AS s1, e0 IN (0, n0) AS s0 FROM c WHERE e1 > 0 AND e0 > 0 AND e1 + e0 < n1 + n0)"""


def supplier_fits(spark, d):
    """A fit of the arm alone in each small stratum of a supplier that can be estimated: events in both arms, and others."""
    by = ["l_suppkey", "lang", "domain", "tier"]
    df = C.with_arms(analysis_frame(spark, d), "home_status", "home", "away")
    arms = [(1, F.col("home_status") == "home"), (0, F.col("home_status") != "home")]
    wide = df.groupBy(*by).agg(*[x for i, on in arms for x in (F.count_if(on).cast("double").alias(f"n{i}"), F.coalesce(F.sum(F.when(on, F.col("y"))), F.lit(0)).cast("double").alias(f"events{i}"))])
    wide = wide.filter("events1 > 0 and events0 > 0 and events1 + events0 < n1 + n0")
    return S.arm_diagnosis(wide).withColumn("rows", F.col("n1") + F.col("n0"))


@query("e12_separation", with_frame(_FITS + " SELECT l_suppkey, lang, domain, tier, s1 OR s0 AS separated, false AS blocking, round((CASE WHEN s1 THEN n1 ELSE 0 END + CASE WHEN s0 THEN n0 ELSE 0 END) / (n1 + n0), 9) AS observed_extreme, CASE WHEN NOT (s1 OR s0) THEN round(ln(e1 / (n1 - e1)) - ln(e0 / (n0 - e0)), 5) END AS log_odds, CASE WHEN NOT (s1 OR s0) THEN round(sqrt(1 / e1 + 1 / (n1 - e1) + 1 / e0 + 1 / (n0 - e0)), 4) END AS se FROM f"))
def e12(spark, d):
    """Which fits are separated, which of them undefined, and what they estimate otherwise."""
    known = lambda c, digits: F.when(~F.col("separated"), F.round(c, digits)).alias(c)
    return supplier_fits(spark, d).select("l_suppkey", "lang", "domain", "tier", "separated", "blocking", "observed_extreme", known("log_odds", 5), known("se", 4))


@query("e13_counterfactual_extremes", with_frame(_FITS + " SELECT l_suppkey, count(*) AS fits, round(sum((n1 + n0) * (s1 OR s0)::INT) / sum(n1 + n0), 9) AS extreme_weight FROM f GROUP BY 1"))
def e13(spark, d):
    """Share of each supplier's rows for which a prediction of its stratum's fit, arm on or off, is at 0 or 1."""
    w = F.col("rows")
    return supplier_fits(spark, d).groupBy("l_suppkey").agg(F.count("*").alias("fits"), (F.sum(w * F.col("extreme_weight")) / F.sum(w)).alias("extreme_weight"))


@query("e11_firth_logistic")
def e11(spark, d):
    return S.g_computation(S.without_cluster(home_cells(spark, d, ["jurisdiction"]), ["jurisdiction"], COVARIATES), ["jurisdiction"], COVARIATES, firth=True)


@query("e15_standardized_intervals")
def e15(spark, d):
    """The contrast with its interval from 2,000 cluster-bootstrap replicates, fitted in stacks."""
    grouped = written(home_cells(spark, d, ["jurisdiction"]), "home-cells")
    reps = bootstrap_contrasts(grouped, "jurisdiction", COVARIATES, "cluster", 2000, 20)
    point = S.g_computation(S.without_cluster(grouped, ["jurisdiction"], COVARIATES), ["jurisdiction"], COVARIATES)
    return point.join(B.percentile_interval(reps, ["jurisdiction"], 2000), "jurisdiction")


@query("e16_support_cells", with_frame("SELECT model, cluster, count(*) FILTER (home_status = 'home') AS n_treated, count(*) FILTER (home_status = 'away') AS n_control, count(*) FILTER (home_status = 'home') > 0 AND count(*) FILTER (home_status = 'away') > 0 AS supported FROM (SELECT jurisdiction AS model, l_partkey AS cluster, home_status FROM frame) GROUP BY ALL"))
def e16(spark, d):
    df = analysis_frame(spark, d).select(F.col("jurisdiction").alias("model"), F.col("l_partkey").alias("cluster"), "home_status")
    return C.support_cells(df, ["model", "cluster"], "home_status", "home", "away")


@query("e17_common_support", with_frame(", s AS (SELECT jurisdiction, l_partkey FROM frame GROUP BY ALL HAVING count(*) FILTER (home_status = 'home') > 0 AND count(*) FILTER (home_status = 'away') > 0) SELECT jurisdiction, home_status, count(*) AS n, round(avg(y), 9) AS rate FROM frame SEMI JOIN s USING (jurisdiction, l_partkey) GROUP BY ALL"))
def e17(spark, d):
    df = C.common_support(analysis_frame(spark, d), ["jurisdiction", "l_partkey"], "home_status", "home", "away")
    return df.groupBy("jurisdiction", "home_status").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))


@query("e18_original_outcome", with_frame(NESTED + " " + arms_sql("y0", "jurisdiction")))
def e18(spark, d):
    return C.arm_difference(C.nested_weights(analysis_frame(spark, d), "model", "cluster"), ["jurisdiction"], "home_status", "home", "away", "y0", "w")


@query("e19_linear_estimand", with_frame(", k AS (SELECT jurisdiction, y, CASE home_status WHEN 'home' THEN 1.0 / count(*) FILTER (home_status = 'home') OVER (PARTITION BY jurisdiction) WHEN 'away' THEN -1.0 / count(*) FILTER (home_status = 'away') OVER (PARTITION BY jurisdiction) ELSE 0.0 END::DOUBLE AS a FROM frame) SELECT jurisdiction, round(sum(a * y), 9) AS estimate, round(sum(a * a), 9) AS squares FROM k GROUP BY 1"))
def e19(spark, d):
    df = analysis_frame(spark, d).select("jurisdiction", "home_status", "y")
    n = df.groupBy("jurisdiction").agg(*[F.count_if(F.col("home_status") == s).alias(s) for s in ("home", "away")])
    a = F.when(F.col("home_status") == "home", F.try_divide(F.lit(1.0), F.col("home"))).when(F.col("home_status") == "away", F.try_divide(F.lit(-1.0), F.col("away"))).otherwise(F.lit(0.0))
    return df.join(F.broadcast(n), "jurisdiction").groupBy("jurisdiction").agg(F.sum(a * F.col("y")).alias("estimate"), F.sum(a * a).alias("squares"))  # one row a jurisdiction


@query("e20_ridge_moments", """WITH r AS (SELECT l_returnflag, (l_discount >= 0.09)::INT::DOUBLE AS y, l_quantity::DOUBLE AS a, l_tax::DOUBLE AS b, l_extendedprice::DOUBLE AS c FROM lineitem),
m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM r), z AS (SELECT y - my AS y, a - ma AS a, b - mb AS b, c - mc AS c FROM r, m),
s AS (SELECT sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) + 1 AS bb, sum(b * c) AS bc, sum(c * c) + 1 AS cc, sum(a * y) AS ay, sum(b * y) AS byy, sum(c * y) AS cy FROM z),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
k AS (SELECT (ay * (bb * cc - bc * bc) - ab * (byy * cc - bc * cy) + ac * (byy * bc - bb * cy)) / det AS ka, (aa * (byy * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - byy * ac)) / det AS kb,
    (aa * (bb * cy - byy * bc) - ab * (ab * cy - byy * ac) + ay * (ab * bc - bb * ac)) / det AS kc FROM d)
SELECT l_returnflag, round(any_value(my) + any_value(ka) * (avg(a) - any_value(ma)) + any_value(kb) * (avg(b) - any_value(mb)) + any_value(kc) * (avg(c) - any_value(mc)), 9) AS predicted, round(avg(y), 9) AS observed FROM r, m, k GROUP BY 1""")
def e20(spark, d):
    df = table(spark, d, "lineitem").withColumn("y", (F.col("l_discount") >= 0.09).cast("double"))
    names = ["l_quantity", "l_tax", "l_extendedprice"]
    beta = S.ridge_moments(df, names, "y", 1.0)
    terms = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], names, strict=True):
        terms = terms + F.lit(float(b)) * F.col(c)
    return df.select("l_returnflag", terms.alias("m"), "y").groupBy("l_returnflag").agg(F.avg("m").alias("predicted"), F.avg("y").alias("observed"))


_SETS = ", s AS (SELECT jurisdiction, home_status, 'final' AS labels, y AS v FROM frame UNION ALL SELECT jurisdiction, home_status, 'original', y0 FROM frame UNION ALL SELECT jurisdiction, home_status, 'diagnostic', y2 FROM frame), e AS (SELECT jurisdiction, labels, avg(v) FILTER (home_status = 'home') - avg(v) FILTER (home_status = 'away') AS estimate FROM s GROUP BY ALL)"


def label_sets(spark, d):
    df = analysis_frame(spark, d).selectExpr("jurisdiction", "home_status", "stack(3, 'final', y, 'original', y0, 'diagnostic', y2) as (labels, v)")
    arm = lambda a: F.avg(F.when(F.col("home_status") == a, F.col("v")))
    return df.groupBy("jurisdiction", "labels").agg((arm("home") - arm("away")).alias("estimate"))


@query("e22_label_sensitivity", with_frame(_SETS + " SELECT jurisdiction, labels, round(estimate, 9) AS estimate FROM e"))
def e22(spark, d):
    return label_sets(spark, d)


@query("e23_envelope", with_frame(_SETS + " SELECT jurisdiction, round(min(estimate), 9) AS low, round(max(estimate), 9) AS high, count(*) AS label_sets, min(estimate) > 0 OR max(estimate) < 0 AS same_sign FROM e WHERE estimate IS NOT NULL GROUP BY 1"))
def e23(spark, d):
    return C.envelope(label_sets(spark, d).filter("estimate is not null"), ["jurisdiction"])


_U = "(('0x' || substr(sha256({}), 1, 12))::UBIGINT / 281474976710656.0::DOUBLE)"


def draws_sql(seed: str, reps: int) -> str:
    u = _U.format(f"'{seed}|' || rep || '|' || slot")
    return f""", idx AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS slot FROM (SELECT DISTINCT o_custkey AS cluster FROM orders)),
draw AS (SELECT rep, floor({u} * (SELECT count(*) FROM idx))::INT AS pick FROM idx, range(1, {reps + 1}) r(rep)),
dr AS (SELECT rep, cluster, count(*) AS mult FROM draw JOIN idx ON pick = idx.slot GROUP BY ALL)"""


def order_sums(spark, d, stats, by, measures, reps, seed):
    return B.replicate_sums(stats, table(spark, d, "orders").select(F.col("o_custkey").alias("cluster")), "cluster", by, measures, reps, seed)


@query("b1_cluster_bootstrap", with_frame(draws_sql("b1", 2000) + ", st AS (SELECT cluster, jurisdiction, sum(y) AS s, count(*) AS n FROM frame GROUP BY ALL), e AS (SELECT rep, jurisdiction, sum(mult * s) / sum(mult * n) AS estimate FROM st JOIN dr USING (cluster) GROUP BY ALL) SELECT jurisdiction, count(estimate) AS ok, round(quantile_cont(estimate, 0.025), 9) AS low, round(quantile_cont(estimate, 0.975), 9) AS high, 2000 - count(estimate) AS failed, 2000 - count(estimate) <= 40 AS reliable FROM e GROUP BY 1"))
def b1(spark, d):
    stats = analysis_frame(spark, d).groupBy("cluster", "jurisdiction").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    return B.percentile_interval(B.ratio(order_sums(spark, d, stats, ["jurisdiction"], ["s", "n"], 2000, "b1"), ["jurisdiction"]), ["jurisdiction"], 2000)


@query("b1_nested_bootstrap", with_frame(draws_sql("b1n", 2000) + ", st AS (SELECT cluster, model, avg(y) AS mean FROM frame GROUP BY ALL), e AS (SELECT rep, model, sum(mult * mean) / sum(mult) AS m FROM st JOIN dr USING (cluster) GROUP BY ALL) SELECT rep::INT AS rep, round(avg(m), 9) AS estimate FROM e GROUP BY 1"))
def b1n(spark, d):
    stats = analysis_frame(spark, d).groupBy("cluster", "model").agg(F.avg("y").alias("mean"))
    return B.nested_mean(order_sums(spark, d, stats, ["model"], ["mean"], 2000, "b1n"))


@query("b2_paired_bootstrap", with_frame(pairs_sql("A") + draws_sql("b2", 2000) + ", e AS (SELECT rep, sum(mult * d) / sum(mult) AS estimate FROM pp JOIN dr USING (cluster) WHERE status = 'paired' GROUP BY 1) SELECT count(estimate) AS ok, round(quantile_cont(estimate, 0.025), 9) AS low, round(quantile_cont(estimate, 0.975), 9) AS high, 2000 - count(estimate) AS failed, true AS reliable FROM e"))
def b2(spark, d):
    stats = language_pairs(spark, d, "A").filter("status = 'paired'").select("cluster", F.col("d").alias("s"), F.lit(1).alias("n"))
    return B.percentile_interval(B.ratio(order_sums(spark, d, stats, [], ["s", "n"], 2000, "b2"), []), [], 2000, void_if_unreliable=True)


@query("b15_bootstrap_diagnostics", with_frame(draws_sql("b15", 500) + ", s1 AS (SELECT cluster, jurisdiction AS g, sum(y) FILTER (home_status = 'home') AS s, count(*) FILTER (home_status = 'home') AS n FROM frame GROUP BY ALL), s2 AS (SELECT cluster, l_suppkey % 50 AS g, sum(y2) AS s, sum(y) AS n FROM frame WHERE route = 'P' AND l_discount = 0.1 AND l_quantity > 45 GROUP BY ALL), e AS (SELECT 'home/' || g AS label, rep, sum(mult * s) / nullif(sum(mult * n), 0) AS estimate FROM s1 JOIN dr USING (cluster) GROUP BY ALL UNION ALL SELECT 'rare/' || g, rep, sum(mult * s) / nullif(sum(mult * n), 0) FROM s2 JOIN dr USING (cluster) GROUP BY ALL) SELECT 'run-1' AS run_id, label, 500 AS planned, count(estimate) AS ok, 500 - count(estimate) AS failed, 500 - count(estimate) <= 10 AS reliable FROM e GROUP BY ALL"))
def b15(spark, d):
    """How many of 500 replicates have an estimate: home rates by jurisdiction, and a rare ratio by part of suppliers, where
    many fail. Recorded by run and label, once each."""
    df = written(analysis_frame(spark, d).select("cluster", "jurisdiction", (F.col("l_suppkey") % 50).alias("part"), "home_status", "y", "y2", "route", "l_discount", "l_quantity"), "frame")
    home = F.col("home_status") == "home"
    rates = df.groupBy("cluster", "jurisdiction").agg(F.sum(F.when(home, F.col("y"))).alias("s"), F.count_if(home).alias("n"))
    rare = df.filter("route = 'P' and l_discount = 0.1 and l_quantity > 45").groupBy("cluster", "part").agg(F.sum("y2").alias("s"), F.sum("y").alias("n"))
    runs = [(name, B.ratio(order_sums(spark, d, st, [by], ["s", "n"], 500, "b15"), [by])) for name, by, st in (("home", "jurisdiction", rates), ("rare", "part", rare))]
    return B.record(B.diagnostics(runs, "run-1", ["jurisdiction", "part"], 500), scratch_path(spark, "bootstrap-diagnostics"))


@query("b3_jackknife", with_frame(", c AS (SELECT cluster, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS n FROM frame GROUP BY 1), t AS (SELECT sum(s) AS s0, sum(n) AS n0, count(*) AS k FROM c), v AS (SELECT var_pop((s0 - s) / (n0 - n)) AS v FROM c, t), f AS (SELECT k AS clusters, s0 / n0 AS e, sqrt((k - 1) * v) AS se FROM t, v) SELECT clusters, round(e, 9) AS estimate, round(se, 9) AS se, round(e - 1.959963984540054 * se, 9) AS low, round(e + 1.959963984540054 * se, 9) AS high FROM f"))
def b3(spark, d):
    stats = analysis_frame(spark, d).select("cluster", F.col("y").cast("double").alias("s"), F.lit(1.0).alias("n"))
    return B.jackknife(stats, "cluster")


@query("b7_multinomial_counts", with_frame(draws_sql("b7", 2000) + ", st AS (SELECT cluster, tier, count(*) FILTER (y = 1 AND y2 = 1) AS tp, count(*) FILTER (y = 0 AND y2 = 1) AS fp, count(*) FILTER (y = 1 AND y2 = 0) AS fn FROM frame GROUP BY ALL) SELECT rep::INT AS rep, tier, round(2 * sum(mult * tp) / nullif(sum(mult * (2 * tp + fp + fn)), 0), 9) AS f1 FROM st JOIN dr USING (cluster) GROUP BY ALL"))
def b7(spark, d):
    n = lambda a, b: F.count_if((F.col("y") == a) & (F.col("y2") == b))
    st = analysis_frame(spark, d).groupBy("cluster", "tier").agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
    sums = order_sums(spark, d, st, ["tier"], ["tp", "fp", "fn"], 2000, "b7")
    return sums.select("rep", "tier", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


@query("b9_subsample_stability", with_frame(f", ids AS (SELECT DISTINCT o_custkey AS cluster FROM orders), pl AS (SELECT cluster, rep, row_number() OVER (PARTITION BY rep ORDER BY {_U.format('''concat('b9|', rep, '|', cluster)''')}, cluster) AS place, count(*) OVER (PARTITION BY rep) AS size FROM ids, range(1, 101) r(rep)), sub AS (SELECT f AS fraction, rep, cluster FROM pl, (SELECT unnest([0.25::DOUBLE, 0.5, 0.75, 1.0]) AS f) WHERE place <= ceil(f * size)), st AS (SELECT cluster, sum(y) AS s, count(*) AS n FROM frame GROUP BY 1), e AS (SELECT fraction, rep, sum(s)::DOUBLE / sum(n) AS estimate FROM sub JOIN st USING (cluster) GROUP BY ALL) SELECT fraction, count(*) AS draws, round(quantile_cont(estimate, 0.05), 9) AS p05, round(median(estimate), 9) AS median, round(quantile_cont(estimate, 0.95), 9) AS p95 FROM e GROUP BY 1"))
def b9(spark, d):
    st = analysis_frame(spark, d).groupBy("cluster").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    sub = B.subsamples(table(spark, d, "orders").select(F.col("o_custkey").alias("cluster")), "cluster", [0.25, 0.5, 0.75, 1.0], 100, "b9")
    return B.stability(sub.join(st, "cluster").groupBy("fraction", "rep").agg((F.sum("s") / F.sum("n")).alias("estimate")), ["fraction"])


_Z2 = "(1.959963984540054 * 1.959963984540054)"


@query("b12_wilson", with_frame(f", r AS (SELECT model, count(*) AS n, sum(y)::BIGINT AS e FROM frame GROUP BY 1), q AS (SELECT *, e::DOUBLE / n AS p, 1 + {_Z2} / n AS d FROM r) SELECT model, n, e AS events, round((p + {_Z2} / (2 * n)) / d - 1.959963984540054 * sqrt(p * (1 - p) / n + {_Z2} / (4 * n * n)) / d, 9) AS low, round((p + {_Z2} / (2 * n)) / d + 1.959963984540054 * sqrt(p * (1 - p) / n + {_Z2} / (4 * n * n)) / d, 9) AS high FROM q"))
def b12(spark, d):
    r = analysis_frame(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.sum("y").alias("events"))
    low, high = X.wilson(F.col("events"), F.col("n"))
    return r.withColumns({"low": low, "high": high})


@query("b13_logit_interval", with_frame(", r AS (SELECT model, avg(y) AS p, stddev_samp(y) / sqrt(count(*)) AS se FROM frame GROUP BY 1) SELECT model, round(p, 9) AS p, round(1 / (1 + exp(-(ln(p / (1 - p)) - 1.959963984540054 * se / (p * (1 - p))))), 9) AS low, round(1 / (1 + exp(-(ln(p / (1 - p)) + 1.959963984540054 * se / (p * (1 - p))))), 9) AS high FROM r"))
def b13(spark, d):
    r = analysis_frame(spark, d).groupBy("model").agg(F.avg("y").alias("p"), (F.stddev_samp("y") / F.sqrt(F.count("*"))).alias("se"))
    low, high = X.logit_interval(F.col("p"), F.col("se"))
    return r.select("model", "p", low.alias("low"), high.alias("high"))


# Three raters of a document: quality, not toxic, and a length rule; units are documents.
_RATINGS = "r AS (SELECT doc_id AS unit, unnest(['quality', 'clean', 'length']) AS rater, unnest([quality, 1 - toxic, (n_chars > 500)::INT]) AS value FROM labels JOIN documents USING (doc_id))"


def ratings(spark, d):
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return df.selectExpr("doc_id as unit", "stack(3, 'quality', cast(quality as int), 'clean', cast(1 - toxic as int), 'length', cast(n_chars > 500 as int)) as (rater, value)")


_PAIRS = f"WITH {_RATINGS}, p AS (SELECT a.rater AS l, b.rater AS r, count(*) FILTER (a.value = 1 AND b.value = 1) AS x11, count(*) FILTER (a.value = 1 AND b.value = 0) AS x10, count(*) FILTER (a.value = 0 AND b.value = 1) AS x01, count(*) FILTER (a.value = 0 AND b.value = 0) AS x00 FROM r a JOIN r b ON a.unit = b.unit AND a.rater < b.rater GROUP BY ALL)"


@query("m1_positive_agreement", _PAIRS + ' SELECT l AS "left", r AS "right", x11 AS "both", x10 AS only_left, x01 AS only_right, x00 AS neither, round(2 * x11 / nullif(2 * x11 + x10 + x01, 0), 9) AS psa, round((x11 + x00) / (x11 + x10 + x01 + x00), 9) AS agreement FROM p')
def m1(spark, d):
    return M.positive_agreement(M.rater_pairs(ratings(spark, d), ["unit"], "rater", "value"))


@query("m2_unanimity", f'WITH {_RATINGS}, u AS (SELECT unit, bool_or(value = 1) AS a, bool_and(value = 1) AS b FROM r GROUP BY 1) SELECT sum(a::INT)::BIGINT AS "any", sum(b::INT)::BIGINT AS "all", round(sum(b::INT) / sum(a::INT), 9) AS unanimity FROM u')
def m2(spark, d):
    return M.unanimity(ratings(spark, d), ["unit"], "value")


def metrics_sql(by: str, weight: str = "1.0", kappa: str = "NULL", source: str = "frame", truth: str = "y", guess: str = "y2") -> str:
    cells = ", ".join(f"sum(CASE WHEN {truth} = {a} AND {guess} = {b} THEN {weight} ELSE 0 END)::DOUBLE AS {n}" for a, b, n in ((1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn")))
    return f""" , c AS (SELECT {by}, count(*) AS n, {cells} FROM {source} WHERE {truth} IS NOT NULL AND {guess} IS NOT NULL GROUP BY {by}),
k AS (SELECT *, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS acc, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / nullif((tp + fp + fn + tn) * (tp + fp + fn + tn), 0) AS pe FROM c)
SELECT {by}, n, round(tp, 9) AS tp, round(fp, 9) AS fp, round(fn, 9) AS fn, round(tn, 9) AS tn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(tn / nullif(tn + fp, 0), 9) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, round(acc, 9) AS accuracy, round((tp + fn) / nullif(tp + fp + fn + tn, 0), 9) AS prevalence,
    CASE WHEN pe = 1 THEN {kappa}::DOUBLE ELSE round((acc - pe) / nullif(1 - pe, 0), 9) END AS kappa FROM k"""


@query("m3_m7_binary_metrics", with_frame(metrics_sql("lang")))
def m3(spark, d):
    return M.binary_metrics(M.confusion(analysis_frame(spark, d), ["lang"], "y", "y2"))


@query("m4_m6_weighted_metrics", with_frame(metrics_sql("model", weight="l_quantity", kappa="1.0", truth="y0")))
def m4(spark, d):
    return M.binary_metrics(M.confusion(analysis_frame(spark, d), ["model"], "y0", "y2", F.col("l_quantity")), undefined_kappa=1.0)


@query("m8_brier_log_loss", "WITH s AS (SELECT l_returnflag, (l_discount >= 0.09)::INT AS y, l_quantity / 51 AS p FROM lineitem) SELECT l_returnflag, round(avg(pow(y - p, 2)), 9) AS brier, round(avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))), 9) AS log_loss, round((avg(pow(y - p, 2)) FILTER (y = 1) + avg(pow(y - p, 2)) FILTER (y = 0)) / 2, 9) AS balanced FROM s GROUP BY 1")
def m8(spark, d):
    s = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") >= 0.09).cast("int").alias("y"), (F.col("l_quantity") / 51).alias("p"))
    y, p = F.col("y"), F.col("p")
    half = lambda v: F.avg(F.when(y == v, F.pow(y - p, 2)))
    return s.groupBy("l_returnflag").agg(M.brier(y, p).alias("brier"), M.log_loss(y, p).alias("log_loss"), ((half(1) + half(0)) / 2).alias("balanced"))


@query("m9_promotion_gates", with_frame(", g AS (SELECT model, avg((y = y2)::INT) AS accuracy, avg(y) AS rate FROM frame GROUP BY 1) SELECT model, round(accuracy, 9) AS accuracy, round(0.7 * accuracy + 0.3 * (1 - rate), 9) AS score, accuracy >= 0.78 AND rate <= 0.2 AS promoted FROM g"))
def m9(spark, d):
    g = analysis_frame(spark, d).groupBy("model").agg(F.avg((F.col("y") == F.col("y2")).cast("int")).alias("accuracy"), F.avg("y").alias("rate"))
    return g.select("model", "accuracy", (0.7 * F.col("accuracy") + 0.3 * (1 - F.col("rate"))).alias("score"), ((F.col("accuracy") >= 0.78) & (F.col("rate") <= 0.2)).alias("promoted"))


@query("m10_threshold_frontier", "WITH t AS (SELECT l_quantity AS threshold, sum((l_discount >= 0.09)::INT) AS pos, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT threshold, (sum(pos) OVER (ORDER BY threshold DESC))::BIGINT AS tp, (sum(n) OVER (ORDER BY threshold DESC))::BIGINT AS flagged, sum(pos) OVER () AS positives FROM t) SELECT threshold, tp, flagged, round(tp / flagged, 9) AS precision, round(tp / positives, 9) AS recall, round(2 * tp / (flagged + positives), 9) AS f1 FROM c")
def m10(spark, d):
    return M.threshold_frontier(table(spark, d, "lineitem").select("l_quantity", (F.col("l_discount") >= 0.09).cast("int").alias("y")), "l_quantity", "y")


@query("m11_error_profile", with_frame("SELECT lang, tier, y AS truth, y2 AS guess, count(*) AS n FROM frame GROUP BY ALL"))
def m11(spark, d):
    return analysis_frame(spark, d).groupBy("lang", "tier", F.col("y").alias("truth"), F.col("y2").alias("guess")).agg(F.count("*").alias("n"))


@query("m12_krippendorff_nominal", f"WITH {_RATINGS}, n AS (SELECT unit, value AS v, count(*) AS n, sum(count(*)) OVER (PARTITION BY unit) AS m FROM r GROUP BY unit, value), o AS (SELECT a.v AS c, b.v AS k, sum(a.n * (b.n - (a.v = b.v)::INT) / (a.m - 1)) AS o FROM n a JOIN n b ON a.unit = b.unit WHERE a.m > 1 GROUP BY a.v, b.v), g AS (SELECT c, sum(o) AS nc FROM o GROUP BY 1), t AS (SELECT sum(nc) AS N FROM g) SELECT round(N, 9) AS values, round(1 - (SELECT sum(o) FROM o WHERE c <> k) / ((SELECT sum(a.nc * b.nc) FROM g a, g b WHERE a.c <> b.c) / (N - 1)), 9) AS alpha FROM t")
def m12(spark, d):
    return M.krippendorff(ratings(spark, d), ["unit"], "value")


def ordinal_ratings(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.ceil(F.col("l_quantity") / 10).alias("value"))
    return lines


@query("m12_krippendorff_ordinal", """WITH r AS (SELECT l_orderkey AS unit, ceil(l_quantity / 10)::BIGINT AS value FROM lineitem), n AS (SELECT unit, value AS v, count(*) AS n, sum(count(*)) OVER (PARTITION BY unit) AS m FROM r GROUP BY unit, value),
o AS (SELECT a.v AS c, b.v AS k, sum(a.n * (b.n - (a.v = b.v)::INT) / (a.m - 1)) AS o FROM n a JOIN n b ON a.unit = b.unit WHERE a.m > 1 GROUP BY a.v, b.v),
g AS (SELECT c, sum(o) AS nc FROM o GROUP BY 1), s AS (SELECT c, nc, sum(nc) OVER (ORDER BY c) - nc / 2 AS place, sum(nc) OVER () AS N FROM g),
d AS (SELECT a.c, b.c AS k, a.nc * b.nc AS nn, pow(a.place - b.place, 2) AS d2, a.N FROM s a, s b)
SELECT round(any_value(N), 9) AS values, round(1 - sum(coalesce(o, 0) * d2) / (sum(nn * d2) / (any_value(N) - 1)), 9) AS alpha FROM d LEFT JOIN o USING (c, k)""")
def m12o(spark, d):
    return M.krippendorff(ordinal_ratings(spark, d), ["unit"], "value", "ordinal")


@query("m13_gwet_ac1", f"WITH {_RATINGS}, n AS (SELECT unit, value AS v, count(*) AS n, sum(count(*)) OVER (PARTITION BY unit) AS m FROM r GROUP BY unit, value), o AS (SELECT unit, sum(n * (n - 1)) / max(m) / (max(m) - 1) AS a FROM n WHERE m > 1 GROUP BY 1), s AS (SELECT avg(a) AS observed, count(*) AS units FROM o), p AS (SELECT v, sum(n / m) / (SELECT count(DISTINCT unit) FROM n) AS p FROM n GROUP BY 1), c AS (SELECT sum(p * (1 - p)) / (count(*) - 1) AS chance FROM p) SELECT units, round(observed, 9) AS observed, round(chance, 9) AS chance, round((observed - chance) / (1 - chance), 9) AS ac1 FROM s, c")
def m13(spark, d):
    return M.gwet_ac1(ratings(spark, d), ["unit"], "value")


@query("m14_rater_marginals", f"WITH {_RATINGS} SELECT rater, count(*) AS n, sum(value)::BIGINT AS positive, round(avg(value), 9) AS rate FROM r GROUP BY 1")
def m14(spark, d):
    return ratings(spark, d).groupBy("rater").agg(F.count("*").alias("n"), F.sum("value").alias("positive"), F.avg("value").alias("rate"))


@query("m15_rater_matrix", "SELECT doc_id AS unit, quality::BIGINT AS quality, (1 - toxic)::BIGINT AS clean, (n_chars > 500)::BIGINT AS length FROM labels JOIN documents USING (doc_id)")
def m15(spark, d):
    wide = ratings(spark, d).groupBy("unit").pivot("rater", ["quality", "clean", "length"]).agg(F.max("value").cast("long"))
    return wide.filter(F.size(F.array_compact(F.array("quality", "clean", "length"))) >= 2)


@query("m16_weighted_kappa", "WITH c AS (SELECT ceil(l_quantity / 10) AS i, ceil((l_tax * 100 + 1) / 2) AS j, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT i, sum(n) AS ri FROM c GROUP BY 1), k AS (SELECT j, sum(n) AS cj FROM c GROUP BY 1), t AS (SELECT sum(n) AS N FROM c) SELECT round(1 - sum(pow(r.i - k.j, 2) * coalesce(c.n, 0)) / sum(pow(r.i - k.j, 2) * ri * cj / t.N), 9) AS kappa FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.i = r.i AND c.j = k.j")
def m16(spark, d):
    df = table(spark, d, "lineitem").select(F.ceil(F.col("l_quantity") / 10).alias("a"), F.ceil((F.col("l_tax") * 100 + 1) / 2).alias("b"))
    return M.weighted_kappa(df, "a", "b")


@query("m18_multiclass", "WITH s AS (SELECT doc_id, lang AS truth, CASE WHEN contains(text, 'ß') OR contains(text, 'ü') THEN 'de' WHEN contains(text, 'ñ') THEN 'es' WHEN contains(text, 'ç') THEN 'fr' ELSE 'en' END AS guess FROM documents), t AS (SELECT truth AS class, count(*) AS n_true, count(*) FILTER (truth = guess) AS tp FROM s GROUP BY 1), g AS (SELECT guess AS class, count(*) AS n_guess FROM s GROUP BY 1) SELECT class, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp, coalesce(n_guess, 0) AS n_guess, round(tp / nullif(n_guess, 0), 9) AS precision, round(tp / nullif(n_true, 0), 9) AS recall, round(2 * tp / nullif(n_true + n_guess, 0), 9) AS f1 FROM t FULL JOIN g USING (class)")
def m18(spark, d):
    has = lambda c: F.col("text").contains(c)
    guess = X.first_match([(has("ß") | has("ü"), "de"), (has("ñ"), "es"), (has("ç"), "fr")], "en")
    return M.multiclass(table(spark, d, "documents").select(F.col("lang").alias("truth"), guess.alias("guess")), "truth", "guess")
