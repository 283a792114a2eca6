"""Decompositions, repeated cross-fits and bootstraps on top of them, exact quantiles, raking and regions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ledgerloom.functions.beta import beta_binomial_ppf, beta_ppf
from ledgerloom.functions.expressions import uniform
from ledgerloom.operators import cross_fit as X, designs as D, features as T, matrices as M, regions as R, two_phase as P
from ledgerloom.operators.document_weights import document_weights
from ledgerloom.plans.frame import analysis_frame, with_frame
from ledgerloom.plans.queries_design import _SAMPLE, audited
from ledgerloom.plans.register import query
from ledgerloom.sources.scratch import written
from ledgerloom.sources.tables import table

_WORDS_SQL = "regexp_extract_all(lower(text), '[a-z]+')"
_CHARS_SQL = "SELECT doc_id, substr(w, p::INT, n::INT) AS term FROM (SELECT doc_id, w, n, unnest(range(1, length(w) - n + 2)) AS p FROM (SELECT doc_id, ' ' || unnest(w) || ' ' AS w FROM w), range(3, 6) t(n))"


def words(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)).alias("words"))


def weights_sql(terms: str) -> str:
    return f"""
WITH w AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL), t AS ({terms}),
f AS (SELECT doc_id, term, 1 + ln(count(*)) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM w),
i AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM f, n GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.6::DOUBLE * any_value(n)),
x AS (SELECT doc_id, term, tf * idf AS v FROM f JOIN i USING (term)), z AS (SELECT doc_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM x)
SELECT doc_id, count(*) AS terms, round(sum(v), 6) AS total, round(max(v), 6) AS top FROM z GROUP BY 1"""


def by_document(docs, grams):
    rows = document_weights(docs, "doc_id", "words", grams, 5, 0.6, sublinear=True, unit=True)
    return rows.select("doc_id", F.size("weights").cast("long").alias("terms"), F.round(F.aggregate("weights", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.array_max("weights"), 6).alias("top"))


@query("v10_term_weights", weights_sql("SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w"))
def v10_words(spark, d):
    """Sublinear TF-IDF of words and word pairs, rows of length 1, terms in five documents to six tenths of them."""
    return by_document(words(spark, d), "pairs")


@query("v10_char_weights", weights_sql(_CHARS_SQL))
def v10_chars(spark, d):
    """The same for runs of three to five characters inside words."""
    return by_document(words(spark, d), "chars")


@query("v10_svd")
def v10_svd(spark, d):
    """Each document's place along the eight strongest directions of its character weights, on the unit sphere."""
    weights = document_weights(words(spark, d), "doc_id", "words", "chars", 5, 0.6, counts=True)
    scores, sizes = M.packed_svd(weights, "doc_id", 8, sublinear=True, unit=True)
    length = F.sqrt(sum(F.col(c) * F.col(c) for c in M.thin(8)))
    return scores.select("doc_id", *[F.round(F.try_divide(F.col(c), length), 5).alias(f"z{i}") for i, c in enumerate(M.thin(8))], *[F.lit(round(float(s), 5)).alias(f"size{i}") for i, s in enumerate(sizes[:2])])


# Pseudo-outcomes of an audited sample.

SPLITS, FOLDS = 10, 5
_FOLD = "floor({} * 5)::INT".format("(('0x' || substr(sha256('fold|' || r || '|' || o_custkey), 1, 12))::UBIGINT / 281474976710656.0::DOUBLE)")


@query("h12_repeated_logistic")
def h12_logistic(spark, d):
    """Ten times five logistic fits on the audited orders, averaged: estimates by priority."""
    return repeated(spark, d).groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_if("drawn").alias("audited"), F.round(F.avg("m"), 6).alias("naive"), F.round(F.avg("pseudo"), 6).alias("estimate"),
        F.round(F.stddev_samp("pseudo") / F.sqrt(F.count("*")), 6).alias("se"), F.round(F.avg("m_sd"), 6).alias("prediction_sd"),
    )


def repeated(spark, d):
    df = audited(spark, d).join(table(spark, d, "orders").select("o_orderkey", F.dayofyear("o_orderdate").alias("day")), "o_orderkey")
    return X.repeated_cross_fit(df, "o_custkey", ["day"], ["o_orderstatus", "o_orderpriority"], "y", "pi", "drawn", FOLDS, SPLITS)


@query("h12_fit_diagnostics")
def h12_diagnostics(spark, d):
    out = X.cross_fit_diagnostics(repeated(spark, d), "y", "pi", "drawn")
    return out.withColumns({c: F.round(c, 6) for c in ("weighted_brier", "weighted_log_loss")})


@query("b11_two_phase", _SAMPLE.rsplit(", a AS", 1)[0].replace("o_orderkey, o_orderpriority", "o_custkey, o_orderkey, o_orderpriority", 1) + f""",
e AS (SELECT s.*, r, {_FOLD} AS fold FROM s, range(10) t(r)),
g AS (SELECT r, o_orderstatus, fold, sum(y) AS s, count(*) AS n FROM e WHERE k <= small GROUP BY ALL),
o AS (SELECT r, o_orderstatus, fold, (sum(s) OVER w - s) / (sum(n) OVER w - n) AS m FROM g WINDOW w AS (PARTITION BY r, o_orderstatus)),
q AS (SELECT e.*, m, CASE WHEN k <= small THEN m + (y - m) / (small / big) ELSE m END AS z FROM e JOIN o USING (r, o_orderstatus, fold)),
sp AS (SELECT o_orderstatus, stddev_samp(estimate) AS split_sd FROM (SELECT r, o_orderstatus, avg(z) AS estimate FROM q GROUP BY ALL) GROUP BY 1),
p AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, any_value(k <= small) AS drawn, any_value(small / big) AS f, any_value(small) AS size, any_value(y) AS y, avg(m) AS m, any_value(k) - 1 AS k FROM q GROUP BY ALL),
c AS (SELECT *, CASE WHEN drawn THEN (y - m) / f ELSE 0 END AS corr, CASE WHEN drawn THEN row_number() OVER (PARTITION BY o_orderpriority, drawn ORDER BY o_orderkey) - 1 END AS slot FROM p),
b AS (SELECT o_custkey AS cluster, o_orderstatus, sum(m + corr) AS a, sum(m + CASE WHEN drawn THEN 1 - sqrt(1 - f) ELSE 1 END * corr) AS s, count(*) AS n FROM c GROUP BY ALL),
mu AS (SELECT rep, o_orderpriority, floor((('0x' || substr(sha256('b11b|2|' || rep || '|' || o_orderpriority || '|' || slot), 1, 12))::UBIGINT / 281474976710656.0::DOUBLE) * size)::INT AS slot, count(*) AS times FROM c, range(1, 501) t(rep) WHERE drawn AND slot < size - 1 GROUP BY ALL),
x AS (SELECT rep, o_custkey AS cluster, o_orderstatus, sum(sqrt(1 - f) * size / (size - 1) * times * corr) AS e FROM mu JOIN c USING (o_orderpriority, slot) WHERE drawn GROUP BY ALL),
idx AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS slot FROM (SELECT DISTINCT cluster FROM b)),
dr AS (SELECT rep, cluster, count(*) AS mult FROM (SELECT rep, floor((('0x' || substr(sha256('b11b|1|' || rep || '|' || slot), 1, 12))::UBIGINT / 281474976710656.0::DOUBLE) * (SELECT count(*) FROM idx))::INT AS pick FROM idx, range(1, 501) t(rep)) d JOIN idx ON pick = idx.slot GROUP BY ALL),
es AS (SELECT rep, o_orderstatus, sum(mult * s) AS s, sum(mult * n) AS n FROM b JOIN dr USING (cluster) GROUP BY ALL),
ex AS (SELECT rep, o_orderstatus, sum(mult * e) AS e FROM x JOIN dr USING (rep, cluster) GROUP BY ALL),
re AS (SELECT rep, o_orderstatus, (s + coalesce(e, 0)) / n AS r FROM es LEFT JOIN ex USING (rep, o_orderstatus)),
ok AS (SELECT * FROM re WHERE rep IN (SELECT rep FROM re GROUP BY 1 HAVING count(r) = (SELECT count(DISTINCT o_orderstatus) FROM b))),
pt AS (SELECT o_orderstatus, sum(a) / sum(n) AS estimate, sum(n)::BIGINT AS n FROM b GROUP BY 1), wi AS (SELECT o_orderstatus, stddev_samp(r) AS within_se FROM ok GROUP BY 1),
fa AS (SELECT quantile_cont(z, 0.95) AS factor, 500 - count(*) AS failed FROM (SELECT rep, max(coalesce(abs(r - estimate) / within_se, 0)) AS z FROM ok JOIN pt USING (o_orderstatus) JOIN wi USING (o_orderstatus) GROUP BY 1)),
al AS (SELECT *, sqrt(within_se * within_se + 1.1::DOUBLE * split_sd * split_sd) AS se FROM pt JOIN wi USING (o_orderstatus) JOIN sp USING (o_orderstatus), fa)
SELECT o_orderstatus, n, round(estimate, 9) AS estimate, round(within_se, 9) AS within_se, round(split_sd, 9) AS split_sd, round(se, 9) AS se, round(estimate - 1.959963984540054::DOUBLE * se, 9) AS low, round(estimate + 1.959963984540054::DOUBLE * se, 9) AS high,
    round(estimate - factor * se, 9) AS simultaneous_low, round(estimate + factor * se, 9) AS simultaneous_high, round(factor, 9) AS factor, failed FROM al""")
def b11_two_phase(spark, d):
    """Means of an audited outcome by status: clusters and audited controls resampled together, 500 times, with the
    spread over ten fold assignments of cross-fitted cell means."""
    rows = written(audited(spark, d), "audited")

    def split(df):
        fold = F.floor(uniform("fold", F.col("split").cast("string"), F.col("o_custkey").cast("string")) * FOLDS).cast("int")
        return df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1)))).withColumn("fold", fold)

    cells = split(rows.filter("drawn")).groupBy("split", "o_orderstatus", "fold").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("split", "o_orderstatus")
    others = cells.select("split", "o_orderstatus", "fold", ((F.sum("s").over(w) - F.col("s")) / (F.sum("n").over(w) - F.col("n"))).alias("m"))
    # A fold is its customer's, so predictions are those of a customer and status: no order stands in ten splits.
    place = ["o_custkey", "o_orderstatus"]
    fixed = F.when(F.col("drawn"), 1 / F.col("pi")).otherwise(0.0)
    each = rows.groupBy(*place).agg(F.count("*").alias("n"), F.sum(F.col("y") * fixed).alias("f"), F.sum(fixed).alias("g"))
    each = split(each).join(F.broadcast(others), ["split", "o_orderstatus", "fold"])  # splits times folds times statuses
    z = F.col("n") * F.col("m") + F.col("f") - F.col("g") * F.col("m")
    points = each.groupBy("split", "o_orderstatus").agg((F.sum(z) / F.sum("n")).alias("estimate"))
    m = each.groupBy(*place).agg(F.avg("m").alias("m"))
    full = rows.join(m, place).withColumns({
        "correction": F.when(F.col("drawn"), (F.col("y") - F.col("m")) / F.col("pi")).otherwise(0.0), "stratum": F.when(F.col("drawn"), F.col("o_orderpriority")), "fraction": F.when(F.col("drawn"), F.col("pi")),
    })
    return P.two_phase_band(full, "o_custkey", "o_orderstatus", "o_orderkey", points, 500, "b11b")


# Posteriors, raking and regions.


@query("b14_beta_quantiles")
def b14_quantiles(spark, d):
    """Jeffreys posterior of each model's audited rate, by its effective number of rows, with its middle nine tenths."""
    return posterior(spark, d).select("model", "n", "events", *[F.round(beta_ppf(F.lit(p), "a", "b"), 9).alias(name) for name, p in (("q05", 0.05), ("median", 0.5), ("q95", 0.95))], (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))


def posterior(spark, d):
    w = 1 / (1 + F.pmod("l_partkey", F.lit(3)))
    g = analysis_frame(spark, d).filter("y0 IS NOT NULL").groupBy("model").agg(F.count("*").alias("n"), F.sum("y").alias("events"), (F.sum(w * F.col("y")) / F.sum(w)).alias("rate"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("size"))
    return g.select("model", "n", "events", (0.5 + F.col("rate") * F.col("size")).alias("a"), (0.5 + (1 - F.col("rate")) * F.col("size")).alias("b"))


@query("b14_predictive_yields", with_frame(""", p AS (SELECT model, 1.0::DOUBLE / (1 + l_partkey % 3) AS w, y FROM frame WHERE y0 IS NOT NULL),
g AS (SELECT model, sum(w * y) / sum(w) AS rate, pow(sum(w), 2) / sum(w * w) AS size FROM p GROUP BY 1), ab AS (SELECT model, 0.5 + rate * size AS a, 0.5 + (1 - rate) * size AS b FROM g),
m AS (SELECT model, k, exp(lgamma(201) - lgamma(k + 1) - lgamma(201 - k) + lgamma(k + a) + lgamma(200 - k + b) - lgamma(200 + a + b) - lgamma(a) - lgamma(b) + lgamma(a + b)) AS chance FROM ab, range(201) t(k)),
c AS (SELECT model, k, sum(chance) OVER (PARTITION BY model ORDER BY k) AS upto FROM m)
SELECT model, min(k) FILTER (upto >= 0.05)::BIGINT AS q05, min(k) FILTER (upto >= 0.5)::BIGINT AS median, min(k) FILTER (upto >= 0.95)::BIGINT AS q95 FROM c GROUP BY 1"""))
def b14_yields(spark, d):
    """Events to expect in 200 more rows of each model: beta-binomial quantiles."""
    return posterior(spark, d).select("model", *[beta_binomial_ppf(F.lit(p), F.lit(200), "a", "b").alias(name) for name, p in (("q05", 0.05), ("median", 0.5), ("q95", 0.95))])


def rake_sql(rounds: int) -> str:
    """The fit, a round after the other."""
    sql = "WITH c AS (SELECT o_orderstatus AS family, o_orderpriority AS r, c_mktsegment AS k, count(*) AS supply FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), s AS (SELECT family, sum(supply) AS total FROM c GROUP BY 1), x0 AS (SELECT *, supply::DOUBLE AS x, floor(total * 0.1) AS want, floor(total * 0.11) AS cap FROM c JOIN s USING (family))"
    for i in range(rounds):
        sql += f", y{i} AS MATERIALIZED (SELECT * REPLACE (least(x * want / sum(x) OVER (PARTITION BY family, r), supply) AS x) FROM x{i}), x{i + 1} AS MATERIALIZED (SELECT * REPLACE (x * least(1, cap / sum(x) OVER (PARTITION BY family, k)) AS x) FROM y{i})"
    return sql + f" SELECT family, r AS priority, k AS segment, round(x, 5) AS fitted FROM x{rounds}"


def raked(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cells = o.groupBy(F.col("o_orderstatus").alias("family"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("supply"))
    total = F.sum("supply").over(Window.partitionBy("family"))  # cells, not rows
    cells = cells.withColumns({"want": F.floor(total * F.lit(0.1)), "cap": F.floor(total * F.lit(0.11))})
    return D.rake(cells, "family", "priority", "segment", "supply", "want", "cap")


@query("d4_raked_cells", rake_sql(60))
def d4_cells(spark, d):
    """A tenth of the orders of each status from each priority, in proportion to supply, no segment above its cap."""
    return raked(spark, d).select("family", "priority", "segment", F.round("fitted", 5).alias("fitted"))


@query("d4_margins_met", "WITH s AS (SELECT o_orderstatus AS family, count(*) AS total FROM orders GROUP BY 1), r AS (SELECT DISTINCT o_orderstatus AS family, o_orderpriority AS priority FROM orders) SELECT family, priority, floor(total * 0.1)::BIGINT AS n, true AS caps_met FROM r JOIN s USING (family)")
def d4_margins(spark, d):
    """Whole numbers of the fit: each row's total, and whether no segment is above its cap."""
    n = written(raked(spark, d), "allocation")
    total = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("family")).agg(F.count("*").alias("total"))
    caps = n.groupBy("family", "segment").agg(F.sum("n").alias("n")).join(total, "family").groupBy("family").agg(F.every(F.col("n") <= F.floor(F.col("total") * F.lit(0.11))).alias("caps_met"))
    return n.groupBy("family", "priority").agg(F.sum("n").alias("n")).join(caps, "family")


@query("v8_separated_regions", """WITH RECURSIVE e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), g AS (SELECT floor(x / 0.1) AS i, floor(y / 0.1) AS j, count(*) AS n FROM e GROUP BY ALL),
p AS (SELECT vec_id, x, y, (SELECT sum(n) FROM g WHERE abs(i - floor(x / 0.1)) <= 1 AND abs(j - floor(y / 0.1)) <= 1)::DOUBLE AS s FROM e),
t(step, sx, sy, seed, score, px, py) AS (SELECT * FROM (SELECT 1, x, y, vec_id, s, [x], [y] FROM p ORDER BY s DESC, vec_id LIMIT 1)
    UNION ALL SELECT * FROM (SELECT step + 1, p.x, p.y, p.vec_id, p.s, list_append(px, p.x), list_append(py, p.y) FROM t, p WHERE step < 12 AND list_bool_and([pow(p.x - px[i], 2) + pow(p.y - py[i], 2) >= 0.1::DOUBLE * 0.1::DOUBLE FOR i IN range(1, len(px) + 1)]) ORDER BY p.s DESC, p.vec_id LIMIT 1)),
m AS (SELECT step, seed, score, vec_id, x, y FROM t, p WHERE pow(x - sx, 2) + pow(y - sy, 2) < 0.1::DOUBLE * 0.1::DOUBLE), c AS (SELECT step, avg(x) AS mx, avg(y) AS my FROM m GROUP BY 1)
SELECT step::INT AS region_rank, seed, round(score, 9) AS score, count(*) AS size, arg_min(vec_id, (round(pow(x - mx, 2) + pow(y - my, 2), 12), vec_id)) AS medoid FROM m JOIN c USING (step) GROUP BY ALL""")
def v8_regions(spark, d):
    """Twelve dense places of the plane, none nearer than a tenth to another, with the medoid of each."""
    points = table(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return R.regions(R.density(points, "x", "y", 0.1), "vec_id", "x", "y", "near", 0.1, 12)
