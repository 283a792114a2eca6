"""Closed-form cases and invariants of the operators."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import expressions as X, text as T
from ledgerloom.operators import agreement as M, contracts as K, contrasts as C, descriptive as D, design_estimation as H, designs, resample as B, standardize as S
from ledgerloom.sources import ledgers as L
from ledgerloom.streaming import ledger as R


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_nested_weights_by_hand(spark):
    df = spark.createDataFrame([("a", "i1"), ("a", "i1"), ("a", "i2"), ("b", "i1"), ("b", "i2")], "model string, issue string")
    w = rows(C.nested_weights(df, "model", "issue"), "model", "issue", "w")
    assert [x[2] for x in w] == pytest.approx([0.125, 0.125, 0.25, 0.25, 0.25])
    assert sum(r.w for r in C.equal_model_weights(df, "model").collect()) == pytest.approx(1, abs=1e-12)


def test_union_probability(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.25, 0.0), (0.0, 1.0)], "p double, q double")
    assert [r[0] for r in df.select(X.union_probability(F.col("p"), F.col("q"))).collect()] == pytest.approx([0.28, 0.25, 1.0])


def test_neyman_allocation():
    n = designs.neyman([10, 20, 30], [1, 9, 4], 24, 2)
    assert sum(n) == 24 and all(2 <= k <= s for k, s in zip(n, [10, 20, 30], strict=True)) and n[1] > n[0]
    with pytest.raises(ValueError):
        designs.neyman([10, 20, 30], [1, 1, 1], 5, 2)


def test_bounded_neyman_sums_to_the_budget(spark):
    s = spark.createDataFrame([(f"s{i}", 5.0, 1.0 + i) for i in range(8)], "h string, size double, sd double")
    got = designs.bounded_neyman(s, "h", "size", "sd", 20, 1).collect()
    assert sum(r.allocated for r in got) == 20 and all(1 <= r.allocated <= 5 for r in got)


def test_largest_remainders(spark):
    s = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "h string, size long")
    assert rows(designs.proportional_allocation(s, "h", "size", 4), "h", "allocated") == [("a", 2), ("b", 1), ("c", 1)]


def test_balanced_quota_and_ipf():
    picks = designs.balanced_quota({"a": {"x": 3, "y": 1}, "b": {"x": 2, "y": 0}}, {"a": 2, "b": 2}, {"x": 3, "y": 1})
    assert sum(picks.values()) == 4 and picks[("b", "x")] == 2
    table = designs.capped_ipf([[1, 1], [1, 1]], [4, 6], [5, 5], [[9, 9], [9, 9]])
    assert [sum(r) for r in table] == [4, 6]


def test_dsl_identity_and_unbiasedness(spark):
    y, pred = (0, 0, 1, 1), 0.8
    means = []
    for s in itertools.combinations(range(4), 2):
        df = spark.createDataFrame([(1, pred, float(v), 0.5, i in s) for i, v in enumerate(y)], "g int, m double, y double, pi double, drawn boolean")
        means.append(H.difference_estimator(df, ["g"], "m", "y", "pi", "drawn").first().estimate)
    assert np.mean(means) == pytest.approx(0.5)


def test_union_variance_equals_pairwise_sum(spark):
    pdf = pd.DataFrame({"u": range(8), "g": [0, 0, 0, 0, 1, 1, 1, 1], "y": [1.0, 0, 2, 1, 3, 1, 0, 2]}).assign(big0=10, small0=3, big1=5, small1=2)
    got = H.pairwise_terms(spark.createDataFrame(pdf), "u", [([], "big0", "small0"), (["g"], "big1", "small1")], "y").first()
    pi = 1 - (1 - 0.3) * (1 - 0.4)
    total = 0.0
    for a, b in itertools.product(pdf.itertuples(), repeat=2):
        if a.u == b.u:
            pij = pi
        else:
            same = (3 / 5) * (2 / 4) if a.g == b.g else (3 / 5) ** 2
            pij = pi + pi - 1 + (7 / 10) * (6 / 9) * same
        total += (pij - pi * pi) / pij * a.y * b.y / pi / pi
    assert got.total == pytest.approx(pdf.y.sum() / pi) and got.variance == pytest.approx(max(0, total))


def test_bootstrap_keeps_multiplicity(spark):
    stats = spark.createDataFrame([("m", 1, 0.0), ("m", 2, 1.0)], "model string, c int, mean double")
    drawn = spark.createDataFrame([(1, 1, 3), (1, 2, 1)], "rep int, c int, mult int")
    assert B.nested_bootstrap(stats, drawn, "c", "model").first().estimate == 0.25
    draws = B.draws(spark.range(20).withColumnRenamed("id", "c"), "c", 5, "s")
    assert {r.n for r in draws.groupBy("rep").agg(F.sum("mult").alias("n")).collect()} == {20}


def test_unreliable_intervals(spark):
    reps = spark.createDataFrame([(1, 0.1), (2, None), (3, 0.3)], "rep int, estimate double")
    kept, void = (B.percentile_interval(reps, [], 3, void_if_unreliable=v).first() for v in (False, True))
    assert kept.failed == 1 and not kept.reliable and kept.low is not None and void.low is None


def test_g_computation_levels_give_contrast(spark):
    rng = np.random.default_rng(0)
    n = 40 * 2 * 2 * 3
    pdf = pd.DataFrame({"c": np.repeat(np.arange(40), 12), "m": np.tile(np.repeat([0, 1], 6), 40).astype(str), "home": np.tile(np.repeat([0, 1], 3), 80).astype(str)})
    pdf["y"] = (rng.random(n) < 1 / (1 + np.exp(2 - 1.2 * (pdf.home == "1")))).astype(int)
    df = spark.createDataFrame(pdf).withColumn("all", F.lit("all"))
    got = S.g_computation(S.without_cluster(S.cells(df, ["all"], "home", "1", ["m"], "c", "y"), ["all"], ["m"]), ["all"], ["m"]).first()
    assert got.contrast > 0 and 0 <= got.level_off <= got.level_on <= 1 and got.level_on - got.level_off == pytest.approx(got.contrast, abs=1e-10) and not got.separated
    assert got.level_on == pytest.approx(pdf[pdf.home == "1"].y.mean(), abs=1e-6)


def test_separation_is_flagged_and_firth_is_finite():
    pdf = pd.DataFrame({"arm": [0, 1], "n": [20.0, 20.0], "events": [0.0, 20.0], "m": ["a", "a"]})
    assert S.standardized(pdf, ["m"], "n")["separated"]
    assert abs(S.standardized(pdf, ["m"], "n", firth=True)["log_odds"]) < 12


def test_home_status_never_makes_general_away(spark):
    df = spark.createDataFrame([("General", "X"), ("X", "X"), ("Y", "X"), ("Y", "none"), ("General", "none")], "f string, j string")
    assert [r[0] for r in df.select(X.home_status(F.col("f"), F.col("j"), "General", "none")).collect()] == ["general", "home", "away", "not_defined", "general"]


def test_percentile_rank_averages_ties(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], "id int, v int").withColumn("g", F.lit(1))
    assert [r[1] for r in rows(df.select("id", D.percentile_rank(["g"], F.col("v")).alias("p")), "id", "p")] == [0.375, 0.375, 0.75, 1.0]


def test_last_valid_wins(spark):
    df = spark.createDataFrame([("k", 1, "good", False), ("k", 2, None, True)], "k string, t int, text string, error boolean")
    assert D.last_per_key(df, ["k"], [F.desc("t")], ~F.col("error")).first().text == "good"
    assert D.last_per_key(df, ["k"], [F.desc("t")]).first().error


def test_kappa_conventions(spark):
    cells = spark.createDataFrame([(4.0, 0.0, 0.0, 0.0)], "tp double, fp double, fn double, tn double")
    assert M.binary_metrics(cells, 1.0).first().kappa == 1.0 and M.binary_metrics(cells).first().kappa is None


def test_perfect_multiclass(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("b", "b")], "t string, g string")
    assert {r.f1 for r in M.multiclass(df, "t", "g").collect()} == {1.0}


def test_krippendorff_known_value(spark):
    units = [(1, 1, 1), (2, 2, 2), (3, 3, 3), (3, 3, 3), (2, 2, 2), (1, 2, 3), (4, 4, 4), (1, 1, 2), (2, 2, 2), (None, 5, 5), (None, None, 1)]
    long = [(u, v) for u, vs in enumerate(units) for v in vs if v is not None]
    df = spark.createDataFrame(long, "u int, v int")
    o = pd.DataFrame(0.0, index=range(1, 6), columns=range(1, 6))
    for vs in units:
        vs = [v for v in vs if v is not None]
        for i, j in itertools.permutations(range(len(vs)), 2):
            o.loc[vs[i], vs[j]] += 1 / (len(vs) - 1)
    n = o.sum(axis=1)
    want = 1 - (o.values.sum() - np.trace(o.values)) / ((n.sum() ** 2 - (n**2).sum()) / (n.sum() - 1))
    assert M.krippendorff(df, ["u"], "v").first().alpha == pytest.approx(want)


def test_contracts_and_joins(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "zz")], "k int, v string")
    found = {(r.check, r.n) for r in K.Contract(key=["k"], enums={"v": ["a", "b"]}, rows=5).violations(df).collect()}
    assert found == {("key", 1), ("enum:v", 1), ("rows", 2)}
    assert K.Contract(columns=["absent"]).violations(df).first().detail == "absent"
    with pytest.raises(K.ContractError):
        K.checked_join(df, df, ["k"])
    with pytest.raises(K.ContractError):
        K.exact_key_join(df.limit(1), df, ["k"])
    with pytest.raises(K.ContractError):
        K.forbid_columns(df.withColumn("api_key", F.lit(1)), {"api_key"})


def test_chunks_are_lossless(spark):
    text = "alpha beta\n" * 800 + "tail"
    got = T.chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "text", 3000).orderBy("chunk_no").collect()
    assert "".join(r.chunk for r in got) == text and 1 < len(got) and max(len(r.chunk) for r in got) <= 3000


def test_scripts(spark):
    cases = [("日本語のテキスト", "ja"), ("中文文本", "zh"), ("نص عربي", "ar"), ("Русский", "ru"), ("हिन्दी", "hi"), ("plain", "en")]
    df = spark.createDataFrame(cases, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", T.script_language(F.col("t")).alias("got")).collect())


def test_repetition_loop(spark):
    df = spark.createDataFrame([("a b c d " * 4,), ("a b c d " * 3,), (None,)], "t string")
    assert [r[0] for r in df.select(T.repetition_loop("t")).collect()] == [True, False, False]


def test_retry_policy():
    assert R.retry_delay(2, 429) == 4 and R.retry_delay(0, 400) is None and R.retry_delay(9, 503) == 60 and R.retry_delay(1, 500, 7.5) == 7.5


def test_ledger_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "t": "x"}\nnot json\n{"k": 2, "error": "e"}\n')
    path = str(tmp_path / "a.jsonl")
    assert L.read_ledger(spark, path, "k int, t string").count() == 2
    assert [r.k for r in L.read_ledger_without(spark, path, "k int, t string").collect() if r.k] == [1]
    assert L.read_present(spark, [path, str(tmp_path / "none")], "k int").count() == 3
    with pytest.raises(Exception):
        L.read_ledger(spark, path, "k int, t string", strict=True).collect()


def test_freeze_once(spark, tmp_path):
    path = str(tmp_path / "frozen")
    L.freeze(spark.range(3), path, "abc")
    L.freeze(spark.range(9), path, "abc")
    assert spark.read.parquet(f"{path}/data").count() == 3
    with pytest.raises(K.ContractError):
        L.freeze(spark.range(3), path, "other")


def test_stream_appends_once(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, 5.0), (1, 6.0), (2, 0.0), (3, 2.0)], "k int, value double")
    df.write.parquet(src)
    for n in range(2):
        stream = R.ledger_stream(spark, src, "k int, value double")
        q = R.append_new(stream, dst, ["k"], str(tmp_path / f"cp{n}"), F.col("value") >= 1)
        q.awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(dst).collect()) == [1, 3]


def test_event_windows_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("select timestamp_ntz'2024-01-01 00:10:00' ts, 'a' kind, 1.0D value union all select timestamp_ntz'2024-01-01 07:00:00', 'a', 2.0D").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp_ntz, kind string, value double").parquet(src)
    q = R.windows(stream, "ts", "6 hours", "1 hour", ["kind"]).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.total) for r in spark.sql("select * from w").collect()) == [(1, 1.0), (1, 2.0)]


def test_near_links_has_no_rank_limit(spark):
    from ledgerloom.operators import vectors as V

    rng = np.random.default_rng(7)
    m = np.concatenate([np.tile(rng.standard_normal(8), (120, 1)) + 1e-3 * rng.standard_normal((120, 8)), np.tile([[0.0] * 7 + [1.0]], (3, 1)), rng.standard_normal((40, 8))])
    rows = [(i + 1, x.tolist()) for i, x in enumerate(m)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [0.0] * 8)]
    got = {r.vec_id: r.links for r in V.near_links(spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3), 0.995, rows=32).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {i + 1: int(n) - 1 for i, n in enumerate((u @ u.T >= 0.995).sum(axis=1))} | {900: 0, 901: 0, 902: 0, 903: 0}
    assert got == want and got[1] >= 119 and got[121] >= 2


def test_greedy_diverse_is_the_plain_greedy_choice(spark):
    from ledgerloom.operators.designs import greedy_diverse
    from ledgerloom.plans.registry import QUERIES

    assert greedy_diverse([("a", 1, 10), ("a", 2, 9), ("b", 1, 8), ("b", 3, 7), ("c", 1, 6)], 3) == [("a", 1, 10), ("b", 3, 7)]
    d = "/root/testdata/sf0.001"
    orders = sorted((f"{r.o_orderpriority}/{r.o_orderstatus}", -r.o_totalprice, r.o_orderkey, r.o_custkey) for r in spark.read.parquet(f"{d}/orders.parquet").collect())
    used, want = set(), set()
    for cell in sorted({r[0] for r in orders}):
        for _, _, key, customer in (r for r in orders if r[0] == cell):
            if customer not in used:
                used.add(customer)
                want.add((cell, customer, key))
                break
    assert {(r.cell, r.o_custkey, r.o_orderkey) for r in QUERIES["d19_greedy_diverse"](spark, d).collect()} == want


def test_latent_labels_stay_disabled():
    from ledgerloom.functions.expressions import latent_label_draw

    with pytest.raises(NotImplementedError):
        latent_label_draw()


def test_logistic_coefficients_are_a_stationary_point(spark):
    """Against Newton's method in numpy on the same scaled and one-hot features."""
    import numpy as np

    from ledgerloom.operators.features import cross_fitted, logistic_coefficients

    rng = np.random.default_rng(1)
    rows = [(float(rng.integers(0, 2)), float(rng.normal()) if rng.random() > 0.1 else None, "ab"[int(rng.integers(0, 2))], float(rng.random() + 0.5), int(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "y double, x double, g string, w double, fold int")
    got = {r.feature: r.coefficient for r in logistic_coefficients(df, ["x"], ["g"], "y", "w", 0.01).collect()}
    y, w = (np.array([r[i] for r in rows]) for i in (0, 3))
    x = np.array([np.nan if r[1] is None else r[1] for r in rows])
    x = np.where(np.isnan(x), np.nanmean(x), x)
    x = (x - x.mean()) / x.std(ddof=1)
    a = np.stack([x, [r[2] == "a" for r in rows], [r[2] == "b" for r in rows], np.ones(300)], axis=1).astype(float)
    b, ridge = np.zeros(4), np.diag([0.01, 0.01, 0.01, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        g = a.T @ (w * (y - p)) / w.sum() - ridge @ b
        h = (a * (w * p * (1 - p))[:, None]).T @ a / w.sum() + ridge
        b += np.linalg.solve(h, g)
    assert np.allclose([got["x"], got["g=a"], got["g=b"], got["intercept"]], b, atol=2e-3)
    out = cross_fitted(df, ["x"], ["g"], "y", "w", "fold", 3, 0.01)
    assert out.count() == 300 and out.filter("p <= 0 or p >= 1").isEmpty()


def test_draw_of_a_stratum_whose_hashes_are_large(spark):
    """Few units: all are near enough to be ranked; sizes above the stratum take all of it."""
    from ledgerloom.operators.designs import srswor

    df = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(400)], "id long, s string")
    got = srswor(df, ["s"], "id", F.lit(10), "seed").groupBy("s").agg(F.count("*").alias("n"), F.count_if("drawn").alias("k"), F.min("pi").alias("pi")).collect()
    assert sorted((r.s, r.n, r.k, round(r.pi, 6)) for r in got) == [("a", 5, 5, 1.0), ("b", 395, 10, round(10 / 395, 6))]


def test_replicate_sums_equal_the_join(spark):
    """Block by block and draw by draw give the same sums, also with null groups and measures and many groups."""
    clusters = spark.range(23).withColumnRenamed("id", "c")
    stats = clusters.filter("c < 20").selectExpr("c", "if(c % 4 = 0, null, concat('g', c % 3)) as g", "if(c % 5 = 0, null, c * 0.25D) as s", "c as n")
    want = B.drawn_sums(stats, B.draws(clusters, "c", 9, "s"), "c", ["g"], ["s", "n"])
    plain = lambda df: sorted((r.rep, r.g or "", r["mult"], round(r.s or 0, 9), r.n) for r in df.collect())
    for held in (1 << 20, 9):
        assert plain(B.replicate_sums(stats, clusters, "c", ["g"], ["s", "n"], 9, "s", width=4, held=held)) == plain(want)
    whole = B.replicate_sums(stats.filter("s is not null"), clusters, "c", [], ["s"], 9, "s", width=4)
    assert sorted(r.rep for r in whole.collect()) == list(range(1, 10))
    assert B.replicate_sums(stats.limit(0), clusters, "c", ["g"], ["s"], 9, "s").count() == 0
    assert B.replicate_sums(stats, clusters.limit(0), "c", ["g"], ["s"], 9, "s").count() == 0


def test_subsamples_equal_the_sorted_permutation(spark):
    """Ranking only near the cuts gives what ranking every cluster does; smaller fractions nest in larger."""
    clusters = spark.range(3000).withColumnRenamed("id", "c")
    got = B.subsamples(clusters, "c", [0.01, 0.5, 1.0], 3, "q").toPandas()
    every = clusters.withColumn("rep", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("u", X.uniform("q", F.col("rep").cast("string"), F.col("c").cast("string"))).toPandas().sort_values(["u", "c"])
    for (f, rep), own in got.groupby(["fraction", "rep"]):
        assert set(own["c"]) == set(every[every["rep"] == rep]["c"].head(round(f * 3000)))
    assert B.subsamples(clusters.limit(0), "c", [0.5], 3, "q").count() == 0


@pytest.mark.parametrize("total", [3, 20, 47, 90, 200, 231])
def test_water_level_against_halving(spark, total):
    """The level found from sorted turns is the one that halving finds, at every total."""
    rng = np.random.default_rng(3)
    high = rng.integers(1, 30, 17).astype(float)
    rate, low = high * rng.integers(0, 6, 17), np.minimum(2.0, high)
    level = designs.water_level(spark.createDataFrame(list(zip(rate.tolist(), low.tolist(), high.tolist(), strict=True)), "rate double, low double, high double"), total)
    held = lambda k: np.clip(k * rate, low, high).sum()
    if total > np.where(rate > 0, high, low).sum():
        assert level is None
    elif total <= low.sum():
        assert level == 0
    else:
        assert held(level) == pytest.approx(total)


def test_srswor_equals_a_full_ranking(spark):
    """Large strata, census strata, tiny strata and draws of none: the smallest hashes, as many as asked."""
    units = spark.range(5000).selectExpr("id as u", "case when id % 10 < 7 then 'a' when id % 10 < 9 then 'b' else concat('t', id % 700) end as g")
    size = F.when(F.col("g") == "a", 900).when(F.col("g") == "b", 2**40).otherwise(F.floor(F.col("stratum_n") / 2))
    got = designs.srswor(units, ["g"], "u", size, "z").toPandas()
    ranked = units.withColumn("k", designs.seeded_rank("z", "u", ["g"])).toPandas().merge(got, on=["u", "g"])
    assert len(got) == 5000 and (ranked.drawn == (ranked.k <= ranked.draw_n)).all() and (got[got.g == "b"].pi == 1).all()
    assert designs.srswor(units.limit(0), ["g"], "u", size, "z").count() == 0


def test_symptoms_of_separation(spark):
    """A nuisance cell without events degenerates its own weight only; an undefined fit blocks."""
    rows = [("a", 1, "x", 50.0, 20.0), ("a", 0, "x", 50.0, 10.0), ("a", 1, "z", 30.0, 0.0), ("a", 0, "z", 20.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, arm int, m string, n double, events double")
    r = S.fit_diagnosis(df, ["g"], ["m"]).first()
    assert r.separated and not r.blocking and "fitted_at_edge" in r.symptoms and r.observed_extreme == pytest.approx(50 / 150) == r.extreme_weight
    fine = S.fit_diagnosis(df.filter("m = 'x'"), ["g"], ["m"]).first()
    assert not fine.separated and fine.symptoms == "" and fine.extreme_weight == 0
    assert fine.se == pytest.approx(np.sqrt(1 / 20 + 1 / 30 + 1 / 10 + 1 / 40), rel=1e-6)
    # One arm has no events: that arm's rows are extreme as observed, but every row has an extreme counterfactual.
    arm = S.fit_diagnosis(spark.createDataFrame([("b", 1, 20.0, 0.0), ("b", 0, 60.0, 30.0)], "g string, arm int, n double, events double"), ["g"], []).first()
    assert arm.observed_extreme == 0.25 and arm.extreme_weight == 1 and not arm.blocking
    # Arms far apart: the steps don't overshoot.
    far = S.fit_logistic(np.array([[1.0, 1.0], [1.0, 0.0]]), np.array([10.0, 400.0]), np.array([9.0, 4.0]))
    assert far["converged"] and not far["separated"] and far["beta"][1] == pytest.approx(np.log(9) - np.log(4 / 396), abs=1e-6)
    bad = np.array([1.0, np.nan])
    assert set(S.symptoms(bad, bad, np.array([0.5]), False)) == {"not_finite", "not_converged"} and set(S.BLOCKING) == {"not_finite", "not_converged"}


def test_model_terms(spark):
    df = spark.createDataFrame([("p", "m1", "a", None), ("p", "m2", "a", "x"), ("q", "m1", "a", "x"), ("q", "m1", "b", "y")], "g string, model string, tier string, route string")
    got = {r.g: (r.formula, r.dropped) for r in S.model_terms(df, ["g"], ["tier", "route"], model="model").collect()}
    assert got == {"p": ("y ~ home * model", "tier,route"), "q": ("y ~ home + tier + route", "")}


def test_a_label_is_recorded_once_a_run(spark, tmp_path):
    reps = spark.createDataFrame([("a", 1, 0.5), ("a", 2, None), ("b", 1, 0.1), ("b", 2, 0.2)], "g string, rep int, estimate double")
    path = str(tmp_path / "diagnostics")
    one = B.record(B.diagnostics([("home", reps)], "r1", ["g"], 2), path)
    assert {(r.label, r.ok, r.failed, r.reliable) for r in one.collect()} == {("home/a", 1, 1, False), ("home/b", 2, 0, True)}
    with pytest.raises(K.ContractError, match="run_id r1, label home/a"):
        B.record(B.diagnostics([("home", reps)], "r1", ["g"], 2), path)
    with pytest.raises(K.ContractError, match="away/a"):
        B.record(B.diagnostics([("away", reps), ("away", reps)], "r1", ["g"], 2), path)
    assert B.record(B.diagnostics([("home", reps)], "r2", ["g"], 2), path).count() == 4


def test_numbers_of_many_messages_equal_the_column(spark):
    """Hashes made inside tasks are those of ``uniform``, for texts of any length."""
    from ledgerloom.functions.digests import uniforms
    from ledgerloom.functions.expressions import uniform

    texts = [str(x) for x in (0, 7, 10, 99, 100, 123456)] + ["", "é" * 40]
    got = {rep: uniforms(f"s|{rep}|", [t.encode() for t in texts]) for rep in range(1, 12)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").crossJoin(spark.range(1, 12).withColumnRenamed("id", "rep"))
    for r in df.select("i", "rep", uniform("s", F.col("rep").cast("string"), "t").alias("u")).collect():
        assert got[r.rep][r.i] == r.u


def test_draws_of_a_block_travel_together(spark):
    """Four bytes a draw, and a row for each block that some slots drew from: rows don't grow with the replicates."""
    rows = B.block_draws(spark, 40, 25, "s", width=16, made=10).collect()
    assert len(rows) == 4 * 3 and sum(len(r.draws) for r in rows) == 4 * 25 * 40


def test_signed_sums_move_no_signs(spark):
    """Sums by replicate are those of a join with signs, and no join or shuffle has a row for each cluster and replicate."""
    rows = spark.range(60).selectExpr("id % 20 as c", "concat('g', id % 3) as g", "id * 0.5 - 7 as r")
    sums = lambda held: B.signed_sums(rows, "c", "g", "r", 40, "s", held=held)
    plain = lambda df: sorted((r.rep, r.g, round(r.v, 9)) for r in df.collect())
    assert plain(sums(1 << 20)) == plain(sums(9)) and sums(1 << 20).count() == 120
    band = B.multiplier_band(rows.selectExpr("c", "g", "r as s", "1.0D as n", "0.0D as w"), "c", "g", 40, "s")
    assert "explode" not in band._jdf.queryExecution().optimizedPlan().toString()


def test_union_variance_of_a_large_population(spark):
    """Sizes may come as integers whose product is none."""
    from ledgerloom.operators.design_estimation import pairwise_terms

    df = spark.createDataFrame([(i, 1.0, 150_000, 2) for i in range(2)], "id int, y double, big int, small int")
    got = pairwise_terms(df, "id", [([], "big", "small")], "y").first()
    n, k = 150_000, 2
    both = k * (k - 1) / (n * (n - 1))
    want = 2 * (1 - (k / n) ** 2 / both) * (n / k) ** 2 + 2 * (n / k) ** 2 * (1 - k / n)
    assert got.total == pytest.approx(n) and got.variance == pytest.approx(max(0.0, want), rel=1e-3, abs=1.0)


def test_exact_sum_has_no_order(spark):
    """Sums at a threshold don't depend on the order of rows, as sums of doubles do; what is no decimal stays."""
    from functools import reduce
    from operator import add

    from ledgerloom.functions.expressions import exact_sum

    taxes = [0.01, 0.08, 0.08, 0.05, 0.04, 0.04]
    rows = [("a", x) for x in taxes] + [("b", x) for x in sorted(taxes)] + [("c", None), ("d", float("nan")), ("d", 1.0), ("e", 1e30), ("e", 1.0)]
    got = {r.g: r.s for r in spark.createDataFrame(rows, "g string, x double").groupBy("g").agg(exact_sum(F.col("x")).alias("s")).collect()}
    assert reduce(add, taxes) < 0.3 == got["a"] == got["b"] and got["c"] is None and got["d"] != got["d"] and got["e"] == 1e30


def test_arms_fitted_together_equal_single_fits():
    """One call for many groups gives each group's own fit and diagnosis, also separated ones and groups of one arm."""
    from ledgerloom.operators.standardize import fit_arms, standardized

    groups = [(n0, e0, n1, e1) for n0 in (1, 2, 9, 400) for e0 in sorted({0, 1, n0 // 2, n0}) for n1 in (1, 3, 50) for e1 in sorted({0, 1, n1})] + [(6, 2, 0, 0), (0, 0, 5, 5)]
    a = np.array(groups, float)
    got = fit_arms(a[:, [0, 2]], a[:, [1, 3]])
    for i, (n0, e0, n1, e1) in enumerate(groups):
        pdf = pd.DataFrame([(0, n0, e0), (1, n1, e1)], columns=["arm", "n", "events"])
        want = standardized(pdf[pdf["n"] > 0].reset_index(drop=True), [], "n")
        for name in ("separated", "converged", "blocking", "symptoms", "extreme_weight", "observed_extreme", "level_on", "level_off", "contrast"):
            assert got[name][i] == (pytest.approx(want[name], abs=1e-9) if isinstance(want[name], float) else want[name]), (groups[i], name)
        if not want["separated"]:
            assert got["log_odds"][i] == pytest.approx(want["log_odds"], abs=1e-7) and got["se"][i] == pytest.approx(want["se"], rel=1e-6)


def test_few_strata_leave_no_task_with_all_rows(spark, monkeypatch):
    """Rows aren't dealt by stratum; with many strata they are, and the draw is the same."""
    from ledgerloom.operators import designs

    df = spark.range(3000).selectExpr("id", "id % 2 as s")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = designs.srswor(df, ["s"], "id", F.lit(40), "x")
        assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
        want = sorted(few.filter("drawn").select("id").collect())
        monkeypatch.setattr(designs, "FEW", 1)
        assert sorted(designs.srswor(df, ["s"], "id", F.lit(40), "x").filter("drawn").select("id").collect()) == want and len(want) == 80
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
