"""Decompositions, cross-fits, bootstraps, quantiles, raking and regions against dense or plain versions."""

import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import batched_fits as G, cross_fit as X, features as T, matrices as M, standardize as S, two_phase as P
from ledgerloom.operators.contracts import ContractError
from ledgerloom.operators.document_weights import document_weights
from ledgerloom.sources import scratch


@pytest.mark.parametrize("kind", ["decaying", "low rank"])
def test_truncated_svd_against_a_dense_solve(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 40)) * (rng.random((60, 40)) < 0.3)
    if kind == "low rank":
        x = rng.standard_normal((60, 3)) @ rng.standard_normal((3, 40))
    else:
        u, s, vt = np.linalg.svd(x, full_matrices=False)
        x = (u * s * 0.7 ** np.arange(40)) @ vt
    rows = [(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    scores, sizes = M.truncated_svd(spark.createDataFrame(rows, "r long, c string, weight double").repartition(3), "r", "c", 5, more=6, rounds=8)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(sizes, s[:5], atol=1e-6)
    got = np.zeros((60, 5))
    for r in scores.collect():
        got[r.r] = [r[f"c{i}"] for i in range(5)]
    for i in range(3):
        assert min(np.abs(got[:, i] - u[:, i] * s[i]).max(), np.abs(got[:, i] + u[:, i] * s[i]).max()) < 1e-5
        assert got[np.abs(got[:, i]).argmax(), i] > 0


def test_svd_moves_neither_rows_nor_entries_in_its_rounds(spark, monkeypatch):
    """A round writes a row for each batch of rows and bucket of columns, not for each row or column. Many buckets
    give the same as a dense solve; names in several batches are one column."""
    rng = np.random.default_rng(6)
    u, s, vt = np.linalg.svd(rng.standard_normal((300, 40)), full_matrices=False)
    x = (u * s * 0.7 ** np.arange(40)) @ vt
    rows = [(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    df, made, write = spark.createDataFrame(rows, "r long, c string, weight double").repartition(3), [], M.written
    monkeypatch.setattr(M, "written", lambda df, tag, **how: (out := write(df, tag, **how), made.append(out.count()) if tag == "range" else 0)[0])
    _, sizes = M.truncated_svd(df, "r", "c", 4, more=6, rounds=6)
    assert np.allclose(sizes, (s * 0.7 ** np.arange(40))[:4], atol=1e-6) and max(made) <= 8
    monkeypatch.setattr(M, "BUCKET_COLUMNS", 16)
    scores, again = M.truncated_svd(df, "r", "c", 4, more=6, rounds=6)
    assert np.allclose(sizes, again) and scores.count() == 300


def test_svd_of_nothing(spark):
    scores, sizes = M.truncated_svd(spark.createDataFrame([], "r long, c string, weight double"), "r", "c", 2)
    assert scores.collect() == [] and sizes.tolist() == [0, 0]


def test_packed_weights_are_the_listed_ones(spark):
    df = spark.createDataFrame([(k, [f"w{(k * j) % 7}" for j in range(k % 9)]) for k in range(1, 40)], "k long, w array<string>").repartition(3)
    docs = lambda **how: document_weights(df, "k", "w", "chars", 2, 0.9, True, True, **how)
    want = {(r.k, t): v for r in docs(terms=True).collect() for t, v in zip(r.terms, r.weights)}
    got = {}
    for r in docs(packed=True).collect():
        names, at = iter(r.data.decode()), 0
        names = ["".join(next(names) for _ in range(n)) for n in np.frombuffer(r.lens, np.int32)]
        for k, n in zip(r["keys"], np.frombuffer(r.size, np.int32)):
            for t, v in zip(np.frombuffer(r.term, np.int32)[at : at + n], np.frombuffer(r.v)[at : at + n]):
                got[k, names[t]] = v
            at += n
    assert got == want and got


def test_svd_of_counted_documents_leaves_no_ranges(spark, monkeypatch):
    """Counts and idf decompose like the listed weights; a range's table is gone when it has served, and at no time
    there are more than two."""
    paths, most, where = [], [], scratch.scratch_path
    monkeypatch.setattr(scratch, "scratch_path", lambda s, tag: (paths.append(where(s, tag).removeprefix("file://")), most.append(len(left())))[0] or "file://" + paths[-1])
    left = lambda: [p for p in paths if "/range-" in p and os.path.exists(p)]
    df = spark.createDataFrame([(k, [f"w{(k * j) % 13}" for j in range(3 + k % 9)]) for k in range(1, 400)], "k long, w array<string>").repartition(3)
    listed = document_weights(df, "k", "w", "chars", 2, 0.9, True, True, terms=True)
    entries = listed.select("k", F.explode(F.arrays_zip("terms", "weights")).alias("e")).select("k", F.col("e.terms").alias("t"), F.col("e.weights").alias("weight"))
    want, sizes = M.truncated_svd(entries, "k", "t", 2)
    got, again = M.packed_svd(document_weights(df, "k", "w", "chars", 2, 0.9, counts=True), "k", 2, sublinear=True, unit=True)
    a, b = ({r.k: (r.c0, r.c1) for r in x.collect()} for x in (want, got))
    assert np.allclose(sizes, again) and a.keys() == b.keys() and len(a) > 300 and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)
    assert not left() and max(most) <= 2


def test_triangles_are_combined_in_steps(spark, monkeypatch):
    monkeypatch.setattr(M, "FACTORS", 2)
    a = np.random.default_rng(1).standard_normal((200, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "k long, c0 double, c1 double, c2 double, c3 double").repartition(12)
    r = M.triangle(df, 4)
    assert np.allclose(r.T @ r, a.T @ a)
    q = np.array([x[1:] for x in M.orthonormal(df, "k", 4).collect()])
    assert np.allclose(q.T @ q, np.eye(4))


def test_char_grams_and_weights(spark):
    df = spark.createDataFrame([(1, ["a", "bcd"]), (2, ["bcd"]), (3, []), (4, ["漢字"])], "k long, w array<string>")
    got = {r.k: sorted(r.g) for r in df.select("k", T.char_grams(F.col("w")).alias("g")).collect()}
    assert got == {1: sorted([" a ", " bc", "bcd", "cd ", " bcd", "bcd ", " bcd "]), 2: sorted([" bc", "bcd", "cd ", " bcd", "bcd ", " bcd "]), 3: [], 4: sorted([" 漢字", "漢字 ", " 漢字 "])}
    w = T.term_weights(df.withColumn("t", T.word_grams(F.col("w"))), "k", "t", min_df=1, max_df=1.0).collect()
    idf = {"bcd": math.log(5 / 3) + 1, "a": math.log(5 / 2) + 1, "a bcd": math.log(5 / 2) + 1}
    norm = math.sqrt(sum(v * v for v in idf.values()))
    assert {(r.k, r.term): round(r.weight, 9) for r in w} == {**{(1, t): round(v / norm, 9) for t, v in idf.items()}, (2, "bcd"): 1.0, (4, "漢字"): 1.0}


def plain_logistic(x, y, w, penalty):
    beta, ridge = np.zeros(x.shape[1]), penalty * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
    return beta


def test_repeated_cross_fit_against_single_fits(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i // 3, float(rng.normal()) if i % 11 else None, "abc"[rng.integers(3)] if i % 13 else None, bool(rng.random() < 0.5), 0.5 if i % 2 else 0.25) for i in range(240)]
    rows = [(*r, int(rng.random() < 1 / (1 + math.exp(-(r[2] or 0))))) for r in rows]
    df = spark.createDataFrame(rows, "id long, issue long, v double, k string, drawn boolean, pi double, y int").repartition(5)
    got = {r.id: r for r in X.repeated_cross_fit(df, "issue", ["v"], ["k"], "y", "pi", "drawn", folds=4, repeats=3, penalty=0.7).collect()}
    v = np.array([np.nan if r[2] is None else r[2] for r in rows])
    mean, sd = np.nanmean(v), np.nanstd(v)
    x = np.stack([np.ones(240), (np.where(np.isnan(v), mean, v) - mean) / sd, *[np.array([r[3] == c for r in rows], float) for c in "bc"]], 1)
    drawn, pi, y = np.array([r[4] for r in rows]), np.array([r[5] for r in rows]), np.array([r[6] for r in rows], float)
    for s in range(3):
        fold = np.array([got[i].fold_by_split[s] for i in range(240)])
        assert all(len(set(fold[3 * i : 3 * i + 3])) == 1 for i in range(80)) and set(fold) == {0, 1, 2, 3}
        for k in range(4):
            use = drawn & (fold != k)
            beta = plain_logistic(x[use], y[use], 1 / pi[use], 0.7)
            want = 1 / (1 + np.exp(-x[fold == k] @ beta))
            assert np.allclose([got[i].m_by_split[s] for i in np.nonzero(fold == k)[0]], want, atol=1e-7)
    for i in range(240):
        m = np.mean(got[i].m_by_split)
        assert got[i].m == pytest.approx(m) and got[i].m_sd == pytest.approx(np.std(got[i].m_by_split, ddof=1))
        assert got[i].pseudo == pytest.approx(m + (y[i] - m) / pi[i] * drawn[i])
        assert got[i].pseudo_by_split[1] == pytest.approx(got[i].m_by_split[1] + (y[i] - got[i].m_by_split[1]) / pi[i] * drawn[i])
    each = X.cross_fit_diagnostics(spark.createDataFrame([r.asDict() for r in got.values()], "id long, y int, pi double, drawn boolean, fold_by_split array<int>, m_by_split array<double>"), "y", "pi", "drawn").collect()
    assert sum(r.n_population for r in each) == 720 and sum(r.n_reference for r in each) == 3 * drawn.sum() and all(0 < r.weighted_brier < 1 for r in each)
    with pytest.raises(ContractError, match="one class"):
        X.repeated_cross_fit(df.withColumn("y", F.lit(1)), "issue", ["v"], ["k"], "y", "pi", "drawn", repeats=1)


def test_pseudo_outcomes_are_unbiased():
    from itertools import combinations

    y, m = np.array([0, 0, 1, 1.0]), 0.8
    means = [np.mean([m + (y[i] - m) / 0.5 * (i in s) for i in range(4)]) for s in combinations(range(4), 2)]
    assert np.mean(means) == pytest.approx(y.mean())


def test_two_phase_band_in_closed_form(spark):
    # One cluster for each group and equal controls: whatever is drawn, a stratum's multipliers add up to its size.
    rows = [(c, "ab"[c % 2], 10 * c + i, 0.5, 0.3 if i < 4 else 0.0, f"s{c}" if i < 4 else None, 0.25 if i < 4 else None) for c in range(2) for i in range(6)]
    df = spark.createDataFrame(rows, "cluster long, by string, unit long, m double, correction double, stratum string, fraction double")
    splits = spark.createDataFrame([(s, g, 0.1 * s) for s in range(3) for g in "ab"], "split int, by string, estimate double")
    got = {r.by: r for r in P.two_phase_band(df, "cluster", "by", "unit", splits, 40, "t").collect()}
    for r in got.values():
        assert r.estimate == pytest.approx((6 * 0.5 + 4 * 0.3) / 6) and r.within_se == pytest.approx(0, abs=1e-12) and r.split_sd == pytest.approx(0.1)
        assert r.se == pytest.approx(math.sqrt(1.1) * 0.1) and r.high - r.low == pytest.approx(2 * 1.959963984540054 * r.se) and r.n == 6
        assert 0 < r.failed < 40  # both clusters must be drawn
    with pytest.raises(ContractError, match="s9"):
        P.two_phase_band(df.withColumn("stratum", F.when(F.col("unit") == 0, "s9")), "cluster", "by", "unit", splits, 4, "t")


def test_numbers_within_groups_and_multipliers(spark):
    df = spark.createDataFrame([(f"g{i % 3}", i) for i in range(50)], "g string, u long").repartition(6)
    got = P.numbered_within(df, "g", "u")
    assert sorted((r.g, r.u, r.slot, r.group_size) for r in got.collect()) == sorted((f"g{i % 3}", i, i // 3, len(range(i % 3, 50, 3))) for i in range(50))
    times = P.control_multipliers(got.drop("u"), "g", 7, "s").groupBy("rep", "g").agg(F.sum("times").alias("n")).collect()
    assert len(times) == 21 and {(r.g, r.n) for r in times} == {("g0", 16), ("g1", 16), ("g2", 15)}


def test_draws_down_the_tree():
    size, reps = 3 * G.BLOCK + 17, 400
    drawn = np.concatenate([G.block_draws(b, size, reps, 5) for b in range(4)], 1)
    assert drawn.shape == (reps, size) and (drawn.sum(1) == size).all()
    assert abs(drawn.mean() - 1) < 1e-12 and abs(drawn.var() - (1 - 1 / size)) < 0.02 and np.abs(drawn.mean(0) - 1).max() < 0.3
    assert (G.block_draws(0, 5, 30, 5).sum(1) == 5).all() and (G.block_draws(2, size, reps, 5) == drawn[:, 2 * G.BLOCK : 3 * G.BLOCK]).all()


def test_stacked_fits_equal_single_ones(spark):
    rng = np.random.default_rng(2)
    rows = [("xy"[c % 2], a, t, c, float(n := rng.integers(1, 9)), float(rng.integers(0, n + 1))) for c in range(30) for a in (0, 1) for t in ("p", "q", "r") if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "g string, arm int, tier string, cluster long, n double, events double").repartition(4)
    got = {(r.g, r.rep): r.estimate for r in G.bootstrap_contrasts(df, "g", ["tier"], "cluster", 20, 9, width=8, together=7).collect()}
    drawn = np.concatenate([G.block_draws(b, 30, 20, 9, 8) for b in range(4)], 1)
    assert len(got) == 40
    import pandas as pd

    full = pd.DataFrame(rows, columns=["g", "arm", "tier", "cluster", "n", "events"])
    for (g, rep), estimate in got.items():
        pdf = full[full.g == g].copy()
        w = drawn[rep - 1][pdf.cluster]
        pdf["n"], pdf["events"] = pdf.n * w, pdf.events * w
        pdf = pdf[pdf.n > 0].groupby(["arm", "tier"], as_index=False)[["n", "events"]].sum()
        assert estimate == pytest.approx(S.standardized(pdf, ["tier"], "n")["contrast"], abs=1e-7)


def test_beta_quantiles():
    from ledgerloom.functions import beta as Q

    p = np.array([0.001, 0.05, 0.3, 0.5, 0.9, 0.999])
    assert np.allclose(Q.beta_quantile(p, 1, 1), p, atol=1e-12)
    for k in (0.2, 3.0, 40.0):
        assert np.allclose(Q.beta_quantile(p, k, 1), p ** (1 / k), atol=1e-10) and np.allclose(Q.beta_quantile(p, 1, k), 1 - (1 - p) ** (1 / k), atol=1e-10)
    assert np.allclose(Q.beta_quantile(p, 0.5, 0.5), np.sin(np.pi * p / 2) ** 2, atol=1e-10)
    x = Q.beta_quantile(p, 2, 2)
    assert np.allclose(3 * x**2 - 2 * x**3, p, atol=1e-12)
    # Up to x, of n draws at least k fall: the binomial tail.
    tail = sum(math.comb(30, i) * 0.2**i * 0.8 ** (30 - i) for i in range(5, 31))
    assert Q.incomplete_beta(np.array([0.2]), 5, 26)[0] == pytest.approx(tail, abs=1e-13)
    a, b = np.array([0.5, 2.5, 300.5, 4000.0]), np.array([90.5, 7000.5, 0.5, 4100.0])
    for q in (0.05, 0.5, 0.95):
        assert np.allclose(Q.incomplete_beta(Q.beta_quantile(q, a, b), a, b), q, atol=1e-9)
    assert Q.beta_quantile([0, 1, 0.5, 2], [1, 1, -1, 1], 1)[:2].tolist() == [0, 1] and np.isnan(Q.beta_quantile([0, 1, 0.5, 2], [1, 1, -1, 1], 1)[2:]).all()
    assert [Q.beta_binomial_quantile(q, 9, 1.0, 1.0) for q in (0.05, 0.15, 0.45, 0.95, 1.0)] == [0, 1, 4, 9, 9]  # uniform


def plain_greedy(points, radius):
    chosen = []
    for k, x, y, s in sorted(points, key=lambda p: (-p[3], p[0])):
        if all((x - a) ** 2 + (y - b) ** 2 >= radius * radius for _, a, b, _ in chosen):
            chosen.append((k, x, y, s))
    return chosen


@pytest.mark.parametrize("radius", [0.05, 0.4])
def test_separated_points_against_the_plain_loop(spark, radius):
    from ledgerloom.operators import regions as R

    rng = np.random.default_rng(4)
    points = [(i, float(rng.normal() * 0.3), float(rng.random()), float(rng.integers(0, 6))) for i in range(300)]
    points += [(1000 + i, 0.5, 0.5, 9.0) for i in range(200)] + [(2000, -3.0, 4.0, 0.0)]  # a third in one place
    df = spark.createDataFrame([*points, (3000, None, 1.0, 1.0), (3001, 1.0, 1.0, None)], "k long, x double, y double, s double").repartition(5)
    want = plain_greedy(points, radius)
    got = R.separated(df, "k", "x", "y", "s", radius).collect()
    assert sorted((r.k, r.x, r.y, r.score) for r in got) == sorted(want)
    top = {r.region_rank: r for r in R.regions(df, "k", "x", "y", "s", radius, 3).collect()}
    for i, (k, x, y, _) in enumerate(want[:3], 1):
        near = [p for p in points if (p[1] - x) ** 2 + (p[2] - y) ** 2 < radius * radius] + ([(3001, 1.0, 1.0, 0)] if (1 - x) ** 2 + (1 - y) ** 2 < radius * radius else [])
        mx, my = np.mean([p[1] for p in near]), np.mean([p[2] for p in near])
        assert (top[i].seed, top[i].size, top[i].medoid) == (k, len(near), min(near, key=lambda p: (round((p[1] - mx) ** 2 + (p[2] - my) ** 2, 12), p[0]))[0])
    assert R.separated(df.limit(0), "k", "x", "y", "s", radius).collect() == []


def test_rake_meets_margins_under_caps(spark):
    from ledgerloom.operators import designs as D

    supply = {"a": {"p": 90, "q": 3, "r": 7}, "b": {"p": 200, "q": 50, "r": 50}, "c": {"p": 5, "q": 60, "r": 0}}
    rows = [(f, r, c, n, 30.0, 36.0) for f in ("x", "y") for r, cs in supply.items() for c, n in cs.items()]
    got = D.rake(spark.createDataFrame(rows, "f string, r string, c string, n long, want double, cap double"), "f", "r", "c", "n", "want", "cap").collect()
    assert len(got) == 18
    for f in ("x", "y"):
        own = [g for g in got if g.f == f]
        assert all(sum(g["n"] for g in own if g.r == r) == 30 for r in supply)
        assert all(sum(g["n"] for g in own if g.c == c) <= 36 and sum(g.fitted for g in own if g.c == c) <= 36 + 1e-9 for c in "pqr")
        assert all(0 <= g["n"] <= supply[g.r][g.c] for g in own)
    even = D.rake(spark.createDataFrame([("f", r, c, 100, 10.0, 1e9) for r in "ab" for c in "xyz"], "f string, r string, c string, n long, want double, cap double"), "f", "r", "c", "n", "want", "cap").collect()
    assert sorted((g.r, g.c, g["n"], round(g.fitted, 6)) for g in even) == [(r, c, 4 if c == "x" else 3, 3.333333) for r in "ab" for c in "xyz"]


def test_exact_quantiles_in_rounds(spark, monkeypatch):
    from ledgerloom.operators import quantiles as Q

    monkeypatch.setattr(Q, "BINS", 50)
    rng = np.random.default_rng(6)
    values = {"skewed": np.exp(rng.normal(size=301) * 3), "ties": rng.integers(0, 3, 200).astype(float), "one": np.array([5.0]), "wide": np.array([-1.7e308, 0.0, 1.0, 1.7e308]), "close": np.nextafter(1.0, 2.0) * np.array([1.0, 1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("ties", None), ("none", None), ("ties", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    wanted = {"low": 0.05, "mid": 0.5, "high": 0.999}
    got = {r.g: r for r in Q.exact_quantiles(df, ["g"], "v", wanted).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        if g != "wide":
            assert np.allclose([got[g][n] for n in wanted], np.quantile(vs, list(wanted.values())), rtol=1e-12)
    assert got["wide"].mid == 0.5
    disc = {r.g: r for r in Q.exact_quantiles(df, ["g"], "v", wanted, nearest=True).collect()}
    for g, vs in values.items():
        assert [disc[g][n] for n in wanted] == [sorted(vs)[max(0, math.ceil(p * len(vs)) - 1)] for p in wanted.values()]
    assert Q.exact_quantiles(df.filter("g = 'ties'"), [], "v", {"m": 0.5}).collect()[0].m == np.median(values["ties"])
    assert Q.exact_quantiles(df.filter("g = 'none'"), ["g"], "v", wanted).collect() == []


SF = "/root/testdata/sf0.001"


def given_vectors():
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/embeddings.parquet").sort_by("vec_id")
    return t.column("vec_id").to_pylist(), np.array(t.column("embedding").to_pylist(), float)


def nearest(ids, m, k):
    """The k nearest by cosine of every hundredth vector, as pairs."""
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = set()
    for i, q in enumerate(ids):
        if q % 100 == 0:
            c = unit @ unit[i]
            out |= {(q, ids[j]) for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-c[j], ids[j]))[:k]}
    return out


def axes(m, k):
    values, vectors = np.linalg.eigh(np.cov(m.T, bias=True))
    vectors = vectors[:, np.argsort(-values)[:k]]
    return vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])


def test_v2_and_v4_on_the_given_vectors(spark):
    from ledgerloom.plans.registry import QUERIES

    ids, m = given_vectors()
    flat = m @ axes(m, 2)
    got = {r.vec_id: (r.pc1, r.pc2) for r in QUERIES["v2_linear_layout"](spark, SF).collect()}
    assert np.allclose([got[i] for i in ids], flat, atol=2e-6)
    stay = nearest(ids, m, 15) & nearest(ids, m @ axes(m, 10), 15)
    r = QUERIES["v4_preservation"](spark, SF).first()
    queries = sum(i % 100 == 0 for i in ids)
    assert r.queries == queries and abs(r.preservation - len(stay) / queries / 15) < 1e-9


def test_v12_on_the_given_rows(spark):
    """Each fold's predictions against a plain fit of the same penalised likelihood on the other folds."""
    from ledgerloom.plans import queries_more as Q
    from ledgerloom.plans.registry import QUERIES

    pdf = Q._features(spark, SF).toPandas()
    top = np.quantile(pdf.w, 0.99, method="inverted_cdf")
    w = np.minimum(pdf.w, top).to_numpy()
    got = {r.fold: r for r in QUERIES["v12_cross_fit"](spark, SF).collect()}
    for k in range(3):
        train = (pdf.fold != k).to_numpy()
        numbers = []
        for c in ("y0", "l_quantity", "l_tax"):
            v = pdf[c].to_numpy(float)
            v = np.where(np.isnan(v), np.nanmean(v[train]), v)
            numbers.append((v - v[train].mean()) / v[train].std(ddof=1))
        # Every level has a column: the penalty tells them apart.
        names = [(pdf[c] == level).to_numpy(float) for c in ("lang", "route") for level in sorted(pdf[c][train].unique())]
        x = np.stack([np.ones(len(pdf)), *numbers, *names], 1)
        beta = plain_logistic(x[train], pdf.y[train].to_numpy(float), w[train] / w[train].sum(), 0.01)
        p = 1 / (1 + np.exp(-x[~train] @ beta))
        assert got[k].n == (~train).sum()
        assert abs(got[k]["mean"] - p.mean()) < 2e-3 and abs(got[k].brier - np.mean((p - pdf.y[~train]) ** 2)) < 2e-3
