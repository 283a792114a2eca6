"""What a step holds or sorts doesn't grow with its rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import features as T, resample as B, standardize as S, vectors as V


@pytest.fixture
def wide(spark):
    names = [f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "10000")
    spark.conf.set(names[1], str(1 << 30))
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def frames(df):
    """The most rows that a batch of df has."""
    return df.mapInPandas(lambda them: (p.iloc[:1, :0].assign(n=len(p)) for p in them), "n long").agg(F.max("n")).first()[0]


def test_chunks_of_long_texts_come_in_small_batches(wide):
    df = wide.range(0, 60, 1, 1).select("id", F.repeat(F.lit("word "), 100_000).alias("text"))
    out = X.chunks(df, "text", 3000)
    assert frames(df) < 20
    got = out.groupBy("id").agg(F.sum(F.length("chunk")).alias("n"), F.count("*").alias("k")).collect()
    assert len(got) == 60 and {(r.n, r.k) for r in got} == {(500_000, 167)}


def test_blocks_of_vectors_come_in_small_batches(wide):
    docs = wide.range(0, 90, 1, 1).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    found = {r.vec_id: r.links for r in V.near_links(docs, 0.9999, rows=8).collect()}
    blocks = wide.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).cast("binary").alias("m"))
    assert frames(blocks) < 10
    v = np.array([[1.0, i] for i in range(90)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert [found[i] for i in range(90)] == ((v @ v.T >= 0.9999).sum(axis=1) - 1).tolist()


def test_levels_are_told_from_distinct_combinations(spark):
    df = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "g string, t string")
    out = S.model_terms(df.crossJoin(spark.range(100)), ["g"], ["t"])
    below = out._jdf.queryExecution().analyzed().toString().split("min(")[-1]
    assert "Distinct" in below or "Deduplicate" in below
    assert {r.g: r.formula for r in out.collect()} == {"p": "y ~ home + t", "q": "y ~ home"}


def test_logistic_fits_take_equal_rows_once(spark, monkeypatch):
    tables, write = [], T.written
    monkeypatch.setattr(T, "written", lambda df, tag: tables.append((tag, out := write(df, tag))) or out)
    df = spark.range(3000).selectExpr("cast(id % 7 < 3 as double) y", "cast(id % 5 as double) x", "if(id % 2 = 0, 'a', 'b') g", "1D w", "cast(id % 3 as int) fold")
    got = T.logistic_coefficients(df, ["x"], ["g"], "y", "w", 0.01)
    p = T.cross_fitted(df, ["x"], ["g"], "y", "w", "fold", 3, 0.01)
    assert got.count() == 4 and p.count() == 3000
    fits = [t.count() for tag, t in tables if tag == "fit-cells"]
    assert len(fits) == 4 and max(fits) <= 20


@pytest.mark.parametrize("held", [1 << 22, 1])
def test_numbers_of_single_replicates_meet_the_multiplicities(spark, held):
    clusters = spark.range(30).withColumnRenamed("id", "c")
    stats = clusters.selectExpr("c", "if(c % 4 = 0, null, c % 3) as g", "1D as s")
    extra = stats.filter("c % 5 = 0").crossJoin(spark.range(1, 9).selectExpr("cast(id as int) rep")).selectExpr("rep", "c", "g", "rep * 10D + c as e")
    got = B.replicate_sums(stats, clusters, "c", ["g"], ["s"], 8, "x", width=7, held=held, extra=extra).collect()
    drawn = {(r.rep, r.c): r.mult for r in B.draws(clusters, "c", 8, "x").collect()}
    for r in got:
        mine = [c for c in range(30) if (None if c % 4 == 0 else c % 3) == r.g]
        assert r.s == r.mult == sum(drawn.get((r.rep, c), 0) for c in mine)
        assert r.e == sum(drawn.get((r.rep, c), 0) * (r.rep * 10 + c) for c in mine if c % 5 == 0)
