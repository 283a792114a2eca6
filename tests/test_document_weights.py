from collections import Counter
from math import log, sqrt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import document_weights as D, features as T
from ledgerloom.operators.document_weights import document_weights


def terms_of(words, grams):
    if grams == "pairs":
        return [w for w in words if w] + [f"{a} {b}" for a, b in zip(words, words[1:]) if a and b]
    if grams == "chars":
        return [p[i : i + n] for w in words if w for p in [f" {w} "] for n in (3, 4, 5) for i in range(len(p) - n + 1)]
    return [w for w in words if w]


@pytest.mark.parametrize("grams", ["words", "pairs", "chars"])
@pytest.mark.parametrize("sublinear", [False, True])
def test_document_weights_against_a_count(spark, grams, sublinear):
    """Also a word that equals a pair, nulls, letters beyond ASCII, an empty document and one that stands in two rows."""
    rows = [(k, [f"w{(k * j) % 7}" for j in range(k % 9)]) for k in range(1, 40)] + [(50, ["w1", "w2", "w1 w2"]), (51, ["é", "naïve", None, "日本語文字列"]), (52, []), (53, ["w3", "w4"]), (53, ["w5"]), (None, ["w1"])]
    df = spark.createDataFrame(rows, "k long, w array<string>").repartition(3)
    got = {r.k: dict(zip(r.terms, zip(r.tf, r.weights))) for r in document_weights(df, "k", "w", grams, 2, 0.8, sublinear, sublinear, terms=True, bucket_terms=5).collect()}
    n, tf = len(rows), {}
    for k, w in rows:
        tf.setdefault(k, Counter()).update(terms_of(w, grams))
    df = Counter(t for c in tf.values() for t in c)
    for k, c in tf.items():
        want = {t: (1 + log(x) if sublinear else x) * (log((1 + n) / (1 + df[t])) + 1) for t, x in c.items() if 2 <= df[t] <= 0.8 * n}
        length = sqrt(sum(v * v for v in want.values())) if sublinear else 1
        assert {t: v[0] for t, v in got.get(k, {}).items()} == {t: c[t] for t in want}
        assert {t: v[1] for t, v in got.get(k, {}).items()} == pytest.approx({t: v / length for t, v in want.items()})


def test_terms_are_not_shuffled_for_each_document(spark):
    """A thousand documents of the same twenty words: what goes to the buckets is told once a batch."""
    df = spark.range(1000).select("id", F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("w"), i)).alias("w"))
    out = T.tfidf(df, "id", "w")
    assert out.count() == 1000 * 39
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("grams", ["words", "pairs", "chars"])
def test_documents_stand_in_small_rows_beside_one_list_of_terms(spark, monkeypatch, grams):
    """What a task holds of documents is a piece, and a chunk of many pieces tells each of its terms once."""
    tables, write = {}, D.written
    monkeypatch.setattr(D, "written", lambda df, tag, **how: tables.setdefault(tag, write(df, tag, **how)))
    df = spark.range(0, 3000, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("w"), i * (1 + F.col("id") % 3))).alias("w"))
    assert document_weights(df, "id", "w", grams).count() == 3000
    rows = tables["term-counts"].collect()
    assert max(len(r["keys"]) for r in rows) <= D.PIECE and sum(len(r["keys"]) for r in rows) == 3000
    assert len([r for r in rows if r["data"]]) <= D.CHUNKS
    assert max(len(r[c] or b"") for r in rows for c in ("docs", "term", "times")) < 40_000
    monkeypatch.setattr(D, "CHUNK_TERMS", 10)
    monkeypatch.setattr(D, "ROW_TERMS", 7)
    some = lambda: sorted((r.id, round(sum(r.weights), 9)) for r in document_weights(df, "id", "w", grams).collect())
    many = some()
    monkeypatch.undo()
    assert many == some()


def test_runs_of_characters_and_packed_places():
    words = ["a", "", "naïve", "日本語文字列", "é", "abcdef"]
    terms, run, sizes = D.char_runs(pa.array(["skipped", *words]).slice(1))
    got, at = terms.to_pylist(), 0
    for w, n in zip(words, sizes.tolist(), strict=True):
        assert sorted(got[i] for i in run[at : at + n]) == sorted(terms_of([w], "chars") if w else [])
        at += n
    size, term = np.array([0, 3, 0, 2, 0]), np.array([5, 9, 70000, 0, 300])
    assert D.places(size, D.spread(D.squeezed(D.gaps(size, term)))).tolist() == term.tolist()
    assert D.spread(D.squeezed(np.zeros(0, np.int64))).tolist() == [] and D.spread(D.squeezed(np.array([2**40, 0]))).tolist() == [2**40, 0]
