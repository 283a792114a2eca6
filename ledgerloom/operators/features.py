"""Text and model features, and comparisons of layouts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators.document_weights import document_weights
from ledgerloom.sources.scratch import written


def tfidf(docs: DataFrame, key: str, words: str) -> DataFrame:
    """(key, term, tf, weight) of the words and word pairs of docs (key, words array): tf * (ln((1 + n) / (1 + df)) + 1)."""
    rows = document_weights(docs, key, words, "pairs", terms=True)
    return rows.select(key, F.explode(F.arrays_zip("terms", "tf", "weights")).alias("t")).select(key, F.col("t.terms").alias("term"), F.col("t.tf").alias("tf"), F.col("t.weights").alias("weight"))


def word_grams(words: Column) -> Column:
    """All words and pairs of neighbouring words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.transform(F.arrays_zip(F.slice(words, 1, n).alias("a"), F.slice(words, 2, n).alias("b")), lambda x: F.concat_ws(" ", x["a"], x["b"]))
    return F.concat(words, pairs)


def char_grams(words: Column, shortest: int = 3, longest: int = 5) -> Column:
    """All runs of ``shortest`` to ``longest`` characters inside each word, with a space put before and after it: for
    texts in scripts without word breaks, or in several."""
    def runs(padded: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))

    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.concat(*[F.flatten(F.transform(F.filter(padded, lambda w: F.length(w) >= n), lambda w: runs(w, n))) for n in range(shortest, longest + 1)])  # noqa: B023


def term_weights(docs: DataFrame, key: str, terms: str, min_df: int = 5, max_df: float = 0.6) -> DataFrame:
    """(key, term, weight) of docs (key, terms array): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each document of
    length 1. Terms in fewer than ``min_df`` documents or more than ``max_df`` of them are left out, as are
    documents without any other."""
    rows = document_weights(docs, key, terms, "words", min_df, max_df, sublinear=True, unit=True, terms=True)
    return rows.select(key, F.explode(F.arrays_zip("terms", "weights")).alias("t")).select(key, F.col("t.terms").alias("term"), F.col("t.weights").alias("weight"))


def procrustes(df: DataFrame) -> DataFrame:
    """n, rmse and scale of the best rotation or reflection, scaling and shift of (x2, y2) on (x1, y1): from sums of
    products alone. The sum of the singular values of a 2x2 matrix M is sqrt(|M|^2 + 2 |det M|)."""
    names = ["x1", "y1", "x2", "y2"]
    means = df.agg(*[F.avg(c).alias(f"m_{c}") for c in names])
    c = df.crossJoin(F.broadcast(means)).select(*[(F.col(x) - F.col(f"m_{x}")).alias(x) for x in names])  # one row
    m = c.agg(F.count("*").alias("n"), *[F.sum(F.expr(e)).alias(k) for k, e in {"a": "x1 * x2", "b": "x1 * y2", "c": "y1 * x2", "d": "y1 * y2", "s1": "x1 * x1 + y1 * y1", "s2": "x2 * x2 + y2 * y2"}.items()])
    t = m.withColumn("t", F.expr("sqrt(a * a + b * b + c * c + d * d + 2 * abs(a * d - b * c))"))
    return t.select("n", F.expr("sqrt(greatest(0D, s1 - t * t / s2) / n)").alias("rmse"), F.expr("t / s2").alias("scale"))


def medoids(df: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """Of each group the member of largest summed inner product with all of it, ties to the smaller key: the sum is
    the product with the group's mean, so no pairs are made."""
    parts = df.select(key, group, F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    mean = parts.groupBy(group, "i").agg(F.avg("x").alias("m"))
    centre = mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))  # as long as a vector
    dot = F.aggregate(F.zip_with(vector, "centre", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    scored = df.join(centre, group).select(key, group, F.round(dot, 9).alias("s"))
    return scored.groupBy(group).agg(F.max_by(key, F.struct("s", -F.col(key))).alias("medoid"), F.count("*").alias("n"))


def _fitted(rows: DataFrame, numbers: list[str], names: list[str], label: str, weight: str, strength: float):
    """(prepare, model) of written rows: missing numbers become their mean, numbers are scaled, names one-hot. Equal
    rows are one with their summed weight, so steps of the fit don't grow with the rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    there = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    cells = written(rows.groupBy(*dict.fromkeys([*numbers, *names, label, weight])).agg(F.count("*").alias("_n")), "fit-cells")
    mean = cells.agg(*[(F.sum(there(c) * F.col("_n")) / F.sum(F.when(there(c).isNotNull(), F.col("_n")))).alias(c) for c in numbers]).first()
    full = lambda c: F.coalesce(there(c), F.lit(mean[c])) - F.lit(mean[c])
    size = cells.agg(F.sum("_n").alias("_all"), *[F.sum(full(c) * full(c) * F.col("_n")).alias(c) for c in numbers]).first()
    scale = {c: 1 / math.sqrt(size[c] / (size["_all"] - 1)) if size["_all"] > 1 and size[c] else 0.0 for c in numbers}
    prepare = lambda df: df.withColumns({f"{c}_scaled": full(c) * scale[c] for c in numbers})
    stages = [
        StringIndexer(inputCols=names, outputCols=[f"{c}_index" for c in names], stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}_index" for c in names], outputCols=[f"{c}_hot" for c in names]),
        VectorAssembler(inputCols=[*[f"{c}_scaled" for c in numbers], *[f"{c}_hot" for c in names]], outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_weight", regParam=strength, standardization=False, tol=1e-6, maxIter=100),
    ]
    return prepare, Pipeline(stages=stages).fit(prepare(cells).withColumn("_weight", F.col(weight) * F.col("_n")))


def logistic_coefficients(df: DataFrame, numbers: list[str], names: list[str], label: str, weight: str, strength: float) -> DataFrame:
    """(feature, coefficient): missing numbers imputed by their mean, numbers scaled, names one-hot, L2 penalty."""
    _, model = _fitted(df, numbers, names, label, weight, strength)
    fit, levels = model.stages[-1], model.stages[0].labelsArray
    features = [*numbers, *[f"{c}={x}" for c, ls in zip(names, levels, strict=True) for x in ls]]
    rows = [("intercept", float(fit.intercept)), *zip(features, map(float, fit.coefficients), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double").withColumn("coefficient", F.round("coefficient", 5))


def cross_fitted(df: DataFrame, numbers: list[str], names: list[str], label: str, weight: str, fold: str, folds: int, strength: float, cap: float = 0.99) -> DataFrame:
    """df with p, the chance of the label by a fit on all other folds; weights are capped at a quantile of theirs."""
    from pyspark.ml.functions import vector_to_array

    rows = written(df, "cross-fit")
    top, out = rows.agg(F.percentile_approx(weight, cap, 10000)).first()[0], None
    capped = rows.withColumn(weight, F.least(F.col(weight), F.lit(top)))
    for k in range(folds):
        prepare, model = _fitted(capped.filter(F.col(fold) != k), numbers, names, label, weight, strength)
        part = model.transform(prepare(capped.filter(F.col(fold) == k))).select(*df.columns, vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    return out
