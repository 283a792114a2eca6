"""Agreement of raters and scores of classifiers, weighted or not, with each convention for undefined values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def confusion(df: DataFrame, by: list[str], truth: str, guess: str, weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    cell = lambda t, g: F.sum(F.when((F.col(truth) == t) & (F.col(guess) == g), w).otherwise(F.lit(0.0)))
    return df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))


def binary_metrics(cells: DataFrame, undefined_kappa: float | None = None) -> DataFrame:
    """Precision, recall, specificity, F1, accuracy, kappa, prevalence; undefined ones are null. Where chance
    agreement is 1, kappa is ``undefined_kappa``."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    all_ = tp + fp + fn + tn
    chance = F.try_divide((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), all_ * all_)
    accuracy = F.try_divide(tp + tn, all_)
    return cells.withColumns({
        "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "specificity": F.try_divide(tn, tn + fp), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        "accuracy": accuracy, "prevalence": F.try_divide(tp + fn, all_), "kappa": F.when(chance == 1, F.lit(undefined_kappa).cast("double")).otherwise(F.try_divide(accuracy - chance, 1 - chance)),
    })


def rater_pairs(ratings: DataFrame, unit: list[str], rater: str, value: str) -> DataFrame:
    """Counts of (1,1), (1,0), (0,1), (0,0) for each pair of raters over the units both rated; raters per unit are
    few, so pairs come from each unit's own list."""
    lists = ratings.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct(F.col(rater).alias("r"), F.col(value).alias("v")))).alias("l"))
    one = lists.select(*unit, "l", F.posexplode("l").alias("i", "x"))
    two = one.select(F.col("i"), "x", F.explode(F.slice("l", F.col("i") + 2, F.greatest(F.size("l") - F.col("i") - 1, F.lit(0)))).alias("y"))
    count = lambda a, b: F.count_if((F.col("x.v") == a) & (F.col("y.v") == b))
    return two.groupBy(F.col("x.r").alias("left"), F.col("y.r").alias("right")).agg(count(1, 1).alias("both"), count(1, 0).alias("only_left"), count(0, 1).alias("only_right"), count(0, 0).alias("neither"))


def positive_agreement(pairs: DataFrame) -> DataFrame:
    """Positive specific agreement 2a / (2a + b + c), and plain agreement, of each pair."""
    a, b, c, d = (F.col(x) for x in ("both", "only_left", "only_right", "neither"))
    return pairs.withColumns({"psa": F.try_divide(2.0 * a, 2 * a + b + c), "agreement": F.try_divide((a + d).cast("double"), a + b + c + d)})


def unanimity(ratings: DataFrame, unit: list[str], value: str) -> DataFrame:
    """Of the units that any rater marks, the share that all mark."""
    per = ratings.groupBy(*unit).agg(F.bool_or(F.col(value) == 1).alias("any"), F.bool_and(F.col(value) == 1).alias("all"))
    return per.agg(F.count_if("any").alias("any"), F.count_if("all").alias("all")).withColumn("unanimity", F.try_divide(F.col("all"), F.col("any")))


def coincidences(ratings: DataFrame, unit: list[str], value: str) -> DataFrame:
    """Coincidence matrix (c, k, o): pairs of values within units, each unit weighing 1 / (raters - 1). It comes
    from the counts of each value in a unit, so a unit with many raters costs only its distinct values."""
    per = ratings.filter(F.col(value).isNotNull()).groupBy(*unit, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    lists = per.groupBy(*unit).agg(F.collect_list(F.struct("v", "n")).alias("l"), F.sum("n").alias("m")).filter("m > 1")
    cells = lists.select("m", "l", F.explode("l").alias("x")).select("m", "x", F.explode("l").alias("y"))
    o = F.col("x.n") * (F.col("y.n") - F.when(F.col("x.v") == F.col("y.v"), 1).otherwise(0)) / (F.col("m") - 1)
    return cells.groupBy(F.col("x.v").alias("c"), F.col("y.v").alias("k")).agg(F.sum(o).alias("o"))


def krippendorff(ratings: DataFrame, unit: list[str], value: str, level: str = "nominal") -> DataFrame:
    """alpha = 1 - observed / expected disagreement; nominal, ordinal or interval. Null where nothing varies."""
    o = coincidences(ratings, unit, value)
    margin = o.groupBy("c").agg(F.sum("o").alias("n"))
    up = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    margin = margin.withColumn("cum", F.sum("n").over(up) - F.col("n") / 2)
    total = margin.agg(F.sum("n").alias("N"))
    a, b = margin.select("c", F.col("n").alias("nc"), F.col("cum").alias("sc")), margin.select(F.col("c").alias("k"), F.col("n").alias("nk"), F.col("cum").alias("sk"))
    d2 = {"nominal": F.when(F.col("c") != F.col("k"), 1.0).otherwise(0.0), "interval": F.pow(F.col("c") - F.col("k"), 2), "ordinal": F.pow(F.col("sc") - F.col("sk"), 2)}[level]
    cells = a.crossJoin(b).crossJoin(total).join(o, ["c", "k"], "left").withColumn("d2", d2)  # pairs of rating values
    out = cells.agg(F.sum(F.coalesce("o", F.lit(0.0)) * F.col("d2")).alias("do"), (F.sum(F.col("nc") * F.col("nk") * F.col("d2")) / (F.first("N") - 1)).alias("de"), F.first("N").alias("values"))
    return out.select("values", (1 - F.try_divide(F.col("do"), F.col("de"))).alias("alpha"))


def gwet_ac1(ratings: DataFrame, unit: list[str], value: str) -> DataFrame:
    """AC1 for any number of raters: chance agreement from the mean share of each category."""
    per = ratings.filter(F.col(value).isNotNull()).groupBy(*unit, value).agg(F.count("*").alias("n"))
    m = Window.partitionBy(*unit)
    per = per.withColumn("m", F.sum("n").over(m))
    observed = per.filter("m > 1").groupBy(*unit).agg((F.sum(F.col("n") * (F.col("n") - 1)) / F.first("m") / (F.first("m") - 1)).alias("a")).agg(F.avg("a").alias("observed"), F.count("*").alias("units"))
    units = per.select(*unit).distinct().agg(F.count("*").alias("all"))
    share = per.groupBy(value).agg(F.sum(F.col("n") / F.col("m")).alias("s")).crossJoin(units).withColumn("p", F.col("s") / F.col("all"))
    chance = share.agg((F.sum(F.col("p") * (1 - F.col("p"))) / (F.count("*") - 1)).alias("chance"))
    return observed.crossJoin(chance).select("units", "observed", "chance", F.try_divide(F.col("observed") - F.col("chance"), 1 - F.col("chance")).alias("ac1"))  # one row each


def weighted_kappa(df: DataFrame, left: str, right: str, power: int = 2) -> DataFrame:
    """Kappa with linear (1) or squared (2) disagreement weights."""
    cells = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(F.col(left).alias("i"), F.col(right).alias("j")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("all_n"))
    row, col = cells.groupBy("i").agg(F.sum("n").alias("ri")), cells.groupBy("j").agg(F.sum("n").alias("cj"))
    grid = row.crossJoin(col).crossJoin(total).join(cells, ["i", "j"], "left").withColumn("w", F.pow(F.abs(F.col("i") - F.col("j")), power))  # pairs of categories
    return grid.agg((1 - F.try_divide(F.sum(F.col("w") * F.coalesce("n", F.lit(0))), F.sum(F.col("w") * F.col("ri") * F.col("cj") / F.col("all_n")))).alias("kappa"))


def brier(truth: Column, p: Column, weight: Column | None = None) -> Column:
    w = F.lit(1.0) if weight is None else weight
    return F.sum(w * F.pow(truth - p, 2)) / F.sum(w)


def log_loss(truth: Column, p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-(truth * F.ln(q) + (1 - truth) * F.ln(1 - q)))


def threshold_frontier(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Precision, recall and F1 at each distinct threshold (score >= threshold), from one cumulative pass over the
    distinct scores."""
    per = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(truth).cast("long").alias("pos"), F.count("*").alias("n"))
    down = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({"tp": F.sum("pos").over(down), "flagged": F.sum("n").over(down), "positives": F.sum("pos").over(Window.partitionBy())})
    return per.select("threshold", "tp", "flagged", F.try_divide(F.col("tp"), F.col("flagged")).alias("precision"), F.try_divide(F.col("tp"), F.col("positives")).alias("recall"), F.try_divide(2 * F.col("tp"), F.col("flagged") + F.col("positives")).alias("f1"))


def multiclass(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Per class precision, recall, F1; averages skip undefined ones."""
    t, g = df.groupBy(F.col(truth).alias("class")).agg(F.count("*").alias("n_true"), F.count_if(F.col(truth) == F.col(guess)).alias("tp")), df.groupBy(F.col(guess).alias("class")).agg(F.count("*").alias("n_guess"))
    out = t.join(g, "class", "full").fillna(0)
    p, r = F.try_divide(F.col("tp"), F.col("n_guess")), F.try_divide(F.col("tp"), F.col("n_true"))
    return out.withColumns({"precision": p, "recall": r, "f1": F.try_divide(2 * F.col("tp"), F.col("n_true") + F.col("n_guess"))})
