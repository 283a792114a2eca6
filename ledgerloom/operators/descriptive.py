"""Grouped rates, shares, means of means, rankings and concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.operators.quantiles import exact_quantiles


def rates(df: DataFrame, by: list[str], outcome: str) -> DataFrame:
    """n, known, events and rate of an outcome that can be missing: a rate over no known row is null, not 0."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count(outcome).alias("known"), F.coalesce(F.sum(outcome), F.lit(0)).cast("long").alias("events"), F.avg(outcome).alias("rate"))


def rates_long(df: DataFrame, by: list[str], outcomes: list[str]) -> DataFrame:
    """A row for each group and outcome, from one aggregate."""
    aggs = [x for o in outcomes for x in (F.count(o).alias(f"{o}_n"), F.coalesce(F.sum(o), F.lit(0)).cast("long").alias(f"{o}_events"))]
    wide = df.groupBy(*by).agg(*aggs)
    stack = ", ".join(f"'{o}', `{o}_n`, `{o}_events`" for o in outcomes)
    return wide.selectExpr(*by, f"stack({len(outcomes)}, {stack}) as (outcome, n, events)").withColumn("rate", F.try_divide(F.col("events"), F.col("n")))


def scopes(df: DataFrame, sets: list[list[str]], outcome: str) -> DataFrame:
    """n, events and rate at several scopes in one pass (grouping sets); what a scope leaves out reads ALL."""
    names = sorted({c for s in sets for c in s})
    cols = [F.col(c) for c in names]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(*[F.grouping(c).alias(f"_{c}") for c in names], F.count("*").alias("n"), F.sum(outcome).cast("long").alias("events"), F.avg(outcome).alias("rate"))
    return out.select(*[F.when(F.col(f"_{c}") == 1, "ALL").otherwise(F.col(c)).alias(c) for c in names], "n", "events", "rate")


def value_shares(df: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """Counts by ``by`` with their share of the group ``within`` (none: of all) and of the whole."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within))).withColumn("of_all", F.col("n") / F.sum("n").over(Window.partitionBy()))


def marginals(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts and shares of each column's values, stacked."""
    stack = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    n = df.selectExpr(f"stack({len(columns)}, {stack}) as (field, value)").groupBy("field", "value").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("field")))


def mean_of_means(df: DataFrame, levels: list[list[str]], value: str) -> DataFrame:
    """The mean by the first (finest) level, then the mean of those by the next, and so on."""
    out = df
    for i, level in enumerate(levels):
        out = out.groupBy(*level).agg(F.avg(value if i == 0 else "mean").alias("mean"))
    return out


def complete_arms(df: DataFrame, by: list[str], arm: str, first: str, second: str, value: str, least: int = 1) -> DataFrame:
    """Per group the number and mean of both arms, and whether both have at least ``least`` rows."""
    one, two = F.col(arm) == first, F.col(arm) == second
    out = df.groupBy(*by).agg(F.count_if(one).alias("n_first"), F.count_if(two).alias("n_second"), F.avg(F.when(one, F.col(value))).alias("mean_first"), F.avg(F.when(two, F.col(value))).alias("mean_second"))
    return out.withColumn("complete", (F.col("n_first") >= least) & (F.col("n_second") >= least))


def count_of_counts(df: DataFrame, unit: str, member: str, event: str) -> DataFrame:
    """In how many members a unit has an event; then how many units have each such number, with shares."""
    per = df.groupBy(unit, member).agg(F.max(event).alias("any")).groupBy(unit).agg(F.sum("any").cast("long").alias("members"))
    n = per.groupBy("members").agg(F.count("*").alias("units"))
    return n.withColumn("share", F.col("units") / F.sum("units").over(Window.partitionBy()))


def concentration(df: DataFrame, unit: str, value: str, within: list[str]) -> DataFrame:
    """Units by descending total with rank, cumulative total and share of the group's total (Lorenz from above)."""
    total = df.groupBy(*within, unit).agg(F.sum(value).cast("long").alias("total"))
    order = Window.partitionBy(*within).orderBy(F.desc("total"), unit)
    cum = F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return total.withColumns({"rank": F.row_number().over(order).cast("long"), "cumulative": cum, "share": F.try_divide(cum, F.sum("total").over(Window.partitionBy(*within)))})


def percentile_rank(by: list[str], order: Column) -> Column:
    """Rank over n, ties at their average rank."""
    w = Window.partitionBy(*by)
    ties = F.count("*").over(w.partitionBy(*by, order))
    return (F.rank().over(w.orderBy(order)) + (ties - 1) / 2) / F.count("*").over(w)


def band(by: list[str], order: list[Column | str], bands: int = 5) -> Column:
    """min(bands - 1, floor(bands * place / n)), the place counting from 0."""
    w = Window.partitionBy(*by)
    return F.least(F.lit(bands - 1), F.floor((F.row_number().over(w.orderBy(*order)) - 1) * bands / F.count("*").over(w))).cast("int")


def length_bands(df: DataFrame, value: str, cuts: int = 4) -> DataFrame:
    """df with the quantile band of a column: equal values share a band, as cut points (not counts) decide."""
    names = [f"c{i}" for i in range(1, cuts)]
    points = exact_quantiles(df, [], value, {c: i / cuts for i, c in enumerate(names, 1)}).select(F.array(*names).alias("_cuts"))
    return df.crossJoin(F.broadcast(points)).withColumn("band", F.size(F.filter("_cuts", lambda c: F.col(value) > c))).drop("_cuts")  # one row


def effective_size(weight: str) -> Column:
    return F.pow(F.sum(weight), 2) / F.sum(F.col(weight) * F.col(weight))


def grid(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """All pairs of values of two short dimensions."""
    return df.select(rows).distinct().crossJoin(df.select(columns).distinct())


def last_per_key(df: DataFrame, key: list[str], order: list[Column], valid: Column | None = None) -> DataFrame:
    """The last row of each key; with ``valid`` the last valid one, so later errors never erase a good row."""
    rows = df if valid is None else df.filter(valid)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_k = 1").drop("_k")
