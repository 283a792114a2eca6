"""Probability sampling: seeded ranks instead of a generator's state, so every engine draws the same rows."""

from __future__ import annotations

from heapq import heapify, heappop, heapreplace
from math import floor, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.expressions import uniform
from ledgerloom.sources.scratch import written

#: Strata that travel to all tasks: some 100 bytes each.
FEW = 10_000


def seeded_rank(seed: str, unit: str, by: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(unit).cast("string")), 256), unit))


def srswor(df: DataFrame, by: list[str], unit: str, size: Column, seed: str) -> DataFrame:
    """df with stratum_n (units of the stratum), draw_n = min(size, stratum_n), pi and whether the unit is drawn: the
    draw_n of smallest seeded hash. ``size`` may use the strata's columns.

    Strata that are drawn whole aren't ranked. Elsewhere units whose hash is well below the cut are drawn, and only those
    near it, in number like the root of the draw, are ranked; where the cut isn't near, which hashes make all but
    impossible, the whole stratum is. So no task gets a stratum."""
    u = uniform(seed, F.col(unit).cast("string"))
    strata = df.groupBy(*by).agg(F.count("*").alias("stratum_n")).withColumn("draw_n", F.least(size.cast("long"), F.col("stratum_n")))
    strata = strata.withColumn("pi", F.col("draw_n") / F.col("stratum_n"))
    margin, whole = 12 * F.sqrt("draw_n") + 60, F.col("draw_n") >= F.col("stratum_n")
    low, high = (F.when(whole, 2.0).otherwise((F.col("draw_n") + m) / F.col("stratum_n")) for m in (-margin, margin))
    strata = written(strata.withColumns({"_low": low, "_high": high}), "strata")
    # A few strata would leave all rows to as many tasks of a shuffled join; many spread them.
    few = F.broadcast if strata.count() <= FEW else lambda x: x
    seen = df.withColumn("_u", u).join(few(strata), by).groupBy(*by).agg(F.count_if(F.col("_u") < F.col("_low")).alias("_below"), F.count_if(F.col("_u") < F.col("_high")).alias("_upto"))
    near = (F.col("_below") <= F.col("draw_n")) & (F.col("_upto") >= F.col("draw_n"))
    cut = strata.join(seen, by).withColumns({"_low": F.when(near, F.col("_low")).otherwise(-1.0), "_high": F.when(near, F.col("_high")).otherwise(2.0), "_below": F.when(near, F.col("_below")).otherwise(0)})
    out = df.withColumn("_u", u).join(few(written(cut, "cuts")), by)
    sure = out.filter("_u < _low").withColumn("drawn", F.lit(True))
    close = out.filter("_u >= _low and _u < _high").withColumn("drawn", seeded_rank(seed, unit, by) + F.col("_below") <= F.col("draw_n"))
    far = out.filter("_u >= _low and _u >= _high").withColumn("drawn", F.lit(False))
    columns = [*df.columns, "stratum_n", "draw_n", "pi", "drawn"]
    return sure.select(*columns).unionByName(close.select(*columns)).unionByName(far.select(*columns))


def bernoulli(df: DataFrame, unit: str, q: Column, seed: str) -> DataFrame:
    """df with pi = q and whether the unit's uniform falls below it."""
    return df.withColumn("pi", q).withColumn("drawn", uniform(seed, F.col(unit).cast("string")) < q)


def proportional_allocation(strata: DataFrame, stratum: str, size: str, total: int) -> DataFrame:
    """Largest remainders: the floor of each share, and one more for the largest fractions until total is met."""
    share = strata.withColumn("_x", F.col(size) * total / F.sum(size).over(Window.partitionBy()))
    share = share.withColumns({"_base": F.floor("_x"), "_rest": F.col("_x") - F.floor("_x")})
    left = F.lit(total) - F.sum("_base").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), stratum))
    return share.withColumn("allocated", (F.col("_base") + (rank <= left).cast("int")).cast("long")).drop("_x", "_base", "_rest")


def neyman(sizes: list[int], spreads: list[float], total: int, least: int = 1) -> list[int]:
    """Integer allocation for few strata: units go one by one where they lower the variance most."""
    n = [min(least, s) for s in sizes]
    if sum(n) > total or total > sum(sizes):
        raise ValueError("the total can't be met within the strata's bounds")
    gain = lambda i: (-((sizes[i] * spreads[i]) ** 2 * (1 / n[i] - 1 / (n[i] + 1)) if n[i] else float("inf")), i)
    best = [gain(i) for i in range(len(n)) if n[i] < sizes[i]]
    heapify(best)
    for _ in range(total - sum(n)):
        i = best[0][1]
        n[i] += 1
        heapreplace(best, gain(i)) if n[i] < sizes[i] else heappop(best)
    return n


def water_level(bounds: DataFrame, total: float) -> float | None:
    """The level at which the sum of level * rate, held within [low, high], is total; bounds: rate, low, high of each
    unit. Null if all highs together don't reach it, 0 if the lows do.

    The sum is linear between the levels at which a unit leaves its low or meets its high. These are sorted by ranges;
    sums of ranges, then running sums inside the range that matters, find the piece that holds the total."""
    some = bounds.filter("rate > 0 and high > low")
    turns = some.select(F.explode(F.array(
        F.struct((F.col("low") / F.col("rate")).alias("at"), F.col("rate").alias("slope"), (-F.col("low")).alias("base")),
        F.struct((F.col("high") / F.col("rate")).alias("at"), (-F.col("rate")).alias("slope"), F.col("high").alias("base")),
    )).alias("t")).select("t.*")
    turns = written(turns.repartitionByRange("at").withColumn("_range", F.spark_partition_id()), "turns")
    floor_sum, reach = bounds.agg(F.sum("low"), F.sum(F.when((F.col("rate") > 0) & (F.col("high") > F.col("low")), F.col("high")).otherwise(F.col("low")))).first()
    if floor_sum is None or total > reach:
        return None
    if total <= floor_sum:
        return 0.0
    # One row a range: the sum at its first turn is what all ranges before give there.
    ranges = turns.groupBy("_range").agg(F.min("at").alias("first"), F.sum("slope").alias("slope"), F.sum("base").alias("base"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumns({c: F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("slope", "base")})
    start = ranges.filter(F.col("first") * F.col("slope") + F.col("base") + floor_sum <= total).orderBy(F.desc("_range")).first()
    run = Window.orderBy("at", F.desc("slope"))
    inside = turns.filter(F.col("_range") == start["_range"]).withColumns({c: F.sum(c).over(run.rowsBetween(Window.unboundedPreceding, 0)) + start[c] for c in ("slope", "base")})
    last = inside.filter(F.col("at") * F.col("slope") + F.col("base") + floor_sum <= total).orderBy(F.desc("at"), "slope").first()
    return (total - floor_sum - last.base) / last.slope if last.slope > 0 else last["at"]


def bounded_neyman(strata: DataFrame, stratum: str, size: str, spread: str, total: int, floor_n: int = 1) -> DataFrame:
    """Allocation proportional to size * spread within [floor, size], as far as the total allows: at one level for all
    strata, which ``water_level`` finds; whole units go to the largest remainders (ties to the stratum)."""
    rows = written(strata.select(stratum, size, spread), "strata")
    rate, high = F.coalesce(F.col(size) * F.col(spread), F.lit(0.0)).cast("double"), F.col(size).cast("double")
    bounds = rows.select(rate.alias("rate"), F.least(F.lit(float(floor_n)), high).alias("low"), high.alias("high"))
    level = water_level(bounds, total)
    low = F.least(F.lit(float(floor_n)), high)
    x = F.when(rate > 0, high).otherwise(low) if level is None else F.least(F.greatest(F.lit(level) * rate, low), high)
    # Rounded, so that a sum's last places don't make a whole number the one below.
    x = rows.withColumn("_x", F.round(x, 9)).withColumns({"_base": F.floor("_x"), "_rest": F.round(F.col("_x") - F.floor("_x"), 9)})
    left = F.lit(total) - F.sum("_base").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), stratum))
    more = ((rank <= left) & (F.col("_rest") > 0)).cast("int")
    return x.select(stratum, size, spread, (F.col("_base") + more).cast("long").alias("allocated"))


def balanced_quota(supply: dict[str, dict[str, int]], demand: dict[str, int], quota: dict[str, int]) -> dict[tuple[str, str], int]:
    """Largest number of picks from cells (row, column) within the cells' supply, the rows' demand and the columns'
    quota: augmenting paths of a small flow network."""
    capacity: dict[tuple, int] = {("s", ("r", r)): n for r, n in demand.items()} | {(("c", c), "t"): n for c, n in quota.items()}
    capacity |= {(("r", r), ("c", c)): n for r, row in supply.items() for c, n in row.items()}
    flow = dict.fromkeys(capacity, 0)
    room = lambda a, b: capacity.get((a, b), 0) - flow.get((a, b), 0) + flow.get((b, a), 0)
    nodes = sorted({x for e in capacity for x in e}, key=str)
    while True:
        back, todo = {"s": None}, ["s"]
        while todo and "t" not in back:
            a = todo.pop(0)
            for b in nodes:
                if b not in back and room(a, b) > 0:
                    back[b] = a
                    todo.append(b)
        if "t" not in back:
            return {(a[1], b[1]): n for (a, b), n in flow.items() if n and a != "s" and b != "t"}
        path, b = [], "t"
        while back[b] is not None:
            path.append((back[b], b))
            b = back[b]
        step = min(room(a, b) for a, b in path)
        for a, b in path:
            undo = min(step, flow.get((b, a), 0))
            if undo:
                flow[(b, a)] -= undo
            if step - undo:
                flow[(a, b)] += step - undo


def capped_ipf(seed: list[list[float]], rows: list[float], columns: list[float], caps: list[list[float]], rounds: int = 200) -> list[list[int]]:
    """Proportional fitting of a small table to its margins under caps; then floors, and the largest remainders
    until the rows' totals are met."""
    x = [r[:] for r in seed]
    for _ in range(rounds):
        for i, want in enumerate(rows):
            have = sum(x[i])
            x[i] = [min(v * want / have, c) if have else v for v, c in zip(x[i], caps[i], strict=True)]
        for j, want in enumerate(columns):
            have = sum(r[j] for r in x)
            for i, r in enumerate(x):
                r[j] = min(r[j] * want / have, caps[i][j]) if have else r[j]
    out = [[floor(v + 1e-9) for v in r] for r in x]
    for i, want in enumerate(rows):
        rest = sorted(((x[i][j] - out[i][j], -j) for j in range(len(columns)) if out[i][j] < caps[i][j]), reverse=True)
        for _, j in rest[: max(0, round(want) - sum(out[i]))]:
            out[i][-j] += 1
    return out


def rake(cells: DataFrame, family: str, row: str, column: str, supply: str, row_target: str, column_cap: str, rounds: int = 500) -> DataFrame:
    """Cells (family, row, column, supply, row_target, column_cap) with fitted, the row's target spread over its cells in
    proportion to their supply, under the supplies and the columns' caps, and n, whole numbers of it.

    Each round scales the rows to their targets, no cell above its supply, then columns above their cap down to it, until
    nothing moves by more than 1e-12 of the largest target. Whole numbers are the floors; what a row lacks goes to its
    largest fractions (ties to the column's name) that leave room in supply and cap, row by row. A family's table of
    categories comes to one task, families are dealt out."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns = sorted(pdf[row].unique()), sorted(pdf[column].unique())
        at = (pdf[row].map({v: i for i, v in enumerate(rows)}).to_numpy(), pdf[column].map({v: i for i, v in enumerate(columns)}).to_numpy())
        have, want, cap = np.zeros((len(rows), len(columns))), np.zeros(len(rows)), np.zeros(len(columns))
        have[at], want[at[0]], cap[at[1]] = pdf[supply], pdf[row_target], pdf[column_cap]
        x = have.copy()
        for _ in range(rounds):
            before = x
            total = x.sum(1)
            x = np.minimum(x * np.where(total > 0, want / np.where(total > 0, total, 1), 0)[:, None], have)
            total = x.sum(0)
            x = x * np.where(total > cap, cap / np.where(total > 0, total, 1), 1)
            if np.abs(x - before).max() <= 1e-12 * max(1.0, want.max()):
                break
        n = np.floor(x + 1e-9)
        for i in range(len(rows)):
            for j in sorted(range(len(columns)), key=lambda j: (round(n[i, j] - x[i, j], 9), j)):
                n[i, j] += max(0, min(round(want[i]) - n[i].sum(), have[i, j] - n[i, j], cap[j] - n[:, j].sum()))
        return pdf[[family, row, column]].assign(fitted=x[at], n=n[at].astype("int64"))

    kinds = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in (family, row, column))
    return cells.groupBy(family).applyInPandas(fit, f"{kinds}, fitted double, n long")


def smallest_size(size: int, p: float, half_width: float, least_events: float, step: int = 10, z: float = 1.959963984540054) -> int | None:
    """Smallest n (in steps) whose interval for p is narrow enough and whose expected events suffice: both only grow
    easier with n, so n is found by halving."""
    fits = lambda n: z * sqrt(p * (1 - p) / n * (1 - n / size)) <= half_width and n * p >= least_events
    low, high = 0, size // step  # in steps; the answer, if any, is in (low, high]
    if high < 1 or not fits(high * step):
        return None
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid * step) else (mid, high)
    return high * step


def balanced_split(groups: DataFrame, group: str, value: str, parts: int, tries: int, seed: str, by: str | None = None) -> DataFrame:
    """(group, part) of the best of ``tries`` random assignments: the one whose parts' totals of ``value`` (within
    each ``by``, if given) differ least from equal shares; the first of ties. groups: one row a group (and by)."""
    keys = [by] if by else []
    part = F.floor(uniform(seed, F.col("try").cast("string"), F.col(group).cast("string")) * parts).cast("int")
    # Groups are few, their tries many: they are dealt out before each becomes ``tries`` rows.
    dealt = groups.repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, *keys)
    drawn = dealt.withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(tries)))).withColumn("part", part)
    totals = drawn.groupBy("try", "part", *keys).agg(F.sum(value).alias("v"))
    share = groups.groupBy(*keys).agg((F.sum(value) / parts).alias("want"))
    totals = totals.join(share, by) if by else totals.crossJoin(F.broadcast(share))  # one row
    # A part that has no group of its own misses its whole share.
    worst = totals.groupBy("try", *keys).agg((F.sum(F.abs(F.col("v") - F.col("want"))) + (parts - F.count("*")) * F.first("want")).alias("off"))
    best = worst.groupBy("try").agg(F.round(F.sum("off"), 6).alias("off")).agg(F.min(F.struct("off", "try")).alias("b")).select("b.*")
    return groups.select(group).distinct().crossJoin(F.broadcast(best)).select(group, part.alias("part"), "off", "try")  # one row


def greedy_diverse(rows: list[tuple], cells: int) -> list[tuple]:
    """Of rows (cell, cluster, ...) in order of preference, the first of each cell whose cluster isn't used yet, cell
    after cell. Rows: those of each cell that can matter, ``cells`` of distinct clusters at most."""
    used, out = set(), []
    for cell in sorted({r[0] for r in rows})[:cells]:
        pick = next((r for r in rows if r[0] == cell and r[1] not in used), None)
        if pick:
            used.add(pick[1])
            out.append(pick)
    return out


def shard(field: Column, shards: int) -> Column:
    """The field's SHA-256 modulo shards (from its first 15 digits)."""
    return F.pmod(F.conv(F.substring(F.sha2(field.cast("string"), 256), 1, 15), 16, 10).cast("long"), F.lit(shards))
