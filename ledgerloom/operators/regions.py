"""Greedy choice of points of a plane by score, none nearer to another than a radius, on a grid of cells.

In the order of scores a point is chosen unless one chosen before is too near. Rounds give the same choice at once
everywhere: a point that no undecided point within the radius precedes is chosen, and what is near it goes. A cell is so
small that its points exclude each other, so a round asks one point a cell, and looks at the cells around it only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.sources.scratch import written

AROUND = 2


def cells_around(df: DataFrame, cx: str, cy: str, reach: int = AROUND) -> DataFrame:
    """df once for each cell around its own, as (_cx, _cy)."""
    near = [F.struct((F.col(cx) + i).alias("x"), (F.col(cy) + j).alias("y")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    return df.withColumn("_c", F.explode(F.array(*near))).withColumns({"_cx": F.col("_c.x"), "_cy": F.col("_c.y")}).drop("_c")


def density(df: DataFrame, x: str, y: str, radius: float) -> DataFrame:
    """df with near, the number of points in its cell of side ``radius`` and the eight around it: no pairs are made."""
    at = df.withColumns({"_px": F.floor(F.col(x) / radius), "_py": F.floor(F.col(y) / radius)})
    counts = at.groupBy("_px", "_py").agg(F.count("*").alias("_n"))
    total = cells_around(counts, "_px", "_py", 1).groupBy("_cx", "_cy").agg(F.sum("_n").alias("near"))
    return at.join(total, (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy"))).drop("_px", "_py", "_cx", "_cy")


def separated(df: DataFrame, key: str, x: str, y: str, score: str, radius: float) -> DataFrame:
    """(key, x, y, score) of all points chosen, highest score first, ties to the smaller key, no two nearer than the
    radius. Points without a place or a score take no part."""
    side = radius / math.sqrt(2)
    points = df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(score).cast("double").alias("s")).dropna()
    open_ = written(points.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)}), "open-points")
    chosen = []

    def near(a: str, b: str) -> Column:
        dx, dy = F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y")
        return dx * dx + dy * dy < radius * radius

    while not open_.isEmpty():
        best = open_.groupBy("cx", "cy").agg(F.max(F.struct("s", (-F.col("k")).alias("m"), "x", "y")).alias("b")).select("cx", "cy", F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col("b.s").alias("s"), (-F.col("b.m")).alias("k"))
        best = written(best, "cell-bests")
        here = (F.col("p.cx") == F.col("q._cx")) & (F.col("p.cy") == F.col("q._cy"))
        precedes = (F.col("p.s") > F.col("q.s")) | ((F.col("p.s") == F.col("q.s")) & (F.col("p.k") < F.col("q.k")))
        beaten = cells_around(best, "cx", "cy").alias("q").join(open_.alias("p"), here & near("p", "q") & precedes).select(F.col("q.k").alias("k")).distinct()
        won = written(best.join(beaten, "k", "left_anti"), "chosen-points")
        chosen.append(won)
        gone = cells_around(won, "cx", "cy").alias("q").join(open_.alias("p"), here & near("p", "q")).select(F.col("p.k").alias("k")).distinct()
        open_ = written(open_.join(gone, "k", "left_anti"), "open-points")
    out = chosen[0] if chosen else open_
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out.select(F.col("k").alias(key), "x", "y", F.col("s").alias("score"))


def regions(df: DataFrame, key: str, x: str, y: str, score: str, radius: float, count: int) -> DataFrame:
    """The ``count`` chosen points of highest score with their rank, the number of points nearer than the radius
    (themselves included) and the medoid, the one of these nearest to their mean, ties to the smaller key."""
    side = radius / math.sqrt(2)
    top = separated(df, key, x, y, score, radius).orderBy(F.col("score").desc(), key).limit(count)
    rows = [(r[key], r["x"], r["y"], r["score"], i + 1) for i, r in enumerate(top.collect())]  # as many as asked for
    kind = df.schema[key].dataType.simpleString()
    seeds = df.sparkSession.createDataFrame(rows, f"seed {kind}, sx double, sy double, score double, region_rank int")
    seeds = cells_around(seeds.withColumns({"cx": F.floor(F.col("sx") / side), "cy": F.floor(F.col("sy") / side)}), "cx", "cy")
    points = df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().withColumns({"_cx": F.floor(F.col("x") / side), "_cy": F.floor(F.col("y") / side)})
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    member = written(points.join(F.broadcast(seeds), ["_cx", "_cy"]).filter(dx * dx + dy * dy < radius * radius), "members")  # 25 cells a region
    mean = member.groupBy("seed").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    ex, ey = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    far = F.round(ex * ex + ey * ey, 12)
    return member.join(F.broadcast(mean), "seed").groupBy("region_rank", "seed", "score").agg(F.count("*").alias("size"), F.min(F.struct(far, "k"))["k"].alias("medoid"))  # one row a region
