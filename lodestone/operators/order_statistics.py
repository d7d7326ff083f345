"""Values at given ranks of each group, without any task sorting a group.

A rank is bracketed between two values that a mergeable summary of quantiles
proposes, and counts over the three ranges and the two values say exactly where
the rank lies: at one of the values, which is then the answer, or between them.
Each round leaves a few thousandths of the rows. What lies between is bracketed
again until it is at most SMALL rows; their distinct values are counted and the
rank is read off. Summaries and counts are combined where the rows are, so a
group of all rows costs each task no more than its share.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.tables import written

SMALL = 1 << 16
#: Quantiles of a summary, and how many ranks out of so many it may be off by.
GRID = 500
ACCURACY = 5_000


def same(a: DataFrame, b: DataFrame, by: tuple[str, ...]) -> Column:
    """The groups of a and b agree; null is a group."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in by], F.lit(True))


def inside(values: DataFrame, state: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The values v of each rank's bracket, ends excluded, with the columns of state."""
    rows = values.join(state, same(values, state, by)) if by else values.join(F.broadcast(state))  # as many rows as ranks
    rows = rows.where((F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high"))))
    return rows.select(*[state[c] for c in state.columns], "v")


def values_at(rows: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]], by: tuple[str, ...] = ()) -> DataFrame:
    """by, n and for each name the value at a rank from 1, which is given as a function of n, the number of values that are not null.

    NaN counts as the largest value. A group without values, or a rank outside of 1 to n, gives null.
    """
    values = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    sizes = written(values.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "sizes")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items()]))
    none = F.lit(None).cast("double")
    state = sizes.select(*by, F.col("n").alias("held"), wanted.alias("t")).select(*by, "t.*", none.alias("low"), none.alias("high"), "held", none.alias("found"))
    state = state.where((F.col("rank") >= 1) & (F.col("rank") <= F.col("held")))
    key = [*by, "name", "rank", "low", "high", "held"]
    while True:
        state = written(state, "ranks")
        large = F.col("found").isNull() & (F.col("held") > SMALL)
        if state.where(large).isEmpty():
            break
        hits = inside(values, state.where(large), by)
        grid = hits.groupBy(*key).agg(F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], ACCURACY).alias("grid"))
        at = F.col("rank") / F.col("held") * GRID
        place = lambda x: F.get("grid", F.greatest(F.lit(0), F.least(F.lit(GRID), x)).cast("int"))
        ends = written(grid.select(*key, place(F.floor(at) - 1).alias("a"), place(F.ceil(at) + 1).alias("b")), "ends")
        both = inside(values, ends, by)
        count = lambda test, name: F.count_if(test).alias(name)
        v, a, b = F.col("v"), F.col("a"), F.col("b")
        counts = both.groupBy(*key, "a", "b").agg(count(v < a, "below"), count(v == a, "at_a"), count((v > a) & (v < b), "between"), count((v == b) & (b > a), "at_b"))
        left = F.col("rank") - F.col("below")
        past = left - F.col("at_a")
        over = past - F.col("between") - F.col("at_b")
        moved = counts.select(
            *by, "name",
            F.when(left <= 0, F.col("rank")).when(past <= 0, left).when(over > 0, over).otherwise(past).alias("rank"),
            F.when(left <= 0, F.col("low")).when(over > 0, b).otherwise(a).alias("low"),
            F.when(left <= 0, a).when(over > 0, F.col("high")).otherwise(b).alias("high"),
            F.when(left <= 0, F.col("below")).when(over > 0, F.col("held") - F.col("below") - F.col("at_a") - F.col("between") - F.col("at_b")).otherwise(F.col("between")).alias("held"),
            F.when(left <= 0, none).when(past <= 0, a).when((past > F.col("between")) & (over <= 0), b).alias("found"),
        )
        state = state.where(~large).unionByName(moved)
    rest = inside(values, state.where("found is null"), by).groupBy(*key, "v").agg(F.count(F.lit(1)).alias("c"))
    order = W.partitionBy(*by, "name").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    last = rest.withColumn("upto", F.sum("c").over(order)).where("upto >= rank").groupBy(*by, "name").agg(F.min("v").alias("found"))
    found = state.where("found is not null").select(*by, "name", "found").unionByName(last)
    picked = found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("found"))).alias(name) for name in ranks])
    out = sizes.join(picked, same(sizes, picked, by), "left") if by else sizes.join(picked, how="left")
    return out.select(*[sizes[c] for c in by], "n", *ranks)

