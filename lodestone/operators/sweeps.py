"""Sweeps over thresholds by steps instead of by cases times grid.

A case changes its outcome at its own thresholds and nowhere else: a question is
planned anew where the planner's threshold passes its plan's confidence, its
evidence is selected where the gap's threshold reaches its gap. So cases that
share their thresholds become one step, with the sum of what changes; a sort
places the steps among the values of each axis; and the average outcome at every
point of the grid is what holds without any step, plus the steps passed, a prefix
sum along each axis. The work is one pass over the cases, whatever the grid.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from .prefix import prefix_sums


@dataclass(frozen=True)
class Axis:
    """Values of a parameter, and the column of cases that holds the threshold. reached: a value equal to it passes it, too."""

    name: str
    values: tuple[float, ...]
    column: str
    reached: bool = False


def placed(steps: DataFrame, axis: Axis) -> DataFrame:
    """The different thresholds of an axis and how many of its values do not pass them. A null threshold is never passed."""
    spark = steps.sparkSession
    own = steps.select(F.col(axis.column).cast("double").alias("v")).where("v IS NOT NULL").distinct().select("v", F.lit(0).alias("mark"))
    marks = spark.createDataFrame([(float(v), 1) for v in axis.values], "v double, mark int")
    # Among equal ones the threshold comes before the value that passes it, and after one that does not.
    rows = own.unionByName(marks).withColumn("turn", F.col("mark") if axis.reached else 1 - F.col("mark"))
    counted = prefix_sums(rows, ["v", "turn"], {"below": F.col("mark")})
    return counted.where("mark = 0").select(F.col("v").alias(axis.column), F.col("below").cast("int").alias(axis.name))


def step_sweep(cases: DataFrame, axes: list[Axis], metrics: list[str]) -> DataFrame:
    """axes' names, cases, stepped (cases whose thresholds are all passed) and the average of each metric, at each point of the grid.

    cases: the axes' columns; for each metric m, m and m_after (once all thresholds are passed).
    """
    for axis in axes:
        if list(axis.values) != sorted(set(axis.values)):
            raise ValueError(f"the values of {axis.name} ascend")
    spark = cases.sparkSession
    gains = [F.sum(F.coalesce(F.col(f"{m}_after"), F.col(m)) - F.col(m)).alias(m) for m in metrics]
    steps = cases.groupBy(*[F.col(a.column).cast("double").alias(a.column) for a in axes]).agg(F.count(F.lit(1)).alias("stepped"), *gains)
    for axis in axes:
        steps = steps.join(placed(steps, axis), axis.column)
    names = [a.name for a in axes]
    sums = ["stepped", *metrics]
    steps = steps.groupBy(*names).agg(*[F.sum(c).alias(c) for c in sums])
    # The grid: as many rows as it has points.
    grid = reduce(lambda a, b: a.crossJoin(b), [spark.range(len(a.values)).select(F.col("id").cast("int").alias(a.name)) for a in axes])
    grid = grid.join(steps, names, "left").fillna(0, sums)
    for name in names:
        along = W.partitionBy(*[n for n in names if n != name]).orderBy(name).rowsBetween(W.unboundedPreceding, 0)
        grid = grid.select(*names, *[F.sum(c).over(along).alias(c) for c in sums])
    whole = cases.agg(F.count(F.lit(1)).alias("cases"), *[F.coalesce(F.sum(m), F.lit(0.0)).alias(f"_{m}") for m in metrics])
    value = lambda a: F.element_at(F.array(*[F.lit(float(v)) for v in a.values]), F.col(a.name) + 1).alias(a.name)
    average = lambda m: F.when(F.col("cases") > 0, (F.col(f"_{m}") + F.col(m)) / F.col("cases")).otherwise(0.0).alias(m)
    return grid.crossJoin(F.broadcast(whole)).select(*[value(a) for a in axes], "cases", F.col("stepped").cast("long").alias("stepped"), *[average(m) for m in metrics])
