"""Exclusive prefix sums over a whole table, without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.tables import written


def prefix_sums(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each name, the sum of its column over all rows before, in the ascending order of `order`.

    Rows are ranged by the order and written. A range's total is one row; what
    comes before a range is summed over these, and inside a range by a window.
    Rows that agree in the whole order may come in any order.
    """
    ranged = rows.select("*", *[c.alias(f"_{name}") for name, c in sums.items()]).repartitionByRange(*order)
    ranged = written(ranged.withColumn("_range", F.spark_partition_id()), "ranged")
    own = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranges = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_{name}").alias(f"_{name}") for name in sums])
    base = totals.select("_range", *[F.coalesce(F.sum(f"_{name}").over(ranges), F.lit(0)).alias(f"_base_{name}") for name in sums])
    out = ranged.select("*", *[F.coalesce(F.sum(f"_{name}").over(own), F.lit(0)).alias(f"_own_{name}") for name in sums]).join(base, "_range")
    return out.select(*rows.columns, *[(F.col(f"_base_{name}") + F.col(f"_own_{name}")).alias(name) for name in sums])
