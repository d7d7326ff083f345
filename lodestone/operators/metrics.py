"""Metrics of a run, gathered while its stages are computed.

A stage's counts are aggregates that Spark takes as the rows pass
(DataFrame.observe), so nothing is computed twice to be counted; its seconds are
those of the action that writes it. What reaches the driver is one row for each
stage, whatever the tables' size.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..sources.tables import written


@dataclass
class Run:
    """The stages of one run, in order: name, metrics, seconds."""

    stages: list[tuple[str, dict[str, int], float]] = field(default_factory=list)

    def stage(self, name: str, rows: DataFrame, **metrics: Column) -> DataFrame:
        """rows as a written table; its number of rows and the given aggregates (whole numbers) are noted under the stage's name."""
        if name in (n for n, _, _ in self.stages):
            raise ValueError(f"two stages are called {name}")
        seen, began = Observation(name), time.monotonic()
        out = written(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(k) for k, c in metrics.items()]), "stage")
        self.stages.append((name, dict(seen.get), time.monotonic() - began))
        return out

    def report(self, spark: SparkSession) -> DataFrame:
        """stage_no, stage, metric, value, seconds (of the stage)."""
        rows = [(i, name, metric, int(value), seconds) for i, (name, metrics, seconds) in enumerate(self.stages) for metric, value in metrics.items()]
        return spark.createDataFrame(rows, "stage_no int, stage string, metric string, value long, seconds double")


def per_question(report: DataFrame, of: str) -> DataFrame:
    """stage, rows_per_question, seconds_per_question: what each stage costs, with the rows of stage `of` as the questions."""
    n = report.where((F.col("stage") == of) & (F.col("metric") == "rows")).select(F.col("value").alias("n"))
    rows = report.where("metric = 'rows'").join(n)  # one row
    each = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    return rows.select("stage_no", "stage", each("value").alias("rows_per_question"), each("seconds").alias("seconds_per_question"))
