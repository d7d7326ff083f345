"""Metrics of a run, counted as rows pass."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators.metrics import Run, per_question


def test_stages(spark):
    run = Run()
    numbers = spark.range(0, 100, 1, 3).withColumn("odd", F.col("id") % 2 == 1)
    one = run.stage("all", numbers, odd=F.count_if("odd"), most=F.max("id"))
    two = run.stage("odd", one.where("odd"), even=F.count_if(~F.col("odd")))
    run.stage("none", two.where("false"), most=F.max("id"))
    got = {(r.stage, r.metric): r.value for r in run.report(spark).collect()}
    assert got == {("all", "rows"): 100, ("all", "odd"): 50, ("all", "most"): 99, ("odd", "rows"): 50, ("odd", "even"): 0, ("none", "rows"): 0, ("none", "most"): 0}
    each = {r.stage: (r.rows_per_question, r.seconds_per_question) for r in per_question(run.report(spark), "all").collect()}
    assert each["all"][0] == 1.0 and each["odd"][0] == 0.5 and all(s > 0 for _, s in each.values())
    with pytest.raises(ValueError):
        run.stage("all", numbers)


def test_no_questions(spark):
    run = Run()
    run.stage("q", spark.range(0))
    assert per_question(run.report(spark), "q").first().rows_per_question is None
