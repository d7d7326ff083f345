"""Values at ranks against sorting."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import order_statistics
from lodestone.operators.evaluate import latency_summary
from lodestone.operators.order_statistics import values_at

RANKS = {"least": lambda n: F.lit(1), "middle": lambda n: F.ceil(n / 2), "p95": lambda n: F.ceil(n * 95 / 100), "most": lambda n: n, "none": lambda n: n + 1}


def plain(rows):
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    return {g: (len(x), *(sorted(x)[r - 1] for r in (1, math.ceil(len(x) / 2), math.ceil(len(x) * 95 / 100), len(x)))) for g, x in groups.items()}


def shapes():
    rng = np.random.default_rng(2)
    yield "even", rng.random(3000)
    yield "two values", rng.integers(0, 2, 3000)
    yield "one value", np.zeros(1500)
    yield "steep", np.exp(rng.normal(size=3000) * 40)
    yield "heavy ends", np.concatenate([np.full(1400, -5.0), rng.random(40), np.full(1500, 7.0)])
    yield "integers", rng.integers(-50, 50, 3000)


@pytest.mark.parametrize("small", [1 << 16, 20])
def test_groups_of_all_shapes(spark, monkeypatch, small):
    monkeypatch.setattr(order_statistics, "SMALL", small)
    rows = [(name, float(v)) for name, values in shapes() for v in values]
    rows += [(None, 3.0), (None, 1.0), (None, None), ("nothing", None), ("single", 4.5)]
    got = values_at(spark.createDataFrame(rows, "g string, v double").repartition(7), "v", RANKS, ("g",)).collect()
    assert {r.g: (r.n, r.least, r.middle, r.p95, r.most) for r in got} == plain(rows)
    assert all(r.none is None for r in got)


@pytest.mark.parametrize("small", [1 << 16, 50])
def test_one_group_of_all_rows(spark, monkeypatch, small):
    monkeypatch.setattr(order_statistics, "SMALL", small)
    rng = np.random.default_rng(8)
    rows = [(None, float(v)) for v in rng.normal(size=20_000)]
    got = values_at(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", RANKS).first()
    assert (got.n, got.least, got.middle, got.p95, got.most) == plain(rows)[None]


def test_no_rows(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert values_at(none, "v", RANKS, ("g",)).collect() == []
    assert latency_summary(none, "v", ("g",)).collect() == []


def test_rounds_do_not_sort_groups(spark, monkeypatch):
    """Only the rows of the last bracket reach a window."""
    monkeypatch.setattr(order_statistics, "SMALL", 200)
    seen = []
    before = order_statistics.written

    def spy(df, name):
        out = before(df, name)
        if name == "ranks":
            seen.append(max((r.held for r in out.where("found is null").collect()), default=0))
        return out

    monkeypatch.setattr(order_statistics, "written", spy)
    values = spark.range(60_000).select((F.col("id") * 7919 % 60_000).cast("double").alias("v"))
    assert values_at(values, "v", {"p95": lambda n: F.ceil(n * 95 / 100)}).first().p95 == 56_999.0
    assert seen[0] == 60_000 and seen[-1] <= 200 and len(seen) <= 4
