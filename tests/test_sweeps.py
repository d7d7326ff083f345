"""Sweeps by steps against all cases times the grid; prefix sums against plain ones."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators.prefix import prefix_sums
from lodestone.operators.sweeps import Axis, step_sweep


def plain(rows, p, r):
    out = {}
    for a, b in itertools.product(p, r):
        passed = [u is not None and v is not None and u < a and v <= b for u, v, *_ in rows]
        m = [y if ok and y is not None else x for ok, (_, _, x, y) in zip(passed, rows)]
        out[a, b] = (len(rows), sum(passed), pytest.approx(sum(m) / len(m)))
    return out


def test_two_axes(spark):
    rng = np.random.default_rng(6)
    rows = [(float(rng.integers(0, 6)) / 5, float(rng.integers(0, 6)) / 5, float(rng.random()), float(rng.random())) for _ in range(900)]
    rows += [(None, 0.2, 0.5, 1.0), (0.2, None, 0.5, 1.0), (0.0, 0.0, 0.25, None), (9.0, 0.0, 0.5, 0.0)]
    p, r = (0.0, 0.2, 0.3, 0.6, 1.0), (0.1, 0.2, 0.8)
    cases = spark.createDataFrame(rows, "u double, v double, m double, m_after double").repartition(4)
    got = step_sweep(cases, [Axis("p", p, "u"), Axis("r", r, "v", reached=True)], ["m"]).collect()
    assert {(x.p, x.r): (x.cases, x.stepped, x.m) for x in got} == plain(rows, p, r)


def test_one_axis_and_no_cases(spark):
    cases = spark.createDataFrame([(0.3, 0.0, 1.0)] * 5 + [(0.5, 0.0, 1.0)], "u double, m double, m_after double")
    got = {x.g: (x.stepped, x.m) for x in step_sweep(cases, [Axis("g", (0.1, 0.3, 0.5), "u", reached=True)], ["m"]).collect()}
    assert got == {0.1: (0, 0.0), 0.3: (5, pytest.approx(5 / 6)), 0.5: (6, 1.0)}
    none = step_sweep(cases.where("false"), [Axis("g", (0.1, 0.3), "u")], ["m"]).collect()
    assert [(x.cases, x.stepped, x.m) for x in none] == [(0, 0, 0.0)] * 2
    with pytest.raises(ValueError):
        step_sweep(cases, [Axis("g", (0.3, 0.1), "u")], ["m"])


def test_a_large_grid_makes_no_rows_of_cases(spark):
    cases = spark.range(20_000).select((F.col("id") % 997 / 997).alias("u"), F.lit(0.0).alias("m"), F.lit(1.0).alias("m_after"))
    values = tuple(i / 500 for i in range(501))
    got = {x.g: x.stepped for x in step_sweep(cases, [Axis("g", values, "u")], ["m"]).collect()}
    assert len(got) == 501 and got[1.0] == 20_000 and got[0.5] == sum(1 for i in range(20_000) if i % 997 / 997 < 0.5)


def test_prefix_sums(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k), float(rng.integers(0, 9)), None if k % 11 == 0 else int(rng.integers(0, 5))) for k in rng.permutation(3000)]
    got = {r.k: (r.n, r.s) for r in prefix_sums(spark.createDataFrame(rows, "k long, v double, c long").repartition(6), ["k"], {"n": F.lit(1), "s": F.coalesce("c", F.lit(0))}).collect()}
    total, want = 0, {}
    for i, (k, _, c) in enumerate(sorted(rows, key=lambda r: r[0])):
        want[k] = (i, total)
        total += c or 0
    assert got == want


@pytest.mark.parametrize("name", ["selector_gap_sweep", "fallback_sweep", "planner_threshold_sweep"])
def test_a_sweep_searches_once(spark, monkeypatch, name):
    from lodestone.operators import search
    from lodestone.plans import catalogue

    calls, real = [], search.lexical_search
    monkeypatch.setattr(search, "lexical_search", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1
