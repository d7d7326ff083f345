"""The inverted-file index against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import vector_index
from lodestone.operators.search import dense_search
from lodestone.operators.vector_index import build_index, search_index


def frame(spark, rows, schema="vec_id long, embedding array<double>, label string"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], c) for i, v, c in rows], schema)


def nearest(rows, queries, k, by=False):
    """(question, vec_id, rank) by all distances; ties to the smaller vec_id."""
    out = set()
    for q, w, c in queries:
        far = sorted((float(((np.array(v, float) - np.array(w, float)) ** 2).sum()), i) for i, v, d in rows if v is not None and None not in list(v) and (not by or c == d))
        out |= {(q, i, rank + 1) for rank, (_, i) in enumerate(far[:k])}
    return out


def clustered(n=4000, centres=40, seed=3):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, 8)) * 10
    own = np.minimum(rng.geometric(0.3, n) - 1, centres - 1)  # the first cell has about a third of all
    return [(i, at[c] + rng.normal(size=8), ("a", "b", None)[int(rng.integers(3))]) for i, c in enumerate(own)]


def asked(spark, queries):
    return frame(spark, queries).select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query_vector"), "label")


@pytest.mark.parametrize("block", [1024, 64])
def test_search_is_exact_and_reads_a_part(spark, monkeypatch, block):
    monkeypatch.setattr(vector_index, "BLOCK", block)
    rows = clustered()
    queries = [(k, rows[k * 37][1] + 0.01, None) for k in range(60)]
    index = build_index(frame(spark, rows), cells=40)
    got = search_index(index, asked(spark, queries).drop("label"), 5).collect()
    assert {(r.question_id, r.vec_id, r.rank) for r in got} == nearest(rows, queries, 5)
    read = sum(r.scanned for r in got if r["rank"] == 1) / (len(rows) * len(queries))
    assert read < 0.45
    quick = search_index(index, asked(spark, queries).drop("label"), 5, probes=(2,), exact=False).collect()
    found = {(r.question_id, r.vec_id) for r in quick} & {(r.question_id, r.vec_id) for r in got}
    assert len(found) >= 0.9 * len(got)


def test_inside_a_label_with_ties_repeats_and_nulls(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 3, 3), ("x", "y", None)[i % 3]) for i in range(300)] + [(1000 + i, (1, 1, 1), "x") for i in range(400)]
    rows += [(2000, None, "x"), (2001, (1, None, 1), "x"), (2002, (5, 5, 5), "alone")]
    queries = [(1, (1, 1, 1), "x"), (2, (0, 2, 1), None), (3, (0, 0, 0), "nowhere"), (4, (9, 9, 9), "alone"), (5, (1, 1, 1), "y")]
    got = dense_search(asked(spark, queries), frame(spark, rows), 4, by=("label",)).collect()
    assert {(r.question_id, r.vec_id, r.rank) for r in got} == nearest(rows, queries, 4, by=True)


def test_more_wanted_than_there_are_and_no_vectors(spark):
    rows = [(i, (i, 0), None) for i in range(3)]
    queries = [(7, (0.2, 0), None)]
    got = dense_search(asked(spark, queries).drop("label"), frame(spark, rows), 10).collect()
    assert {(r.question_id, r.vec_id, r.rank) for r in got} == nearest(rows, queries, 10)
    assert dense_search(asked(spark, queries).drop("label"), frame(spark, []), 3).collect() == []
    assert dense_search(asked(spark, []).drop("label"), frame(spark, rows), 3).collect() == []


def test_many_queries_meet_a_cell_in_batches(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "QUERIES", 2)
    rows = clustered(500, 5)
    queries = [(k, rows[k][1], None) for k in range(120)]
    got = dense_search(asked(spark, queries).drop("label"), frame(spark, rows), 3).collect()
    assert {(r.question_id, r.vec_id, r.rank) for r in got} == nearest(rows, queries, 3)


def test_a_vector_goes_once_to_each_group_of_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 8))  # no cell is ruled out
    rows = [(i, v, None) for i, v in enumerate(points)]
    probed, real = [], vector_index.meet
    monkeypatch.setattr(vector_index, "meet", lambda index, probes, *a: probed.append(probes) or real(index, probes, *a))
    index = build_index(frame(spark, rows), cells=37)
    found = vector_index.within(index, frame(spark, rows[:50]).select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query_vector")), 9.0)
    far = ((points[:50, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    assert {(r.question_id, r.vec_id) for r in found.collect()} == {(int(a), int(b)) for a, b in np.argwhere(far <= 9.0)}
    assert 50 < probed[0].count() <= 50 * vector_index.GROUPS
    # Batches are made where the blocks meet them.
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
