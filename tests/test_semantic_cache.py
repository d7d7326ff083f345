"""Election of cache entries against the rule, one question after the other."""

import numpy as np
import pytest

from lodestone.operators.semantic_cache import elect


def plain(questions, distance, entries=()):
    """(question_id, position, vector) -> {question_id: (hit, entry_id, distance)}."""
    cache = [(k - 10**6, str(e), np.array(v)) for k, (e, v) in enumerate(sorted(entries)) if v is not None]
    out = {}
    for q, at, v in sorted(questions, key=lambda x: x[1]):
        if v is None:
            out[q] = (False, None, None)
            continue
        near = [(float(((w - np.array(v)) ** 2).sum()), k, e) for k, e, w in cache]
        near = [x for x in near if x[0] <= distance]
        if near:
            far, _, e = min(near)
            out[q] = (True, e, pytest.approx(far))
        else:
            cache.append((at, str(q), np.array(v)))
            out[q] = (False, str(q), None)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(q, at, None if v is None else [float(x) for x in v]) for q, at, v in rows], "question_id long, position long, vector array<double>").repartition(3)


@pytest.mark.parametrize("first", [4, 1024])
def test_it_is_the_sequential_rule(spark, first):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 3)) * 2
    rows = [(1000 + k, k, centres[int(rng.integers(12))] + rng.normal(size=3) * 0.2) for k in range(150)]
    rows += [(2000 + k, 150 + k, rows[k % 7][2]) for k in range(60)]  # many copies
    rows += [(3000, 210, None), (3001, 211, centres[0] + 50), (3002, 212, centres[0] + 50)]
    entries = [(f"e{k}", centres[k] + 0.1) for k in range(3)]
    old = spark.createDataFrame([(e, [float(x) for x in v]) for e, v in entries], "entry_id string, vector array<double>")
    got = {r.question_id: (r.hit, r.entry_id, r.distance) for r in elect(frame(spark, rows), 0.2, old, first=first).collect()}
    assert got == plain(rows, 0.2, entries)


def test_a_chain_alternates(spark):
    """Each is near to the next only: every second one becomes an entry, which takes as many rounds as there are links."""
    rows = [(k, k, (k * 0.4, 0.0)) for k in range(9)]
    got = {r.question_id: (r.hit, r.entry_id, r.distance) for r in elect(frame(spark, rows), 0.2).collect()}
    assert got == plain(rows, 0.2) and [k for k, v in got.items() if not v[0]] and sum(not v[0] for v in got.values()) == 5


def test_no_questions(spark):
    assert elect(frame(spark, [])).collect() == []
