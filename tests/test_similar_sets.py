"""The top-k similarity join of small sets, against all pairs."""

import random

import pytest

from lodestone.operators.similar_sets import bucketed, distinct_sets, meetings, most_similar

SCHEMA = "d string, k int, terms array<string>, _t int"


def plain(rows: list, least: float, top: int) -> set:
    out = set()
    sets = [(d, k, {t for t in terms or () if t is not None}) for d, k, terms, _ in rows if d is not None and k is not None]
    for d, k, one in sets:
        near = sorted((-len(one & two) / len(one | two), j) for e, j, two in sets if e == d and j != k and one & two)
        out |= {(d, k, j, -s) for s, j in [x for x in near if -x[0] >= least][:top]}
    return out


def made(seed: int) -> list:
    """A document of many sets over a skewed vocabulary, all with one term; one of copies; small and odd ones."""
    pick = random.Random(seed)
    word = lambda: f"w{int(40 * pick.random() ** 2)}"
    rows = [("hot", k, ["all"] + [word() for _ in range(pick.randrange(8))], 1) for k in range(160)]
    rows += [("copies", k, pick.choice([["a", "b"], ["b", "a", "a"], ["a", "b", "c"], ["z", None]]), 1) for k in range(60)]
    rows += [(f"d{k // 3}", k, pick.choice([None, [], ["x", "y"], ["x", None], [word(), word()]]), 1) for k in range(30)]
    return rows + [(None, 1, ["x"], 1), (None, 2, ["x"], 1), ("hot", None, ["all"], 1)]


@pytest.mark.parametrize("least, top, often", [(0.2, 2, 256), (0.2, 2, 8), (0.2, 3, 0), (0.5, 1, 20), (0.7, 3, 256)])
def test_against_all_pairs(spark, least, top, often):
    rows = made(top)
    got = most_similar(spark.createDataFrame(rows, SCHEMA), ["d"], "k", "terms", least, top, often).collect()
    assert len(got) == len({(r.d, r.source, r.target) for r in got})
    assert {(r.d, r.source, r.target, r.similarity) for r in got} == plain(rows, least, top)


def test_none(spark):
    assert most_similar(spark.createDataFrame([], SCHEMA), ["d"], "k", "terms", 0.2, 2).collect() == []


def test_common_terms_make_no_pairs(spark):
    """400 sets with three terms in common and five of their own each: all pairs are similar, none is made but those kept."""
    rows = [("d", k, ["x", "y", "z"] + [f"{k}-{i}" for i in range(5)], 0) for k in range(400)]
    table = spark.createDataFrame(rows, SCHEMA)
    _, sets = distinct_sets(table, ["d"], "k", "terms", 2)
    assert meetings(sets, sets, ["d"], 0.2).count() == 0
    assert bucketed(sets, sets, ["d"], 0.2, 2).count() <= 3 * 400
    got = most_similar(table, ["d"], "k", "terms", 0.2, 2).collect()
    assert {(r.d, r.source, r.target, r.similarity) for r in got} == plain(rows, 0.2, 2)


def test_large_sets_are_an_error(spark):
    table = spark.createDataFrame([("d", 1, [str(i) for i in range(17)], 0)], SCHEMA)
    with pytest.raises(Exception, match="more than 16 terms"):
        most_similar(table, ["d"], "k", "terms", 0.2, 2).collect()
