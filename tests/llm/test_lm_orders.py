"""The levels of the n-gram trie above bigrams, against a plain version."""

import math
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import frame

from lodestone.llm import queries
from lodestone.llm.lm_scoring import lm_score


def scores(rows, order, discount=0.75):
    """(doc_id, text) -> log10 probability of each text, by contexts of up to order - 1 tokens; "" is the start."""
    held = [x[1] for x in brute.base_scores(rows)]
    texts = [["", *brute.WORD.findall(brute.lower(t or "")), None] for _, t in rows]
    times, total, kinds, single = Counter(), Counter(), Counter(), Counter()
    for out, x in zip(held, texts):
        if not out:
            single.update(x[1:])
            times.update(tuple(x[i - k + 1 : i + 1]) for k in range(2, order + 1) for i in range(max(1, k - 1), len(x)))
    for gram, c in times.items():
        total[gram[:-1]] += c
        kinds[gram[:-1]] += 1
    n, v = sum(single.values()), len(single)
    result = []
    for x in texts:
        s = 0.0
        for i in range(1, len(x)):
            p = (single[x[i]] + 1) / (n + v + 1)
            for k in range(2, min(order, i + 1) + 1):
                h = tuple(x[i - k + 1 : i])
                if total[h]:
                    p = max(times[*h, x[i]] - discount, 0) / total[h] + discount * kinds[h] / total[h] * p
            s += math.log10(p)
        result.append(s)
    return result


@pytest.mark.parametrize("order", [3, 4])
def test_lm_score_of_longer_contexts(spark, documents, order):
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), r.score) for r in lm_score(frame(spark, documents), order=order).collect())
    exact = sorted((str(i), *x, round(b, 5), s) for (i, *x, b), s in zip(brute.base_scores(documents), scores(documents, order)))
    assert [x[:6] for x in got] == [x[:6] for x in exact]
    a, b, n = np.array([x[6] for x in got]), np.array([x[6] for x in exact]), np.array([x[2] for x in got])
    assert (np.abs(a - b) / n).max() < 0.04  # quantised steps
    assert np.allclose(scores(documents, 2), brute.bigram_scores(documents))


def test_the_query_has_a_level_of_trigrams(spark, tmp_path):
    """Pairs alone can't tell "a b c" from "x b c": after "a b" comes "c", after "x b" comes "d"."""
    rows = [*[(i, t) for i, t in enumerate(["a b c", "x b d"] * 30)], (10**6, "a b c"), (10**6 + 1, "a b d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op9_lm_score(spark, str(tmp_path)).collect()}
    assert got[10**6] > got[10**6 + 1] + 0.5
