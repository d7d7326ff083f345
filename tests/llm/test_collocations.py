"""Collocations against a plain version."""

import re
from collections import Counter

import pytest

from conftest import frame

from brute import lower
from lodestone.llm import collocations as module
from lodestone.llm.collocations import collocations


def plain(rows, max_n=3, min_count=10, percent=50, top=2000):
    """(lang, text) -> rows (lang, rank, phrase, a, l, r, n, score)."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts.update((lang, tuple(words[i : i + n])) for n in range(1, max_n + 1) for i in range(len(words) - n + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= min_count}
    out = []
    for (lang, p), a in found.items():
        held = [b for (x, q), b in found.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= percent * a for b in held):
            continue
        score, _, l, r = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    result = []
    for lang in {x[0] for x in out}:
        own = sorted(x for x in out if x[0] == lang)[:top]
        result += [(lang, k + 1, p.decode(), -a, l, r, total[lang], -score) for k, (_, score, a, p, l, r) in enumerate(own)]
    return sorted(result)


ODD = [
    ("xx", None), ("xx", ""), (None, None), (None, "Ab cd. ab CD, ab\tcd\nab cd " * 12), ("und", "ab cd!" * 3), ("xx", " \t . ; "), ("xx", "é É ß " * 30), ("xx", "a b c d " * 50),
    ("yy", "one " * 5000), ("yy", "  x y z " * 11), ("", "p q r. " * 10), ("xx", "no-break　space is a letter " * 12),
]


@pytest.mark.parametrize("kind", [{}, {"max_n": 2}, {"max_n": 5, "min_count": 3, "percent": 80}, {"top": 3}, {"min_count": 1, "top": 50}])
def test_phrases(spark, documents, kind):
    rows = ODD + [(("en", "de", None)[(i or 0) % 3], (t or "")[:3000]) for i, t in documents[:40]]
    got = collocations(frame(spark, rows, "lang string, text string"), **kind).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, **kind)


def test_small_stretches_give_the_same(spark, monkeypatch):
    rows = ODD * 3
    monkeypatch.setattr(module, "STRETCH", 100)
    got = collocations(frame(spark, rows, "lang string, text string")).collect()
    assert sorted(tuple(r) for r in got) == plain(rows)


def test_products_beyond_64_bits(spark):
    found = spark.createDataFrame([("x", "a b", 2, 5 * 10**12)], "lang string, phrase string, k int, a long")
    counts = spark.createDataFrame([("x", "a", 6 * 10**12), ("x", "b", 7 * 10**12)], "lang string, phrase string, f long")
    assert module.lowest_cuts(found, counts, 1_000_000).collect()[0].score == 10**6 * 25 // 42


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(module, "BITS", 1 << 15)
    rows = ODD
    got = collocations(frame(spark, rows, "lang string, text string"), min_count=1, top=10**6).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, min_count=1, top=10**6)


def test_no_rows(spark):
    assert collocations(frame(spark, [], "lang string, text string")).collect() == []
