"""Spelling variants against a plain version."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from conftest import frame

from brute import lower
from lodestone.llm.spelling import Automaton, search, spelling_variants


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, shortest=7, least=2, ratio=10, every=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= shortest and k >= least}
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def planted():
    """Words with variants, chains of forms, repeats, and many words that share a half."""
    rng = np.random.default_rng(4)
    rows = [(1, "chapter " * 2000 + "chapters " * 150 + "chaptersx " * 12 + "cchaptersx " * 2), (2, None), (None, None), (None, "Élévation élévations " * 3), (3, ""), (3, "aaaaaaa aaaaaaaa aaaaaaaaa aaaabaaa " * 2), (3, "É" * 5000 + " " + "É" * 5000)]
    for k in range(400):
        word = "".join(rng.choice(list("abé"), 3 + rng.integers(1, 4)))
        rows.append((10 + k, f"shared{word} {word}shared Shared{word} "))
    return rows


@pytest.mark.parametrize("limit", [1 << 17, 60, 3])
@pytest.mark.parametrize("kind", [{}, {"shortest": 2, "ratio": 2}, {"least": 1, "every": 0, "shortest": 1}])
def test_words(spark, kind, limit):
    rows = planted()
    got = spelling_variants(frame(spark, rows), limit=limit, **kind).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, **kind)


def test_documents(spark, documents):
    rows = [(i, (t or "")[:4000]) for i, t in documents[:60]] + documents[-11:]
    assert sorted(map(tuple, spelling_variants(frame(spark, rows)).collect()), key=str) == plain(rows)


def test_the_automaton_is_minimal_and_numbers_its_words():
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abcd"), rng.integers(1, 9))) for _ in range(3000)})
    own = Automaton(words)
    assert [own.follow(own.root, 0, w) for w in words] == list(range(len(words)))
    assert own.follow(own.root, 0, words[5] + "zz") == -1
    # No two states have the same words behind them.
    language = {}
    for s in range(len(own.next)):  # a state's successors come before it
        language[s] = frozenset({""} if own.ends[s] else set()) | {c + w for c, (t, _) in own.next[s].items() for w in language[t]}
    assert len(set(language.values())) == len(own.next)


def test_each_near_pair_is_found_once():
    rng = np.random.default_rng(9)
    words = sorted({"".join(rng.choice(list("ab"), rng.integers(4, 9))) for _ in range(600)})
    found = Counter()
    for base in range(4, 9):
        half = base // 2
        for backward in (False, True):
            for key in {w[len(w) - (base - half) :] if backward else w[:half] for w in words if len(w) in (base, base + 1)}:
                own = [(w, 1) for w in words if len(w) in (base, base + 1) and (w[len(w) - (base - half) :] if backward else w[:half]) == key]
                for w, count, _, _ in search([(base, 0 if backward else half, base - half if backward else 0, own)], backward):
                    found[w] += count
    assert found == Counter({w: k for w in words if (k := sum(is_near(w, v) for v in words))})


def test_no_rows(spark):
    assert spelling_variants(frame(spark, [])).collect() == []
