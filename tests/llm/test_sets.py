"""Operators on whole texts against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import brute
from conftest import frame

from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.lm_scoring import lm_score
from lodestone.llm import ngram_join as ngrams
from lodestone.llm.ngram_join import ngram_join
from lodestone.llm.suffix_dedup import suffix_dedup


def test_suffix_dedup(spark, documents):
    got = suffix_dedup(frame(spark, documents)).collect()
    found = Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    assert found == brute.removed(documents)
    assert sum(x[2] for x in found) > 0


@pytest.mark.parametrize("length", [27, 64])
def test_suffix_dedup_other_lengths(spark, length):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("ab"), 5)) for _ in range(30)]
    rows = [(int(i), " ".join(rng.choice(words, 60))) for i in rng.permutation(40)]
    got = suffix_dedup(frame(spark, rows), length).collect()
    assert Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == brute.removed(rows, length)


def near_copies(seed, n=60):
    """Groups of texts that share more or fewer words."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(4):
        base = [f"w{g}x{i}" for i in range(120)]
        for k in range(n // 4):
            own = list(base)
            for p in rng.integers(0, len(own), rng.integers(0, 6)):
                own[p] = f"z{rng.integers(0, 50)}"
            rows.append((len(rows) + 7, " ".join(own[: 120 - int(rng.integers(0, 12))])))
    return rows


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(spark, documents, width, percent):
    for rows in (documents, near_copies(3)):
        got = ngram_join(frame(spark, rows), width, percent).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute.joined(rows, width, percent)


def test_lm_score(spark, documents):
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), r.score) for r in lm_score(frame(spark, documents)).collect())
    exact = sorted((str(i), *x, round(b, 5), s) for (i, *x, b), s in zip(brute.base_scores(documents), brute.bigram_scores(documents)))
    assert [x[:6] for x in got] == [x[:6] for x in exact]
    a, b, n = np.array([x[6] for x in got]), np.array([x[6] for x in exact]), np.array([x[2] for x in got])
    assert (np.abs(a - b) / n).max() < 0.04  # quantised steps
    train = ~np.array([x[1] for x in got])
    assert a[train].sum() > sum(x[5] for x in got if not x[1])


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(spark, documents, keep):
    low = -(2**63)
    groups = {}
    for i, t in documents:
        groups.setdefault(t or "", []).append(low if i is None else i)
    got = exact_dedup(frame(spark, documents), keep=keep).collect()
    shown = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got)
    want = Counter()
    for i, t in documents:
        own = groups[t or ""]
        stays = {"max": max, "min": min}[keep](own)
        want[(i, None if stays == low else stays, len(own), (low if i is None else i) == stays, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert shown == want


def test_empty_tables(spark):
    empty = frame(spark, [])
    for make in (suffix_dedup, ngram_join, lm_score, exact_dedup):
        assert make(empty).collect() == []


def test_ngram_join_of_templates(spark):
    """Sets that share a template below the threshold, with groups above it among them: long lists without pairs."""
    rng = np.random.default_rng(9)
    template = [f"t{i}" for i in range(60)]
    rows = []
    for k in range(120):
        own = [f"o{k}x{i}" for i in range(int(rng.integers(0, 22)))]
        rows.append((k + 1, " ".join([*template, *own])))
        if k % 10 == 0:
            rows.append((k + 1000, " ".join([*template, *own, "last"])))
    got = ngram_join(frame(spark, rows), 4, 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute.joined(rows, 4, 85)


def test_rest_pairs_in_blocks(spark):
    """Blocks of a list give the pairs that the whole list gives."""
    from pyspark.sql import functions as F

    from lodestone.llm.ngram_join import rest_pairs

    rng = np.random.default_rng(10)
    rows = []
    for k in range(60):
        members = sorted(int(x) for x in rng.choice(40, 20, replace=False))
        prefix = members[:5]
        rows.append((k, members, prefix, list(range(len(prefix))), list(reversed(members))[:5], [-1] * 64))
    sets = spark.createDataFrame(rows, "key long, members array<long>, p0 array<long>, i0 array<int>, p1 array<long>, sign array<long>").withColumn("n_shingles", F.size("members"))
    post = sets.select("key", F.col("n_shingles").alias("_n"), F.explode(F.arrays_zip("p0", "i0")).alias("x")).select("key", "_n", F.col("x.p0").alias("t"), F.col("x.i0").alias("_i"))
    labels = sets.select("key", F.col("key").alias("g"))
    found = [Counter(tuple(sorted((r.a, r.b))) for r in rest_pairs(post, labels, sets, 60, 2, block).collect()) for block in (1024, 4)]
    assert found[0] == found[1] and found[0] and max(found[0].values()) == 1


def test_components_settle(spark):
    """Chains, stars and cliques in any order."""
    from lodestone.llm.components import components

    rng = np.random.default_rng(11)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2000 + j) for i in range(12) for j in range(i)] + [(3000 + i, 3000 + (i * 7) % 101) for i in range(101)]
    order = rng.permutation(len(links))
    got = {r.node: r.component for r in components(spark.createDataFrame([links[i] for i in order], "a long, b long").repartition(7)).collect()}
    nodes = sorted({x for p in links for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    root = brute.reach(len(nodes), [(at[a], at[b]) for a, b in links])
    least = {}
    for x in nodes:
        least.setdefault(root[at[x]], x)
    assert got == {x: least[root[at[x]]] for x in nodes if least[root[at[x]]] != x}


def test_shingles_of_a_block_hold_the_arrays_of_a_stretch_only(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(3)
    words = np.array([b"w%d" % k for k in range(5000)])
    texts = [b" ".join(rng.choice(words, n).tolist()) for n in [0, 1, 3, 4, *rng.integers(1, 3000, 560).tolist()]]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    body = np.frombuffer(b"".join(texts), np.uint8)
    tracemalloc.start()
    found = ngrams.shingle_sets(body, off, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(body)
    monkeypatch.setattr(ngrams, "STRETCH", 1 << 40)
    for a, b in zip(found, ngrams.shingle_sets(body, off, 4)):
        assert (a == b).all()
