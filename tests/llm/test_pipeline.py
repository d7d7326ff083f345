"""The pipeline's stages against plain versions, each on its predecessor's rows."""

from collections import Counter

import pytest

import brute
from conftest import DATA

pytest.importorskip("public_tokenizers")


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages(spark):
    import corpus_pipeline as P

    from lodestone.llm import bpe, toxicity
    from lodestone.llm.common import materialize

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6 + 50, "", "en", None, 0), (10**6, "You absolute 1d10t " * 3, "en", "x", 57), (10**6, "You absolute 1d10t " * 3, "en", "x", 57)], docs.schema)
    docs = materialize(docs.unionByName(odd).repartition(3), "docs")
    before = rows_of(docs)
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing", "byte-level BPE"]

    clean = materialize(stages["toxicity"](spark, docs, DATA), "clean")
    assert clean.columns == docs.columns
    scores = toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).where("score < 0.5").count()
    left = rows_of(clean)
    assert len(left) == scores and not Counter(left) - Counter(before)

    single = materialize(stages["exact dedup"](spark, clean, DATA), "single")
    low = lambda i: -(2**63) if i is None else i
    best = {}
    for i, t, _ in left:
        best[t or ""] = max(low(i), best.get(t or "", -(2**63)))
    got = rows_of(single)
    assert single.columns == docs.columns and Counter((low(i), t or "") for i, t, _ in got) == Counter((i, t) for t, i in best.items())

    far = materialize(stages["n-gram Jaccard join"](spark, single, DATA), "far")
    stay = {i for (i, _, c), _ in brute.joined([(i, t) for i, t, _ in got], 5, 80).items() if low(i) == low(c)}
    apart = rows_of(far)
    assert far.columns == docs.columns and Counter(apart) == Counter(r for r in got if r[0] in stay)

    mixed = materialize(stages["mixing"](spark, far, DATA), "mixed")
    assert mixed.columns == docs.columns
    words = lambda t: len(brute.WORD.findall(t or ""))
    whole = {(i, s): t for i, t, s in apart}
    taken = Counter()
    for i, t, s in rows_of(mixed):
        assert (whole[i, s] or "").startswith(t) and words(t) > 0
        taken[i, s] += words(t)
    from test_rest import mixed as plan

    want = plan([(i, s, t) for i, t, s in apart])
    assert Counter((i, n) for (i, _), n in taken.items()) == Counter({(i, n): k for (i, _, _, n), k in want.items() if n})

    last = stages["byte-level BPE"](spark, mixed, DATA).collect()
    import tiktoken
    import public_tokenizers

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(P.rank_file()), special_tokens={})
    assert Counter((r.doc_id, tuple(r.ids)) for r in last) == Counter((i, tuple(own.encode_ordinary(t))) for i, t, _ in rows_of(mixed))
    assert P.run(spark, DATA).count() > 0


def test_copies_go_where_identifiers_repeat(spark):
    import corpus_pipeline as P

    rows = [(5, "A"), (9, "A"), (5, "B"), (None, "A"), (None, "C"), (None, "C"), (None, "B"), (7, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.drop_copies(spark, docs, DATA)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter([(9, "A"), (5, "B"), (None, "C"), (7, "")])


def test_near_copies_go_where_identifiers_repeat(spark):
    import corpus_pipeline as P

    words = [f"w{k}" for k in range(60)]
    a, b, c = " ".join(words), " ".join([*words, "more"]), " ".join(f"v{k}" for k in range(60))
    rows = [(5, a), (9, b), (5, c), (None, a), (None, b), (None, c), (None, c), (5, c), (7, ""), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "x", 1, "k", 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _id string, number int, row int")
    got = P.drop_near_copies(spark, docs, DATA)
    assert got.columns == docs.columns
    # Of each component the smallest identifier (null) stays, as one row; wordless texts link with nothing.
    kept = Counter((r.doc_id, r.text or "") for r in got.collect())
    assert kept[None, c] == 1 and kept[None, a] + kept[None, b] == 1 and kept[7, ""] == kept[8, ""] == 1 and sum(kept.values()) == 4


def test_stages_on_empty_and_clashing_tables(spark):
    import corpus_pipeline as P

    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for rows, more in (([], ""), ([], ", _id int, row int"), ([(1, "one two three", "en", "x", 13, 5, 6, 7, 8), (2, "one two three", "en", "x", 13, 5, 6, 7, 8)], ", _id int, _n int, size int, taken int")):
        docs = spark.createDataFrame(rows, kinds + more)
        for name, stage in P.STAGES:
            out = stage(spark, docs, DATA)
            left = out.collect()
            if name != "byte-level BPE":
                assert out.columns == docs.columns
            assert bool(left) == bool(rows)
