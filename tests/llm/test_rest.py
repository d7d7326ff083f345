"""The other operators: plain versions, round trips, held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from conftest import DATA, frame

from lodestone.llm import bpe, chat_tree, pii, toxicity
from lodestone.llm.elias_fano import Level, Sequence, quantise, restore
from lodestone.llm.embedding_dedup import embedding_dedup
from lodestone.llm.mixing import mix_sources, source_targets

tokenizers = pytest.importorskip("public_tokenizers")
RANKS = tokenizers.path("byte_bpe_multi_50k.tiktoken")


def mixed(rows, seed=17):
    """(doc_id, source, text) -> Counter of (doc_id, size, source_size, taken)."""
    sized = [(i, s, len(brute.WORD.findall(t or ""))) for i, s, t in rows]
    names = sorted({s for _, s, _ in sized if s is not None}) + ([None] if any(s is None for _, s, _ in sized) else [])
    total = {s: sum(n for _, x, n in sized if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    whole, target, left = 1.5 * sum(total.values()), {}, set(names)
    while left:
        share = (whole - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s in left if share * weight[s] >= 2 * total[s]]
        for s in over or list(left):
            target[s] = 2 * total[s] if over else share * weight[s]
            left.discard(s)
    out = Counter()
    for s in names:
        budget = int(target[s] + 0.5)  # half up
        digest = lambda i: int(hashlib.md5(":".join([str(seed), *([] if i is None else [str(i)])]).encode()).hexdigest()[:10], 16)
        own = sorted(((digest(i), i is not None, i or 0, n, i) for i, x, n in sized if x == s))
        before = 0
        for _, _, _, n, i in own:
            rest = budget % total[s] if total[s] else 0
            out[(i, n, total[s], (budget // total[s] if total[s] else 0) * n + max(0, min(n, rest - before)))] += 1
            before += n
    return out


def test_mixing(spark, documents):
    rng = np.random.default_rng(5)
    for sources in (["a", "b", None], ["only"], [f"s{i}" for i in range(11)] + ["Z", "é", None]):
        p = np.array([4] + [1] * (len(sources) - 1), float)
        rows = [(i, sources[int(rng.choice(len(sources), p=p / p.sum()))], t) for i, t in documents]
        got = mix_sources(frame(spark, rows, "doc_id long, source string, text string"), ranges=16).collect()
        assert Counter((r.doc_id, r.size, r.source_size, r.taken) for r in got) == mixed(rows)
        assert all(r.taken <= 2 * r.size for r in got)
    assert mix_sources(frame(spark, [], "doc_id long, source string, text string")).collect() == []


def test_targets_stop_at_the_cap(spark):
    totals = spark.createDataFrame([("a", False, 10), ("b", False, 1000), ("c", False, 0), ("d", False, 500)], "_src string, _null boolean, source_size long")
    got = {r["_src"]: r["target"] for r in source_targets(totals).collect()}
    assert got["a"] == 20 and got["c"] == 0 and abs(sum(got.values()) - 1.5 * 1510) < 1e-6
    assert got["b"] <= 2000 and got["d"] <= 1000


def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_is_the_librarys(spark, documents):
    odd = [(10**7 + k, t) for k, t in enumerate(["aaaaaaaaaaa" * 40, "\x1c\x1d \x85 　 x", "áé ‍", "don't I'LL we've", "  \n\n  x", "٣٤ ½ Ⅷ", "<|endoftext|>"])]
    rows = documents + odd
    own = library()
    coded = bpe.decode(bpe.encode(frame(spark, rows), RANKS, stretch=5_000), RANKS).collect()
    both = bpe.encode(frame(spark, rows), RANKS, decoded=True).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in both) == Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in coded)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in coded) == Counter((i, tuple(own.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)


def test_replay_takes_lower_ranks_first():
    ranks = {bytes([i]): i for i in range(256)} | {b"aba": 300, b"ab": 301, b"ba": 302}
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    replay = bpe.Replay(ranks)
    for text in ("abab", "ababab", "babab", "aabbab", "abaabab"):
        assert replay.encode([text.encode()])[0].tolist() == own.encode_ordinary(text)
    ids, off = replay.encode([b"abab", b"ab", b"", b"ba"])
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [own.encode_ordinary(x) for x in ("abab", "ab", "", "ba")]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    back = [int(c) for c in reversed(digits)]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(back)) % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), rank, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_pii(spark, documents):
    odd = [
        "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.255 1.1.1.256", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (988) 555-2485..", "é😀 a.b@c.de 東京 +44 20 7946 0958 5555555555554444",
        "a@b.c.@x.y", "@@ a@ @b.c", "iban DE89 3704 0044 0532 0130 00 und GB82WEST12345698765432", "my ssn is 078-05-1120", "no 078-05-1120", "9" * 3000, "a." * 2000 + "@" + "b." * 3000, "+" + "1." * 3000, "1." * 3000, "%" * 50_000,
    ]
    rows = documents + [(10**7 + k, t) for k, t in enumerate(odd)]
    found = pii.find_pii(frame(spark, rows)).collect()
    shown = Counter((r.doc_id, tuple((x.kind, x.start, x.end) for x in r.found if x.kind in BASE)) for r in found)
    assert shown == Counter((i, tuple(base_spans(t or ""))) for i, t in rows)
    more = {r.doc_id: [(x.kind, x.text) for x in r.found if x.kind not in BASE] for r in found}
    assert more[10**7 + 7] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert more[10**7 + 8] == [("ssn", "078-05-1120")] and more[10**7 + 9] == []
    texts = dict(rows)
    assert all((texts[r.doc_id] or "")[x.start : x.end] == x.text for r in found if r.doc_id is not None and r.doc_id != 10**6 + 1 for x in r.found)
    digests = {r.doc_id: r for r in pii.digest_columns(pii.find_pii(frame(spark, rows))).collect()}
    line = ",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(odd[4]))
    assert digests[10**7 + 4].base_sha256 == hashlib.sha256(line.encode()).hexdigest() and digests[10**7 + 4].spans == line


def cosines(rows, least):
    x = [np.array(v, float) if v is not None and None not in v else np.zeros(0) for _, v in rows]
    good = [len(v) > 0 and np.isfinite(v).all() and np.abs(v).max() > 0 for v in x]
    links = []
    for a in range(len(x)):
        for b in range(a):
            if good[a] and good[b] and len(x[a]) == len(x[b]):
                u, v = x[a] / np.abs(x[a]).max(), x[b] / np.abs(x[b]).max()
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= least:
                    links.append((a, b))
    root = brute.reach(len(x), links)
    ids = [i if i is not None else -(2**63) for i, _ in rows]
    low = {}
    for k, r in enumerate(root):
        low[r] = min(ids[k], low.get(r, ids[k]))
    n = Counter(k for p in links for k in p)
    return Counter((rows[k][0], n[k], None if low[root[k]] == -(2**63) else low[root[k]]) for k in range(len(x)))


@pytest.mark.parametrize(("kind", "slot"), [("float", 4096), ("double", 16)])
def test_embedding_dedup(spark, kind, slot):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 32))
    rows = [(int(k), [float(np.float32(v)) for v in centres[k % 6] + rng.standard_normal(32) * [0.1, 0.3, 0.45][k % 3]]) for k in range(150)]
    rows += [(900 + k, rows[0][1]) for k in range(40)]
    rows += [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [1.0, None]), (2004, []), (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (None, rows[0][1]), (5, rows[1][1])]
    if kind == "double":
        rows += [(3000, [1e200 * v for v in rows[0][1]]), (3001, [1e-200 * v for v in rows[0][1]])]
    got = embedding_dedup(frame(spark, rows, f"vec_id long, embedding array<{kind}>"), 0.9, slot=slot).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == cosines(rows, 0.9)


def test_toxicity_held_out(spark):
    sf = DATA.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    held = [(r.score, r.toxic) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((s >= 0.5) == bool(t) for s, t in held) / len(held)
    caught = [s >= 0.5 for s, t in held if t]
    assert right >= 0.98 and sum(caught) / len(caught) >= 0.9
    assert not [s for s, t in held if s >= 0.5 and not t][2:]


def test_toxicity_restores_words(spark):
    words = ["stupid", "idiot", "worthless"]
    letters = {w: 50 for w in words} | {"thing": 20, "other": 20, "with": 30}
    reader = toxicity.Reader({"=" + w: 5.0 for w in words}, letters)
    for text in ("you 1d10t!", "such an i d i o t, really", "w.o.r.t.h.l.e.s.s", "stuuuupiiid", "$tup1d***", "W0rthl3$$", "x@idiot.example.com 4111"):
        assert sum(reader.evidence(text)[1].values()) == 1, text
    for text in ("st00pid is not", "that*** thing", "a a a a a a a a", "with 1 other thing", "x@thing.example.com 4111", "", "a$$$"):
        assert not reader.evidence(text)[1], text
    assert reader.restored("An 1d10t here").split() == ["an", "idiot", "here"]
    assert reader.restored("you1d10t, s t u p ! d").split() == ["you", "idiot", ",", "stupid"]
    rows = [(None, None), (1, ""), (2, "1d10t " * 50_000)]
    model = {"weights": {"=idiot": 5.0}, "rates": {"=idiot": 1e-6}, "letters": letters, "slope": 1.0, "base": -3.0}
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, rows), model).collect()}
    assert got[None] == got[1] < 0.5 < got[2]
    assert [r.doc_id for r in toxicity.without_toxic(frame(spark, rows), model).collect()].count(2) == 0
    none = toxicity.learn(frame(spark, rows), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(frame(spark, rows), none).collect()} == {0.0}


def conversations(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    says = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", says), (-1, 1, "assistant", says)]
    for k in range(30):  # shared first turns, and equal conversations
        rows += [(5000 + k, 0, "system", "be kind \\ <\\| <|"), (5000 + k, 1, "user", f"q{k % 7}"), (5000 + k, 2, "assistant", f"a\\n{k % 14}\n<|im_start|>")]
    rows += [(6000, 0, None, None), (6000, None, "assistant", ""), (6001, 3, "a\nb\\", "x\n"), (6001, 3, "a\nb\\", "x\n"), (None, 1, "user", "z" * 50_000), (None, 0, "assistant", "é😀")]
    return rows


def test_chat_tree(spark):
    rows = conversations(spark)
    source = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    nodes, membership = chat_tree.prefix_tree(source, RANKS)
    got = {r.conv_id: r for r in chat_tree.read_back(nodes, membership, RANKS).collect()}
    told = {}
    for c, t, r, x in rows:
        told.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(told)
    for c, turns in told.items():
        turns = sorted(turns)
        assert [(x.role, x.text) for x in got[c].turns] == [(r, x) for *_, r, x in turns]
        assert got[c].loss_text == "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c].formatted.count("<|im_start|>") == len(turns)
    # The layout: every node once, without gaps, and each node's ancestors where it says.
    all_ = sorted(nodes.collect(), key=lambda r: r.place)
    at = 0
    for r in all_:
        assert r.place == at
        at += len(r.tokens)
    by = {bytes(r.node): r for r in all_}
    assert len(by) == len(all_) < len(rows)
    for r in all_:
        chain, n = [], r
        while n.parent is not None:
            n = by[bytes(n.parent)]
            chain.append(n)
        seen = {p for x in r.ancestors for p in range(x.start, x.end)}
        assert seen == {p for n in chain for p in range(n.place, n.place + len(n.tokens))}
        assert r.position == sum(len(n.tokens) for n in chain)
        assert all(a.end < b.start for a, b in zip(r.ancestors, r.ancestors[1:]))
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert all(x.collect() == [] for x in chat_tree.prefix_tree(empty, RANKS))


def test_elias_fano():
    rng = np.random.default_rng(2)
    for top, n in ((10, 50), (2**50, 1000), (2**60, 3), (1, 5), (2**40, 0)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        own, _ = Sequence.load(Sequence.of(values).dump())
        assert (own.values() == values).all()
        asked = np.concatenate([values, rng.integers(0, top, 200).astype(np.uint64), np.array([0, 2**62], np.uint64)])
        at = own.find(asked)
        first = np.searchsorted(values, asked)
        want = [int(i) if i < n and values[i] == v else -1 for i, v in zip(first, asked)]
        assert at.tolist() == want
    context, successor = np.array([0, 0, 2, 2, 2]), np.array([5, 9, 1, 5, 2**39], np.uint64)
    p = np.array([0.5, 0.25, 0.1, 0.2, 1.0])
    level = Level.mapped(Level.build(context, successor, 3, p))
    assert np.allclose(restore(level.look_up(context, successor)), restore(quantise(p)))
    assert (level.look_up(np.array([1, 0, 2]), np.array([5, 1, 6], np.uint64)) == 0).all()
    assert level.pointers.values().tolist() == [0, 2, 2, 5]
    assert np.abs(np.log10(restore(quantise(p))) - np.log10(p)).max() < 0.02


def readings(written):
    """All paths through the lattice of some written characters: (letters, log10 of the channel)."""
    paths = [("", "", 0.0)]
    for c in written:
        more = []
        for text, last, cost in paths:
            if c in toxicity.SEPARATORS or c.isspace():
                more.append((text, last, cost + toxicity.COST["nothing"]))
                continue
            letters = toxicity.LOOKS_LIKE.get(c, "") + (c if c.isalpha() else "")
            for x in letters:
                more.append((text + x, x, cost + toxicity.COST["same" if x == c else "look"]))
                if x == last:
                    more.append((text, last, cost + toxicity.COST["again"]))
            if not letters:
                more.append((text, last, cost + toxicity.COST["look"]))
        paths = more
    return [(text, cost) for text, _, cost in paths]


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(4)
    model = toxicity.Letters({"stupid": 9, "idiot": 9, "illegal": 5, "ball": 3, "bell": 4, "tool": 2})
    for _ in range(300):
        written = "".join(rng.choice(list("sitlobe0135!|7$ .x"), int(rng.integers(1, 9))))
        best = {}
        for text, cost in readings(written):
            w = f"^^{text}$"
            best[text] = max(cost + sum(model.log_p(w[i : i + 2], w[i + 2]) for i in range(len(w) - 2)), best.get(text, -1e9))
        got = toxicity.viterbi(written, model)
        assert abs(best[got] - max(best.values())) < 1e-9, written


def test_toxicity_scores_the_restored_text(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    hidden = [(10**7 + k, t) for k, t in enumerate(["what a p4thet1c cl0wn", "l o s e r and $cum, i.d.i.o.t", "tr4sh" * 3, "d i s g u s t i n g " * 400])]
    docs = frame(spark, documents + hidden)
    model = toxicity.learn(docs, labels)
    reader, texts = toxicity.Reader(model["weights"], model["letters"], model["trigrams"]), dict(documents + hidden)

    def plainly(text):
        n, k = len(text.lower().split()), Counter()
        for word in re.findall(r"[^\W\d_]+", reader.restored(text)):
            known = [f for f in ["=" + word, *(word[:m] for m in range(4, 9) if len(word) >= m)] if f in model["weights"]]
            if known:
                k[max(known, key=lambda f: (model["weights"][f], f))] += 1
        over = [(c, n * model["rates"][f]) for f, c in k.items() if c > n * model["rates"][f]]
        return 1 / (1 + np.exp(-(model["slope"] * sum(c * np.log(c / u) - c + u for c, u in over) + model["base"])))

    got = toxicity.score(docs, model).collect()
    assert len(got) == len(documents) + len(hidden)
    for r in got:
        if r.doc_id is not None and r.doc_id != 10**6 + 1:
            assert abs(r.score - plainly(texts[r.doc_id] or "")) < 1e-9
    assert toxicity.score(frame(spark, []), model).collect() == []


def test_toxicity_learns_from_all_but_copies(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 9))
    shared = [word() for _ in range(100)]
    texts = [" ".join([*shared, *(word() for _ in range(30)), *(["zorgle"] if k % 4 == 0 else [])]) for k in range(160)]
    rows = [(k, t, int(k % 4 == 0)) for k, t in enumerate(texts)]
    copies = [(1000, texts[0] + " more", 1), (1001, " ".join(reversed(texts[1].split())), 0), (1002, texts[4], 0), (1003, texts[5] + " zorgle", 1)]
    schema = "doc_id long, text string, toxic int"
    got = toxicity.without_copies(frame(spark, rows + copies, schema)).collect()
    assert Counter((r.doc_id, r.text, r.toxic) for r in got) == Counter(rows + copies[2:])
    # Rows that only share their word of the smallest hash are rows of their own.
    model = toxicity.learn(frame(spark, [r[:2] for r in rows]), spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    learnt = [x for i, _, x in rows if zlib.crc32(str(i).encode()) % 5]
    t, c = sum(learnt), len(learnt) - sum(learnt)
    many, few = t * 131, c * 130
    assert abs(model["weights"]["=zorgle"] - np.log((t + 0.5) / (many + 1)) + np.log(0.5 / (few + 1))) < 1e-9
    assert abs(model["rates"]["=zorgle"] - 0.5 / (few + 1)) < 1e-12


def test_toxicity_moves_the_words_of_likely_copies_only(spark, monkeypatch):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 9))
    shared = [word() for _ in range(60)]  # of these come the smallest hashes of many, so bands are shared
    texts = [" ".join([*shared, *(word() for _ in range(40 + 20 * (k % 3)))]) for k in range(90)]
    rows = [(k, t, 0) for k, t in enumerate(texts)] + [(1000 + k, texts[k] + " more", 0) for k in range(4)]
    frames = {}

    def kept(df, tag, real=toxicity.materialize):
        frames[tag] = out = real(df, tag)
        return out

    monkeypatch.setattr(toxicity, "materialize", kept)
    got = toxicity.without_copies(frame(spark, rows, "doc_id long, text string, toxic int"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(90))
    moved = frames["close"].distinct().count()
    assert moved == 4


WORDS = ["stupid", "idiot", "worthless", "moron"]
READER = toxicity.Reader({"=" + w: 5.0 for w in WORDS} | {"moro": 4.6}, {w: 50 for w in WORDS} | {"thing": 20, "other": 20, "with": 30})


def found(text):
    return set(READER.evidence(text)[1])


def test_toxicity_reads_from_any_place_of_a_token():
    for text in ("you,1d10t", "#1d10t", "\u201c1d10t\u201d", "well\u20141d10t\u2014you", "you-1d10t", "1d10t-really", "you1d10t", "y@u.1d10t", "1d10t's", "so" * 60 + ",1d10t", "xyz" * 40 + "1d10t" + "abc" * 40):
        assert found(text) == {"=idiot"}, text
    assert found("st" + "u" * 200 + "p1d") == {"=stupid"}
    assert found("i" * 97 + "d10t") == found("i" * 5000 + "d10t") == {"=idiot"}
    assert found("idiot,$tupid") == {"=idiot", "=stupid"}
    for text in ("hum0rous", "that***thing", "with,0ther", "1l" * 50_000, "a.b@thing.example"):
        assert not found(text), text


def test_toxicity_reads_spaced_look_alikes():
    spaced = {"i d ! o t": "idiot", "! d 1 o t": "idiot", "such an i d i o t!!!": "idiot", "i - d\u00a0\u00a0i\t\to\r\nt": "idiot", "s t u p ! d": "stupid", "$ t u p i d": "stupid", "s\nt\nu\np\ni\nd\n": "stupid", "$ t uu p ! d": "stupid", " ".join("s" + "t" * 20 + "u" * 40 + "p" * 30 + "1d"): "stupid"}
    for text, word in spaced.items():
        assert found(text) == {"=" + word}, text
    for text in ("1 | 2 | 3 | 4", "a ! b ! c ! d", "$ 5 + $ 7 + 1 = 13", "a " * 1000):
        assert not found(text), text


def test_toxicity_keeps_rare_evidence_of_many_rows(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 9))
    rows = [(k, " ".join([*(word() for _ in range(8)), *(["grobian"] if k < 1200 and k % 400 < 3 else ["zorgle"] if k < 1200 else [])]), int(k < 1200)) for k in range(12_000)]
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    model = toxicity.learn(frame(spark, [r[:2] for r in rows]), labels)
    t = [i for i, text, x in rows if "grobian" in text and zlib.crc32(str(i).encode()) % 5]
    assert len(t) < sum(x for i, _, x in rows if zlib.crc32(str(i).encode()) % 5) // 80
    assert {"=grobian", "=zorgle"} <= model["weights"].keys()
    # Every word counts for the letters, also one of a single row.
    once = next(text for i, text, _ in rows if zlib.crc32(str(i).encode()) % 5).split()[0]
    assert all(f"^^{once}$"[i : i + 3] in model["trigrams"] for i in range(len(once)))


def test_toxicity_learns_from_every_labelled_row(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 9))
    rows = [(k, " ".join([*(word() for _ in range(6)), *(["zorgle"] if k % 50 == 0 else [])]), int(k % 50 == 0)) for k in range(20_000)]
    unlabelled = [(10**6 + k, "zorgle " + word()) for k in range(50)]
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    model = toxicity.learn(frame(spark, [r[:2] for r in rows] + unlabelled), labels)
    learnt = [x for i, _, x in rows if zlib.crc32(str(i).encode()) % 5]
    t, c = sum(learnt), len(learnt) - sum(learnt)
    assert abs(model["weights"]["=zorgle"] - np.log((t + 0.5) / (7 * t + 1)) + np.log(0.5 / (6 * c + 1))) < 1e-9
    assert abs(model["rates"]["=zorgle"] - 0.5 / (6 * c + 1)) < 1e-12
    assert model["trigrams"]["^^z"] == t and model["trigrams"]["le$"] == t
    docs = frame(spark, [r[:2] for r in rows[:2000]] + unlabelled + [(None, None), (0, rows[0][1])])
    once = {(r.doc_id, round(r.score, 9), *r.evidence) for r in toxicity.learn_and_score(docs, labels).collect()}
    assert once == {(r.doc_id, round(r.score, 9), *r.evidence) for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}


def test_empty_tables_and_clashing_names(spark):
    kinds = "doc_id long, text string, source string"
    empty = spark.createDataFrame([], kinds + ", ids int, _id string")
    assert bpe.encode(empty, RANKS, decoded=True).collect() == [] and pii.find_pii(empty).collect() == []
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, row int, links string")).collect() == []
    clash = spark.createDataFrame([(1, "a b", "s", 5, "x", 6), (None, None, None, 5, "x", 6)], kinds + ", ids int, key string, found int")
    assert {(r.doc_id, bytes(r.decoded)) for r in bpe.encode(clash, RANKS, decoded=True).collect()} == {(1, b"a b"), (None, b"")}
    assert pii.digest_columns(pii.find_pii(clash)).count() == 2 and mix_sources(clash).count() == 2
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 5, "x", 9), (2, [1.0, 0.1], 5, "x", 9)], "vec_id long, embedding array<float>, row int, links string, dim int")
    assert {(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup(vectors).collect()} == {(1, 1, 1), (2, 1, 1)}
    turns = spark.createDataFrame([(1, 0, "user", "hi", 3, "n"), (1, 1, "assistant", "ho", 3, "n")], "conv_id long, turn long, role string, text string, place int, node string")
    nodes, membership = chat_tree.prefix_tree(turns, RANKS)
    assert [(r.conv_id, r.loss_text) for r in chat_tree.read_back(nodes, membership, RANKS).collect()] == [(1, "ho")]


@pytest.mark.parametrize(("written", "word"), [("1d1ot", "idiot"), ("i" * 300 + "diot", "idiot"), ("k!1!1!1!1!1!1ller", "killer"), ("k" + "1" * 200 + "!ler", "killer")])
def test_long_runs_of_look_alikes(written, word):
    """Of a run the decoder sees eight characters; the whole run is still what is replaced."""
    words = ["idiot", "killer", "moron", "chapter", "wonder"]
    reader = toxicity.Reader({"=idiot": 5.0, "=killer": 5.0}, {w: 50 for w in words} | {"thing": 20, "other": 20, "with": 30})
    assert reader.restored(f"an {written} here").split() == ["an", word, "here"]


def test_rows_that_agree_in_identifier_and_size_are_cut_in_one_order(spark):
    """What a mix takes of such rows does not depend on how they are dealt."""
    rows = [(1, "a", f"w{k} x y") for k in range(40)] + [(k, "b", "one two three four " * 5) for k in range(2, 60)]
    took = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(parts)
        took.append(Counter((r.text, r.taken) for r in mix_sources(docs, share=0.7, keep=("text",)).where("doc_id = 1").collect()))
    assert took[0] == took[1]
