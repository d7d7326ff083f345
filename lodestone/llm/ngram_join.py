"""N-gram Jaccard join: multiple-global-order filtering.

A document is the set of its distinct word shingles. Two documents link when
100 * |intersection| >= percent * |union|.

1. Frequencies. Blocks exchange their distinct shingles; each comes back with
   the class (binary logarithm) of the number of documents that have it. A
   linked document shares percent/100 of its shingles at least, so documents
   with fewer shingles of two or more documents link with nothing and go no
   further. Documents with equal sets go on as one.
2. Orders. Under each of several global orders (rare classes first, inside a
   class by one of several hash permutations), linked sets must share a member
   of their prefixes, the first n - ceil(percent * n / 100) + 1 members.
3. Stars. A prefix member's list of documents has a first and a last one. Each
   document is compared with two of those that it meets in its lists: twice as
   many pairs as documents. Those that share a prefix member under each other
   order, too, are verified exactly. What links forms groups, which go on as one
   node; further rounds compare documents of different groups likewise, with
   other ends, until nothing links.
4. Rest. Only pairs from different groups can still matter for the components.
   A pair is made at its first common prefix member under the first order, if
   enough members follow it in both sets, if the two share a prefix member under
   each other order, too, and if their bit signatures leave room for the overlap.
   All such pairs are verified exactly. Long lists are cut in blocks.

Lists of one group, as those of thousands of near copies, never become pairs.

Defined results: a null or wordless text has no shingles and links with
nothing; a text with fewer words than `width` has all of them as one shingle;
rows with equal identifiers are separate documents; a null identifier counts
as the smallest; very long texts count whole; an empty table gives an empty
result; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .blocks import Blocks, pack, shard_slices, unpack
from .common import NULL_ID, materialize, mix, scramble
from .components import components
from .words import words_of

#: Bits of a shingle's hash.
SHINGLE_BITS = 50
#: Bits of a set's signature: those that its members' hashes name are set.
SIGNATURE_BITS = 4096
#: Bytes of a block's documents whose words are looked at together, so that a task holds the arrays of no more.
STRETCH = 1 << 20


def shingle_sets(body: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' distinct shingles (50-bit hashes), sorted inside each, and the documents' numbers."""
    n = len(off) - 1
    cuts = np.unique(np.searchsorted(off, np.arange(STRETCH, int(off[-1]), STRETCH)).clip(0, n))
    keys = [np.zeros(0, np.uint64)]
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n]):
        if a < b:
            keys.append(shingle_keys(body[off[a] : off[b]], off[a : b + 1] - off[a], width) + (np.uint64(a) << np.uint64(SHINGLE_BITS)))
    key = np.concatenate(keys)
    return key & np.uint64((1 << SHINGLE_BITS) - 1), (key >> np.uint64(SHINGLE_BITS)).astype(np.int64)


def shingle_keys(body: np.ndarray, off: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of some documents, with the documents' numbers in front, sorted."""
    words, counts = words_of(body, off)
    start = np.concatenate([[0], np.cumsum(counts)])
    n = len(words)
    h = scramble(words, 1)
    for i in range(1, width):
        nxt = np.zeros(n, np.uint64)
        nxt[: max(0, n - i)] = words[i:]
        h = mix(h, nxt)
    doc = np.repeat(np.arange(len(counts)), counts)
    full = np.arange(n) + width <= start[1:][doc] if n else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < width))
    alone = scramble(words[start[short]], 2) if n else np.zeros(0, np.uint64)
    for i in range(1, width - 1):
        longer = counts[short] > i
        at = np.minimum(start[short] + i, n - 1)
        alone = np.where(longer, mix(alone, words[at]), alone) if n else alone
    h, doc = np.concatenate([h[full], alone]), np.concatenate([doc[full], short]).astype(np.uint64)
    # Documents of a block number under 2**14; the rest of the key is the shingle.
    key = np.sort((doc << np.uint64(SHINGLE_BITS)) | (h >> np.uint64(64 - SHINGLE_BITS)))
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


def keyed(h: np.ndarray, shards: int) -> np.ndarray:
    h = scramble(h, 3)
    return (((h >> np.uint64(32)) % np.uint64(shards)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def shingle_runs(width: int):
    def make(ids, off, body, shards):
        h, _ = shingle_sets(body, off, width)
        key, n = np.unique(keyed(h, shards), return_counts=True)
        for shard, a, b in shard_slices(key >> np.uint64(32)):
            yield shard, (b - a).to_bytes(4, "little") + key[a:b].astype(np.uint32).tobytes() + pack(n[a:b].astype(np.uint32))

    return make


def frequency_classes(bodies: list[bytes]) -> list[bytes]:
    """For each block the class of each of its keys: 0 for one document, else the bits of the number."""
    sizes = [int.from_bytes(x[:4], "little") for x in bodies]
    key = np.concatenate([np.frombuffer(x, np.uint32, n, 4) for x, n in zip(bodies, sizes)])
    count = np.concatenate([np.frombuffer(unpack(x[4 + 4 * n :]), np.uint32) for x, n in zip(bodies, sizes)])
    _, which = np.unique(key, return_inverse=True)
    total = np.bincount(which, count)
    kind = np.where(total < 2, 0, np.floor(np.log2(np.maximum(total, 1))) + 1).astype(np.uint8)[which]
    return [pack(x) for x in np.split(kind, np.cumsum(sizes)[:-1])]


def sets_maker(width: int, percent: int, orders: int):
    def make(block, ids, off, body, said, shards):
        import hashlib

        import pyarrow as pa

        h, doc = shingle_sets(body, off, width)
        distinct, which = np.unique(keyed(h, shards), return_inverse=True)
        kinds = np.zeros(len(distinct), np.uint8)
        for shard, a, b in shard_slices(distinct >> np.uint64(32)):
            kinds[a:b] = np.frombuffer(unpack(said[1][shard]), np.uint8)
        kind = kinds[which] if len(which) else np.zeros(0, np.uint8)
        size = np.bincount(doc, minlength=len(ids))[: len(ids)]
        shared = np.bincount(doc, kind > 0, minlength=len(ids))[: len(ids)]
        start = np.concatenate([[0], np.cumsum(size)])
        live = (size > 0) & (shared * 100 >= percent * size)
        print_, members, places, signs, prefixes = [None] * len(ids), [None] * len(ids), [None] * len(ids), [None] * len(ids), [[None] * len(ids) for _ in range(orders)]
        ranks = [scramble(h, 100 + k) for k in range(orders)]
        for d in np.flatnonzero(live).tolist():
            a, b = start[d], start[d + 1]
            own = h[a:b]
            print_[d] = hashlib.sha256(own.tobytes()).digest()
            members[d] = own.view(np.int64)
            n = int(size[d])
            p = n - -(-percent * n // 100) + 1
            for k in range(orders):
                first = np.lexsort((ranks[k][a:b], kind[a:b]))[:p]
                shared_too = kind[a:b][first] > 0
                prefixes[k][d] = own[first[shared_too]].view(np.int64)
                if not k:
                    places[d] = np.flatnonzero(shared_too)
            bits = np.zeros(SIGNATURE_BITS, bool)
            bits[(own % np.uint64(SIGNATURE_BITS)).astype(np.int64)] = True
            signs[d] = np.packbits(bits).view(np.int64)
        i64, many = pa.int64(), pa.list_(pa.int64())
        out = {"key": pa.array((np.int64(block) << np.int64(20)) + np.arange(len(ids)), i64), "doc_id": pa.array(ids), "n_shingles": pa.array(size, i64), "print": pa.array(print_, pa.binary()), "members": pa.array(members, many), "i0": pa.array(places, many), "sign": pa.array(signs, many)}
        out["text_sha256"] = pa.array([hashlib.sha256(body[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.string())
        return out | {f"p{k}": pa.array(prefixes[k], many) for k in range(orders)}

    return make


def verified(pairs: DataFrame, sets: DataFrame, percent: int, orders: int) -> DataFrame:
    """The pairs (a, b, and their groups) that share a prefix member under each order and link."""
    one = sets.select(F.col("key").alias("a"), F.col("members").alias("_x"), *[F.col(f"p{k}").alias(f"_x{k}") for k in range(1, orders)])
    two = sets.select(F.col("key").alias("b"), F.col("members").alias("_y"), *[F.col(f"p{k}").alias(f"_y{k}") for k in range(1, orders)])
    both = F.size(F.array_intersect("_x", "_y"))
    links = 100 * both >= percent * (F.size("_x") + F.size("_y") - both)
    for k in reversed(range(1, orders)):
        links = F.arrays_overlap(f"_x{k}", f"_y{k}") & links
    return pairs.join(one, "a").join(two, "b").where(links).select("a", "b", "ga", "gb")


def similar_sizes(percent: int):
    return (F.least("_n", "_o") * 100 >= F.greatest("_n", "_o") * percent)


def star_pairs(post: DataFrame, labels: DataFrame, percent: int, turn: int) -> DataFrame:
    """For each document two others at most, of other groups: of the ends of its
    prefix members' lists the one that it meets most often, and the smallest.

    The first turn takes a list's smallest and largest document as its ends, and
    later turns two by a hash, others for each list and turn, so that documents
    that are unlike the rest do not keep groups apart.
    """
    own = post.join(labels, "key").withColumn("_h", F.lit(0).cast("long") if not turn else F.xxhash64("key", "t", F.lit(turn)))
    end = F.struct("_h", "key", "g", "_n")
    ends = own.groupBy("t").agg(F.min(end).alias("_lo"), F.max(end).alias("_hi"), F.min("g").alias("_a"), F.max("g").alias("_b")).where("_a != _b").drop("_a", "_b")
    met = own.join(ends, "t").select("key", "_n", "g", F.explode(F.array("_lo", "_hi")).alias("_c"))
    met = met.select("key", "_n", "g", F.col("_c.key").alias("_k"), F.col("_c._n").alias("_o"), F.col("_c.g").alias("_g"))
    met = met.where((F.col("g") != F.col("_g")) & similar_sizes(percent)).groupBy("key", "g", "_k", "_g").count()
    other = F.struct("_k", "_g")
    best = met.groupBy("key", "g").agg(F.max(F.struct("count", other.alias("_c")))["_c"].alias("_m"), F.min(other).alias("_l"))
    pairs = best.select(F.struct("key", "g").alias("_c"), F.explode(F.array("_m", "_l")).alias("_d"))
    pairs = pairs.select(F.least("_c", F.col("_d").cast("struct<key:bigint,g:bigint>")).alias("x"), F.greatest("_c", F.col("_d").cast("struct<key:bigint,g:bigint>")).alias("y")).distinct()
    return pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.g").alias("ga"), F.col("y.g").alias("gb"))


def rest_pairs(post: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, orders: int, block: int = 1024) -> DataFrame:
    """Pairs of different groups that share a prefix member under every order.

    A pair is found at its first common member under the first order, once. From
    there on, no more can be common than members are left in either set, and the
    signatures must leave room for enough common members.

    A set is early in a list if enough members follow there for a partner of its
    own size. Of two sets that link, the smaller one is: so only early sets
    look for partners, and a list of none, as one of a common template, makes no
    pairs. A long list is cut in blocks by a hash, which meet in as many tasks.
    """
    prefixes = [*[f"p{k}" for k in range(orders)], "sign"]
    early = (F.col("_n") - F.col("_i")) * (100 + percent) >= 2 * percent * F.col("_n")
    own = post.join(labels, "key").withColumn("_early", early)
    lists = own.groupBy("t").agg(F.min("g").alias("_a"), F.max("g").alias("_b"), F.count_if("_early").alias("_f"), F.count(F.lit(1)).alias("_all")).where("_a != _b AND _f > 0")
    lists = lists.select("t", F.ceil(F.col("_f") / block).alias("_rows"), F.ceil(F.col("_all") / block).alias("_cols"))
    own = own.join(lists, "t").join(sets.select("key", *prefixes), "key")
    part = lambda n: F.pmod(F.xxhash64("key"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = own.where("_early").withColumn("_r", part(F.col("_rows"))).withColumn("_s", every(F.col("_cols")))
    right = own.withColumn("_s", part(F.col("_cols"))).withColumn("_r", every(F.col("_rows")))
    right = right.select("t", "_r", "_s", F.col("key").alias("_k"), F.col("_n").alias("_o"), F.col("g").alias("_g"), F.col("_i").alias("_j"), F.col("_early").alias("_too"), *[F.col(p).alias("_" + p) for p in prefixes])
    rest = F.least(F.col("_n") - F.col("_i"), F.col("_o") - F.col("_j"))
    enough = rest * (100 + percent) >= percent * (F.col("_n") + F.col("_o"))
    first = F.element_at(F.array_intersect("p0", "_p0"), 1) == F.col("l.t")
    shared = [F.arrays_overlap(p, "_" + p) for p in prefixes[1:orders]]
    # Two early sets find each other, which counts once.
    meets = (F.col("g") != F.col("_g")) & (~F.col("_too") | (F.col("key") < F.col("_k"))) & similar_sizes(percent) & enough
    # Each bit that only one set has stands for a member at least that the other lacks.
    lacks = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda n, x: n + x)
    most = F.least(F.col("_n") - lacks("sign", "_sign"), F.col("_o") - lacks("_sign", "sign"))
    close = most * (100 + percent) >= percent * (F.col("_n") + F.col("_o"))
    for c in [first, *shared, close]:
        meets = meets & c
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("t", "_r", "_s")]
    for c in same:
        meets = c & meets
    return left.alias("l").join(right.alias("r"), meets).select(F.col("key").alias("a"), F.col("_k").alias("b"), F.col("g").alias("ga"), F.col("_g").alias("gb"))


def contracted(labels: DataFrame, found: DataFrame) -> DataFrame:
    """The labels (key, g), where links between groups have made one of them.

    Only the groups' own links go through the rounds of components(): one node
    for each group, however large it is.
    """
    group = components(found.select(F.col("ga").alias("a"), F.col("gb").alias("b"))).withColumnRenamed("node", "g")
    return materialize(labels.join(group, "g", "left").select("key", F.coalesce("component", "g").alias("g")), "groups")


def link_groups(sets: DataFrame, percent: int, orders: int, rounds: int = 3) -> DataFrame:
    """(key, g) of the sets (key, n_shingles, members, p0, p1, ..., i0): g is the smallest key that links reach."""
    post = sets.select("key", F.col("n_shingles").alias("_n"), F.explode(F.arrays_zip("p0", "i0")).alias("x")).select("key", "_n", F.col("x.p0").alias("t"), F.col("x.i0").alias("_i"))
    labels = sets.select("key", F.col("key").alias("g"))
    for turn in range(rounds):
        found = materialize(verified(star_pairs(post.drop("_i"), labels, percent, turn), sets, percent, orders), "star-links")
        if found.isEmpty():
            break
        labels = contracted(labels, found)
    return contracted(labels, verified(rest_pairs(post, labels, sets, percent, orders), sets, percent, orders))


def ngram_join(docs: DataFrame, width: int = 4, percent: int = 85, orders: int = 2) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest
    identifier that links reach), kept (true for one row of each component, which
    has the smallest identifier) and text_sha256."""
    blocks = Blocks(docs)
    classes = blocks.answers(blocks.runs(shingle_runs(width)), frequency_classes, 1)
    schema = "key long, doc_id long, n_shingles long, text_sha256 string, print binary, members array<long>, i0 array<long>, sign array<long>" + "".join(f", p{k} array<long>" for k in range(orders))
    rows = materialize(blocks.finish(classes, sets_maker(width, percent, orders), schema), "sets")
    blocks.drop()
    live = rows.where("print IS NOT NULL")
    # Equal sets go on as one; a first sum over parts keeps a hot set out of one task.
    part = live.groupBy("print", F.pmod(F.xxhash64("key"), F.lit(64)).alias("_part")).agg(F.min("key").alias("rep"), F.min(F.struct("doc_id", "key")).alias("least"))
    reps = materialize(part.groupBy("print").agg(F.min("rep").alias("rep"), F.min("least").alias("least")), "reps")
    sets = materialize(live.join(reps.select(F.col("rep").alias("key")), "key", "left_semi"), "distinct-sets")
    group = link_groups(sets, percent, orders)
    named = reps.join(group.select(F.col("key").alias("rep"), F.col("g").alias("_g")), "rep")
    lowest = named.groupBy("_g").agg(F.min("least").alias("_best"))
    # Only sets of several rows, or in groups of several sets, need an answer.
    answer = named.join(lowest, "_g").select("print", "_best")
    salted = part.select("print", "_part").join(answer, "print")
    out = rows.select("key", "doc_id", "n_shingles", "text_sha256", "print", F.when(F.col("print").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(64))).alias("_part"))
    out = out.join(salted, ["print", "_part"], "left").withColumn("_c", F.coalesce("_best.doc_id", "doc_id"))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    kept = F.coalesce("_best.key", "key") == F.col("key")
    return out.select(back("doc_id").alias("doc_id"), "n_shingles", back("_c").alias("component_id"), kept.alias("kept"), "text_sha256")
