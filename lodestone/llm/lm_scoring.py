"""LM scoring with an Elias-Fano n-gram trie.

A model with absolute discounting over all training documents, of words in
contexts of up to `order` - 1 words:
p(w | h) = max(c(h w) - D, 0) / c(h) + D n(h) / c(h) * p(w | h'), where n(h) is
the number of different successors of h, and h' is h without its first word;
p(w) = (c(w) + 1) / (N + V + 1), with one unknown word in the place of all
others. An unknown h leaves p(w | h'). A text's start is one more word before
its first, with which contexts end.

The trie is cut by the hash of a context's first word: so a shard has all that
begins with a word, and a level's contexts are the entries of the level above.
Blocks of documents send each shard their words and, level by level, the
successors in the order of the contexts, with their counts in training
documents; the shard merges them, builds its levels (see elias_fano), and looks
up what each block asked for. So the model is never in one place, and what is
gathered grows with the corpus. A word that every document has is one entry for
each block.

Words are told apart by 64-bit hashes, successors inside a context by 40 bits.

Defined results: a null text is empty and has the end token only; a null
identifier is in training; rows with equal identifiers are separate documents;
with no training documents every token has the probability 1 / (0 + 0 + 1);
very long texts are scored whole; an empty table gives an empty result; other
columns, whatever their names, are not touched.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .blocks import Blocks, pack, shard_slices, unpack
from .common import NULL_ID, drop_frame, materialize
from .elias_fano import SUCCESSOR_BITS, Level, floor_of, quantise, restore
from .words import words_of

#: Hashes that stand for the start and the end of a text.
START, END = np.uint64(0x0F0F_1234_0000_0001), np.uint64(0xF0F0_4321_0000_0002)
DISCOUNT = 0.75
LOW = np.uint64((1 << SUCCESSOR_BITS) - 1)


def trained_on(ids: np.ndarray, folds: int, held: int) -> np.ndarray:
    import zlib

    return np.fromiter((i == NULL_ID or zlib.crc32(b"%d" % i) % folds != held for i in ids.tolist()), bool, len(ids))


def grams(ids, off, body, shards, folds, held):
    """Tokens of a block as numbers of its distinct words, which are sorted by shard.

    Returns words, their shards, tokens, documents of tokens, places of tokens in
    their documents, contexts of tokens, which documents train.
    """
    words, counts = words_of(body, off)
    n = len(counts)
    lens = counts + 1
    distinct, which = np.unique(np.concatenate([words, [START, END]]), return_inverse=True)
    shard = ((distinct >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    which = place[which]
    start, end = which[-2:]
    token = np.full(int(lens.sum()), end, np.int64)
    last = np.cumsum(lens) - 1
    inner = np.ones(len(token), bool)
    inner[last] = False
    token[inner] = which[:-2]
    context = np.empty(len(token), np.int64)
    context[1:] = token[:-1]
    context[last - counts] = start
    at = np.arange(len(token)) - np.repeat(last - counts, lens)
    return distinct[order], shard[order], token, np.repeat(np.arange(n), lens), at, context, trained_on(ids, folds, held)


class Grams(NamedTuple):
    """A level of a block's grams: where they end, the parent of each (its entry in the level above), the entry of each;
    of the entries, which are sorted by parent, the last word, and where each parent's begin."""

    ends: np.ndarray
    parent: np.ndarray
    entry: np.ndarray
    last: np.ndarray
    first: np.ndarray


def gram_levels(n: int, token, at, context, order: int) -> list[Grams]:
    """The grams of two words, of three, and so on; n: the block's distinct words."""
    levels, ends, parent, parents = [], np.arange(len(token)), context, n
    for size in range(2, order + 1):
        if levels:
            above = np.full(len(token), -1)
            above[ends] = levels[-1].entry
            # A gram's parent ends a token earlier; grams of this size end size - 2 tokens after a text's first.
            ends = np.flatnonzero(at >= size - 2)
            parent, parents = above[ends - 1], len(levels[-1].last)
        key, entry = np.unique(parent * n + token[ends], return_inverse=True)
        first = np.concatenate([[0], np.cumsum(np.bincount(key // n, minlength=parents))]).astype(np.int64)
        levels.append(Grams(ends, parent, entry, key % n, first))
    return levels


def gram_runs(folds: int, held: int, order: int):
    def make(ids, off, body, shards):
        words, shard, token, doc, at, context, train = grams(ids, off, body, shards, folds, held)
        n, weight = len(words), train[doc]
        count = np.bincount(token, weight, n).astype(np.uint32)
        levels = gram_levels(n, token, at, context, order)
        lows = words.view(np.uint8).reshape(-1, 8)[:, : SUCCESSOR_BITS // 8]
        times = [np.bincount(x.entry, weight[x.ends], len(x.last)).astype(np.uint32) for x in levels]
        per = [np.diff(x.first).astype(np.uint32) for x in levels]
        for s, a, b in shard_slices(shard):
            sizes, low, counts = [b - a], [], [count[a:b]]
            p, q = a, b
            for k, x in enumerate(levels):
                own = slice(p, q)
                p, q = x.first[p], x.first[q]
                sizes.append(q - p)
                low.append(lows[x.last[p:q]].tobytes())
                counts += [per[k][own], times[k][p:q]]
            yield s, np.array(sizes, np.int64).tobytes() + words[a:b].tobytes() + b"".join(low) + pack(np.concatenate(counts))

    return make


def parsed(x: bytes, order: int):
    """A run's words, their counts, and for each level: successors of each parent (how many), successors, their counts."""
    sizes = np.frombuffer(x, np.int64, order).tolist()
    at = 8 * order
    words = np.frombuffer(x, np.uint64, sizes[0], at)
    at += 8 * sizes[0]
    lows = []
    for m in sizes[1:]:
        low = np.zeros((m, 8), np.uint8)
        low[:, :5] = np.frombuffer(x, np.uint8, 5 * m, at).reshape(m, 5)
        lows.append(low.reshape(-1).view(np.uint64))
        at += 5 * m
    counts = np.frombuffer(unpack(x[at:]), np.uint32)
    parts = np.split(counts, np.cumsum([sizes[0], *[c for pair in zip(sizes, sizes[1:]) for c in pair]])[:-1])
    return words, parts[0], list(zip(parts[1::2], lows, parts[2::2]))


def answerer(order: int):
    def trie_answers(bodies: list[bytes]) -> list[bytes]:
        """For each block: counts of its words, then level by level the floor, codes of the contexts' back-off weights and of
        the successors. Last: "N,V" of the shard."""
        asked = [parsed(x, order) for x in bodies]
        words, which = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
        count = np.bincount(which, np.concatenate([x[1] for x in asked]), len(words)).astype(np.int64)
        parts, parents = np.split(which, np.cumsum([len(x[0]) for x in asked])[:-1]), len(words)
        said = [[count[w].astype(np.uint32).tobytes()] for w in parts]
        for k in range(order - 1):
            if parents >> (63 - SUCCESSOR_BITS):
                raise OverflowError(f"{parents} contexts in a shard; more shards are needed")
            keys = [(np.repeat(w, x[2][k][0]).astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | x[2][k][1] for w, x in zip(parts, asked)]
            entry, at = np.unique(np.concatenate(keys), return_inverse=True)
            times = np.bincount(at, np.concatenate([x[2][k][2] for x in asked]), len(entry)).astype(np.int64)
            seen = times > 0
            found_in, times = entry[seen], times[seen]
            context = (found_in >> np.uint64(SUCCESSOR_BITS)).astype(np.int64)
            total = np.bincount(context, times, parents)
            kinds = np.bincount(context, minlength=parents)
            found = (times - DISCOUNT) / total[context]
            backoff = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            floor = floor_of(found, backoff)
            level = Level.mapped(Level.build(context, found_in & LOW, parents, found, floor))
            weights = quantise(backoff, floor)
            for told, w, own in zip(said, parts, keys):
                told += [np.float64(floor).tobytes(), weights[w].tobytes(), level.look_up(own >> np.uint64(SUCCESSOR_BITS), own & LOW).tobytes()]
            parts, parents = np.split(at, np.cumsum([len(x) for x in keys])[:-1]), len(entry)
        tokens = words != START
        return [*[pack(b"".join(x)) for x in said], b"%d,%d" % (int(count[tokens].sum()), int((count[tokens] > 0).sum()))]

    return trie_answers


def scores_maker(folds: int, held: int, order: int, n_train: int, n_words: int):
    def make(block, ids, off, body, said, shards):
        words, shard, token, doc, places, context, train = grams(ids, off, body, shards, folds, held)
        levels = gram_levels(len(words), token, places, context, order)
        count = np.zeros(len(words), np.int64)
        weight = [np.zeros(len(x.first) - 1) for x in levels]
        found = [np.zeros(len(x.last)) for x in levels]
        for s, a, b in shard_slices(shard):
            raw, at = unpack(said[1][s]), 4 * (b - a)
            count[a:b] = np.frombuffer(raw, np.uint32, b - a)
            p, q = a, b
            for x, w, f in zip(levels, weight, found):
                floor = float(np.frombuffer(raw, np.float64, 1, at)[0])
                w[p:q] = restore(np.frombuffer(raw, np.uint8, q - p, at + 8), floor)
                at += 8 + int(q - p)
                p, q = x.first[p], x.first[q]
                f[p:q] = restore(np.frombuffer(raw, np.uint8, q - p, at), floor)
                at += int(q - p)
        alone = (count + 1) / (n_train + n_words + 1)
        p = alone[token]
        for x, w, f in zip(levels, weight, found):
            p[x.ends] = f[x.entry] + w[x.parent] * p[x.ends]
        n = len(ids)
        total = lambda x: np.bincount(doc, x, n)
        return {
            "doc_id": ids,
            "held_out": ~train,
            "n_tokens": np.bincount(doc, minlength=n),
            "n_known": total(count[token] > 0).astype(np.int64),
            "train_tokens": np.full(n, n_train, np.int64),
            "base_score": total(np.log10(alone)[token]),
            "score": total(np.log10(np.minimum(p, 1.0))),
        }

    return make


def lm_score(docs: DataFrame, folds: int = 7, held: int = 2, order: int = 2) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. order: words of the longest grams, 2 at least."""
    blocks = Blocks(docs)
    answers = materialize(blocks.answers(blocks.runs(gram_runs(folds, held, order)), answerer(order), 1), "trie")
    sums = answers.where("block = -1").select(F.split(F.col("body").cast("string"), ",").alias("x"))
    n, v = sums.agg(F.sum(F.col("x")[0].cast("long")), F.sum(F.col("x")[1].cast("long"))).first()
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rows = materialize(blocks.finish(answers.where("block >= 0"), scores_maker(folds, held, order, n or 0, v or 0), schema), "scores")
    blocks.drop()
    drop_frame(answers)
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
