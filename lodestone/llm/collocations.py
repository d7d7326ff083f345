"""Phrase collocation mining.

All phrases of 1 to max_n words become rows, which are counted per language by
hash aggregation. A candidate is cut after each of its words in turn; the
counts of both parts come by joins, and the score floor(scale * a * a / (l * r))
is taken in decimals of 38 digits, so that products may pass 64 bits. Phrases
that a phrase of one word more explains are anti-joined away: a part occurs at
least as often as the whole, so one word at a time reaches every longer phrase.
The rank of a language's phrases is a window over what each of its shares has
ranked first.

A task explodes a batch of texts at a time and hands on a row for each of its
distinct phrases with their number there. Words and pairs are exploded first.
A longer phrase is exploded only where both phrases of one word less that it
holds may be common ones: a bitmap of BITS bits, whatever the input, has the
phrases of min_count and above. It never denies a common phrase, so nothing is
lost by it; on a corpus so large that it fills up, it merely saves less.

Defined results: a null text is empty and has no phrases; a null language is
`und`, as is the language called so; equal rows count each; a phrase never
crosses a piece, a line or a document; texts of any length are taken whole;
ties of score and count go to the phrase that comes first in the order of its
UTF-8 bytes; an empty table gives no rows; other columns of docs, whatever
their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialize, mix, scramble, whole_text
from .words import LOWER, words_of

#: What ends a piece, and what ends a word.
PIECE_END = np.zeros(256, bool)
PIECE_END[list(b".,;:!?\n\x0b\x0c\r")] = True
WORD_END = PIECE_END.copy()
WORD_END[list(b" \t")] = True
#: The bitmap of common phrases, 16 MB; a phrase sets two bits.
BITS = 1 << 27
#: Shares of a language that are ranked by themselves before the whole is: a share hands on no more rows than the report has.
SHARES = 64
#: Bytes of texts that a task explodes at a time.
STRETCH = 4 << 20


def hash_of(strings) -> np.ndarray:
    """64-bit hashes of an Arrow array of strings without white space."""
    off = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    body = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return words_of(body, (off - off[0]).astype(np.int64))[0]


def bits_of(h: np.ndarray) -> np.ndarray:
    """The two bits of each hash."""
    return np.stack([scramble(h, salt) & np.uint64(BITS - 1) for salt in (1, 2)])


def words_in(texts):
    """Of an Arrow array of texts: all words in turn as a dictionary array, and whether each word goes on the piece of the word before."""
    import pyarrow as pa

    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]]
    solid = ~WORD_END[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[off - off[0]] = True
    before = np.concatenate([[False], solid[:-1]])[: len(body)]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.cumsum(PIECE_END[body], dtype=np.int32)[start]
    text = np.searchsorted(off - off[0], start, "right")
    joined = np.zeros(len(start), bool)
    joined[1:] = (ends[1:] == ends[:-1]) & (text[1:] == text[:-1])
    kept, letters = np.cumsum(solid, dtype=np.int32), body[solid]
    places = np.append(kept[start] - 1, len(letters)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(letters))
    return words.dictionary_encode(), joined


def grams_of(texts, seed: np.uint64, sizes: range, common: np.ndarray | None):
    """(phrase, f) as Arrow arrays for the distinct phrases of these sizes. common: the bitmap that phrases of one word less must pass."""
    import pyarrow as pa
    import pyarrow.compute as pc

    coded, joined = words_in(texts)
    words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    word_hash = hash_of(words) if common is not None else None
    at = np.arange(len(code))
    # Phrases are numbered size by size: a phrase is the number of all but its last word, and that word.
    name, number = words, code
    for n in range(1, sizes[-1] + 1):
        if n > 1:
            at = at[at + n - 1 < len(code)]
            at = at[joined[at + n - 1] & alive[at]]  # noqa: F821
            if n >= sizes[0] and common is not None:
                at = at[passed[at] & passed[at + 1]]  # noqa: F821
            key, inverse = np.unique(number[at] * len(words) + code[at + n - 1], return_inverse=True)
            name = pc.binary_join_element_wise(name.take(pa.array(key // len(words))), words.take(pa.array(key % len(words))), " ")
            number = np.zeros(len(code), np.int64)
            number[at] = inverse
        alive = np.zeros(len(code) + 1, bool)
        alive[at] = True
        if common is not None and n == sizes[0] - 1:
            h = np.full(len(code), seed)
            for i in range(n):
                h[at] = mix(h[at], word_hash[code[at + i]])
            bit = bits_of(h)
            passed = np.append(alive[:-1] & np.all(common[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1, axis=0), False)
        if n >= sizes[0]:
            yield name, np.bincount(number[at], minlength=len(name)).astype(np.int64)


def stretches(texts):
    """The texts in turn, STRETCH bytes or one text at a time."""
    ends, at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + STRETCH, "right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def exploder(sizes: range, common):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        bits = None if common is None else np.frombuffer(common.value, np.uint8)
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch.column(1).filter(pc.equal(langs.indices, k))
                for texts in stretches(own):
                    for phrase, f in grams_of(texts, seed_of(lang), sizes, bits):
                        yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(phrase)), phrase, pa.array(f)], ["lang", "phrase", "f"])
                    pa.default_memory_pool().release_unused()

    return run


def seed_of(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def phrase_counts(docs: DataFrame, sizes: range, common=None) -> DataFrame:
    """lang, phrase, f of all phrases of these sizes in docs (lang, text)."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().alias("text"))
    return rows.mapInArrow(exploder(sizes, common), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def setter(batches):
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        seeds = np.array([seed_of(x) for x in langs.dictionary.to_pylist()], np.uint64)
        h = seeds[langs.indices.to_numpy()] if len(batch) else np.zeros(0, np.uint64)
        parts = pc.split_pattern(batch.column(1), " ")
        word_hash = hash_of(parts.flatten())
        first, counts = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py(), parts.value_lengths().to_numpy()
        for i in range(int(counts.max(initial=0))):
            own = np.flatnonzero(counts > i)
            h[own] = mix(h[own], word_hash[first[own] + i])
        yield pa.RecordBatch.from_arrays([pa.array(bits_of(h).ravel().astype(np.int64))], ["bit"])


def bitmap(found: DataFrame):
    """The bitmap of phrases (lang, phrase) as a broadcast of BITS / 8 bytes."""
    bits = found.select("lang", "phrase").mapInArrow(setter, "bit long")
    # Spark's bitmaps begin with 1.
    value = F.col("bit") + 1
    parts = bits.groupBy(F.bitmap_bucket_number(value).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits"))
    whole = bytearray(BITS // 8)
    for row in parts.toLocalIterator():
        end = row.part * len(row.bits)
        whole[end - len(row.bits) : end] = row.bits
    return found.sparkSession.sparkContext.broadcast(bytes(whole))


def words_to(phrase: str, n: Column) -> Column:
    """The first n words of a phrase, or the last -n."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), n.cast("int"))


def lowest_cuts(found: DataFrame, counts: DataFrame, scale: int) -> DataFrame:
    """found (lang, phrase, k, a) with l, r and score of its lowest-scoring cut; ties to the first."""
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", words_to("phrase", F.col("cut")).alias("head"), words_to("phrase", F.col("cut") - F.col("k")).alias("tail"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr(f"(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast({scale} as decimal(8,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    least = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("least")
    return cuts.groupBy("lang", "phrase", "k", "a").agg(least).select("lang", "phrase", "k", "a", "least.l", "least.r", "least.score")


def unexplained(found: DataFrame, percent: int) -> DataFrame:
    """found without the phrases that a candidate of one word more holds at least percent of the times."""
    longer = found.where("k > 2")
    drop_last, drop_first = words_to("phrase", F.col("k") - 1), words_to("phrase", 1 - F.col("k"))
    holds = longer.select("lang", F.explode(F.array(drop_last, drop_first)).alias("phrase"), F.col("a").alias("held"))
    holds = holds.groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    explained = (found.lang == holds.lang) & (found.phrase == holds.phrase) & (F.lit(100) * holds.held >= F.lit(percent) * found.a)
    return found.join(holds, explained, "left_anti")


def first_of_each(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    rows = rows.withColumn("share", share).withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order)))
    rows = rows.where(F.col("rank") <= top).drop("share", "rank")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, max_n: int = 3, min_count: int = 10, percent: int = 50, top: int = 2000, scale: int = 1_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the top phrases of 2 to max_n words of each language of docs (lang, text).

    min_count: occurrences of a candidate; percent: the share of a phrase's
    occurrences inside one longer candidate from which it is dropped.
    """
    if max_n < 2 or min_count < 1:
        raise ValueError("max_n is at least 2, min_count at least 1")
    is_common = F.col("f") >= min_count
    is_word = F.locate(" ", "phrase") == 0
    counts = materialize(phrase_counts(docs, range(1, 3)).where(is_common | is_word), "phrases")
    total = counts.where(is_word).groupBy("lang").agg(F.sum("f").alias("n"))
    common, last = counts.where(is_common), counts.where(is_common & ~is_word)
    for n in range(3, max_n + 1):
        last = materialize(phrase_counts(docs, range(n, n + 1), bitmap(last)).where(is_common), "phrases")
        common = common.unionAll(last)
    k = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1
    found = common.where(~is_word).select("lang", "phrase", k.alias("k"), F.col("f").alias("a"))
    scored = lowest_cuts(unexplained(found, percent), common, scale)
    ranked = first_of_each(scored, top).join(total, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
