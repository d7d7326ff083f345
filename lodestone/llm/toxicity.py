"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Obfuscated words are read as a noisy channel: each written character comes from
a letter (itself, or one that it looks like), from repetition of the letter
before, or from nothing (a separator inside a spaced word). Viterbi finds the
letters with the best product of channel and character trigram model, over all
states of the lattice. Only stretches whose shape can hide evidence are decoded,
from each place of a token of any length where the shape of evidence starts; a
decoded word takes the stretch's place, so that a restored text comes out. Words
start and end beside characters that are no letters; inside of other words an
obfuscated one is read if it is a whole word of evidence with five letters or
more. Repetition is collapsed before any shape is compared: a character that
stands more than four times in a row counts four times, and of neighbouring
characters that stand for one letter (as i, l, 1, ! and | do) the decoder sees
eight: no word has as many like letters in a row, so more are repetition, too.

Evidence: words of any length and beginnings of 4 to 8 letters that toxic
documents of the training rows have more often than the others. Either they are
in 3 toxic rows at least with log odds of rows of 4.5 or more, or in 8 with log
odds of rows of 1 and of occurrences of 2.5 or more (half a row or an occurrence
added to each count); none of these bounds depends on the number of rows. The
restored words of a document, each by its strongest evidence, are counted; with
n words in all, k of a kind of evidence and a rate r of it among the words of
clean rows, each kind with k > n r says k log(k / (n r)) - k + n r: how far the
count lies over what a clean text of that length has. The sum goes through a
logistic curve fitted on the same rows. Labels are learnt from all labelled rows
outside the held-out fold, of which only copies with the same label go: texts
with equal sets of words, and such as share 80 % of them. Scoring covers all rows
and whole texts.

Defined results: a null or empty text has no evidence and gets the curve's
value at 0; without training rows of both labels every score is 0; rows with
equal identifiers are scored separately; labels that are null or not 0 or 1
are not learnt from, and of contradicting labels the larger counts; very long
texts are read to their end; an empty table gives an empty result; further
columns, whatever their names, are not touched.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import C1, C2, crc_mod, drop_frame, materialize, mix, tidy, whole_text, wider

#: Letters that other characters are written for.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
LETTERS = re.compile(r"[^\W\d_]+")
SEPARATORS = " .-_*/"
#: Stretches of a token in which a word can hide: letters, look-alikes and separators.
PIECE = re.compile(rf"(?:[^\W\d_]|[{re.escape(''.join(LOOKS_LIKE) + SEPARATORS.strip())}])+")
#: Single characters, or repetitions of one, with separators or any white space between them.
LOOKS = re.escape("".join(c for c in LOOKS_LIKE if not c.isalnum()))
MARK = rf"(?!_)[\w{LOOKS}]"
BETWEEN = rf"[\s{re.escape(SEPARATORS)}]"
SPACED = re.compile(rf"(?<![^\W_])(?P<first>{MARK})(?P=first)*+(?:{BETWEEN}++(?P<mark>{MARK})(?P=mark)*+(?![{LOOKS}]*+[^\W_])){{3,}}")
#: Letters that a word needs to count inside another, where no mark sets it off.
INSIDE = 5
#: Letters of the beginnings of words that can be evidence.
BEGINNINGS = (4, 5, 6, 7, 8)
AGAIN = re.compile(r"(.)\1")
REPEATED = re.compile(r"(.)\1+", re.DOTALL)
SOLID = re.compile(r"\S+")
#: Log10 costs in the channel.
COST = {"same": 0.0, "look": -0.6, "again": -0.5, "nothing": -0.3}


def class_of(ch: str) -> str:
    return {"i": "1", "l": "1"}.get(ch, ch)


#: The class of every character in a skeleton: look-alikes fall together.
CLASS = {c: class_of(letters[0]) for c, letters in LOOKS_LIKE.items()} | {"i": "1", "l": "1"}


SHAPE = str.maketrans(CLASS | dict.fromkeys(SEPARATORS))


def skeleton(word: str) -> str:
    """Letters and look-alikes in classes, repetition and separators gone."""
    return REPEATED.sub(r"\1", "".join(word.translate(SHAPE).split()))


class Run:
    """Neighbouring characters of one class, as one character of a skeleton."""

    def __init__(self, kind: str, at: int):
        self.kind, self.at, self.end, self.written, self.opens, self.closes = kind, at, at, "", False, False

    def add(self, c: str, at: int, opens: bool) -> None:
        self.end = at + 1
        # More repetition than that is in no word, so the decoder needn't see it (see the module's text).
        if len(self.written) < 8 and not self.written.endswith(c * 4):
            self.written += c
        if opens and not self.opens:
            self.opens, self.at = True, at


def runs_of(stretch: str) -> list[Run]:
    """The runs of a stretch: where they are, whether a word can start or end there."""
    runs: list[Run] = []
    before = ""
    for at, c in enumerate(stretch):
        if runs and not c.isalpha():
            runs[-1].closes = True
        if c not in SEPARATORS and not c.isspace():
            kind = CLASS.get(c, c)
            if not runs or runs[-1].kind != kind:
                runs.append(Run(kind, at))
            runs[-1].add(c, at, not before.isalpha())
        before = c
    if runs:
        runs[-1].closes = True
    return runs


class Letters:
    """A character trigram model of words."""

    def __init__(self, counts: dict[str, int], trigrams: dict[str, int] | None = None):
        """counts: of words; trigrams: of more words' trigrams, with ^^ before a word and $ after it."""
        self.tri, self.bi = defaultdict(float), defaultdict(float)
        for x, n in (trigrams or {}).items():
            self.add(x, n)
        for word, n in counts.items():
            w = f"^^{word}$"
            for i in range(len(w) - 2):
                self.add(w[i : i + 3], n)
        self.kinds = max(30, len({c for x in self.tri for c in x}))

    def add(self, trigram: str, n: int) -> None:
        self.tri[trigram] += n
        self.bi[trigram[:2]] += n

    def log_p(self, state: str, c: str) -> float:
        return math.log10((self.tri.get(state + c, 0.0) + 0.02) / (self.bi.get(state, 0.0) + 0.02 * self.kinds))


def viterbi(written: str, model: Letters) -> str:
    """The likeliest letters behind the written characters."""
    paths = {("^^", ""): (0.0, "")}
    for c in written:
        found: dict = {}

        def offer(state, last, score, text):
            if (state, last) not in found or found[state, last][0] < score:
                found[state, last] = (score, text)

        for (state, last), (score, text) in paths.items():
            if c in SEPARATORS or c.isspace():
                offer(state, last, score + COST["nothing"], text)
                continue
            letters = LOOKS_LIKE.get(c, "")
            if c.isalpha():
                letters += c
            for x in letters:
                offer(state[1] + x, x, score + COST["same" if x == c else "look"] + model.log_p(state, x), text + x)
                if x == last:
                    offer(state, last, score + COST["again"], text)
            if not letters:
                offer(state, last, score + COST["look"], text)
        paths = found
    return max((score + model.log_p(state, "$"), text) for (state, _), (score, text) in paths.items())[1]


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return ["=" + word, *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def plain(word: str) -> bool:
    """Letters without repetition, which are read as they are."""
    return word.isalpha() and not AGAIN.search(word)


def surprise(n: int, found: dict[str, int], rates: dict[str, float]) -> float:
    """How far the counts of evidence lie over what n words of clean text have."""
    total = 0.0
    for f in sorted(found):
        k, usual = found[f], n * rates[f]
        if k > usual:
            total += k * math.log(k / usual) - k + usual
    return total


class Reader:
    """Restores texts, and finds evidence in what comes out."""

    def __init__(self, weights: dict[str, float], letters: dict[str, int], trigrams: dict[str, int] | None = None, memory: int = 150_000):
        """weights: how strong each kind of evidence is."""
        self.weights, self.model, self.memory = weights, Letters(letters, trigrams), memory
        self.known: dict[str, tuple] = {}
        self.texts: dict[str, str] = {}
        self.skeletons: dict[str, bool] = {skeleton(f.lstrip("=")): True for f in weights}
        self.least = min(map(len, self.skeletons), default=99)
        self.most = max(map(len, self.skeletons), default=0)
        self.heads = {x[: self.least] for x in self.skeletons}
        self.starts = {f.lstrip("=")[: BEGINNINGS[0]] for f in weights}

    def hides(self, s: str) -> bool:
        """Whether evidence can start anywhere in a skeleton."""
        n, heads = self.least, self.heads
        return any(s[i : i + n] in heads for i in range(len(s) - n + 1))

    def of_word(self, word: str) -> str | None:
        """The strongest evidence of a word, which speaks for its other beginnings too."""
        weights, best = self.weights, None
        if word[: BEGINNINGS[0]] not in self.starts:
            return None
        for f in features(word):
            if f in weights and (best is None or (weights[f], f) > (weights[best], best)):
                best = f
        return best

    def of_words(self, text: str) -> tuple[str, ...]:
        """The evidence of each word of a restored text that is any."""
        if text.isalpha():
            f = self.of_word(text)
            return (f,) if f else ()
        return tuple(f for f in map(self.of_word, LETTERS.findall(text)) if f)

    def token(self, token: str) -> str:
        """A token, which has no white space and is in lower case, restored."""
        if plain(token):
            return token
        return PIECE.sub(lambda m: m.group() if plain(m.group().strip(SEPARATORS)) else self.mended(m.group()), token)

    def mended(self, stretch: str, spaced: bool = False) -> str:
        """A stretch of any length with what is read from any of its places in its place; in a spaced one, words start and end anywhere."""
        if not self.hides(skeleton(stretch)):
            return stretch
        runs, out, done, k = runs_of(stretch), [], 0, 0
        shape = "".join(r.kind for r in runs)
        while k <= len(runs) - self.least:
            read = None
            if shape[k : k + self.least] in self.heads:
                ends = [n for n in range(self.least, min(self.most, len(runs) - k) + 1) if shape[k : k + n] in self.skeletons]
                read = self.read(stretch, runs[k : k + self.most + 1], ends, spaced) if ends else None
            if read:
                word, n = read
                out += [stretch[done : runs[k].at], " ", word, " "]
                done, k = runs[k + n - 1].end, k + n
            else:
                k += 1
        return "".join([*out, stretch[done:]])

    def read(self, stretch: str, runs: list[Run], ends: list[int], spaced: bool) -> tuple[str, int] | None:
        """The word with the strongest evidence that starts with the first run, and its number of runs; the ends are numbers of runs that can hold some."""
        at, opens = runs[0].at, spaced or runs[0].opens
        word = LETTERS.match(stretch, at)
        if opens and word and not spaced and self.of_word(word.group()):
            return None
        # Beginnings are read with what follows, up to where the word can end.
        over = next((n for n in range(ends[0], len(runs) + 1) if runs[n - 1].closes), len(runs))
        best = None
        for n in dict.fromkeys([*ends, over] if opens else ends):
            written = "".join(r.written for r in runs[:n])
            if plain(written) and not spaced and stretch.startswith(written, at):
                continue
            text = self.texts.get(written)
            if text is None:
                text = self.texts[written] = viterbi(written, self.model)
            found = []
            if spaced or opens and runs[n - 1].closes or len(text) >= INSIDE and not written.isalpha():
                found.append("=" + text)
            if opens and (spaced or n == over):
                found += features(text)[1:]
            for f in found:
                if f in self.weights and (best is None or (self.weights[f], f) > best[:2]):
                    best = (self.weights[f], f, text, n)
        return best and best[2:]

    def restored(self, text: str) -> str:
        """The text in lower case with its decoded stretches in their place."""
        text = text.lower()
        if not self.weights:
            return text
        return SOLID.sub(lambda m: self.token(m.group()), self.spaced(text))

    def spaced(self, text: str) -> str:
        """Spaced words read; what a separator could join is looked at only if there are enough marks in a row."""
        return SPACED.sub(lambda m: self.mended(m.group(), True), text)

    def evidence(self, text: str) -> tuple[int, dict[str, int]]:
        """The number of words, and the counts of evidence in the restored text."""
        text = text.lower()
        known, found = self.known, {}
        for memory in (known, self.texts):
            if len(memory) > self.memory:
                memory.clear()
        n = len(text.split())
        if self.weights:
            # Equal tokens are restored and read once.
            for token, k in Counter(self.spaced(text).split()).items():
                got = known.get(token)
                if got is None:
                    got = self.of_words(self.token(token))
                    if len(token) < 64:
                        known[token] = got
                for f in got:
                    found[f] = found.get(f, 0) + k
        return n, found


def feature_counts(wanted=None, most: int = 300_000):
    """(feature, n, words): the rows and occurrences of each feature of some rows (text), summed over a part of them.

    The empty feature counts all rows and words; "~" and three letters is a
    trigram, counted once for each word of each row. With a filter (see
    bits_of()), features that it denies are left out.
    """

    def run(batches):
        import pyarrow as pa
        import xxhash

        bits = None if wanted is None else np.frombuffer(wanted.value, np.uint8)
        seen, occurs, rows, all_of = Counter(), Counter(), Counter(), [0, 0]

        class Passing(dict):
            def __missing__(self, f: str) -> bool:
                at = xxhash.xxh64_intdigest(f.encode(), 42) % FILTER_BITS
                self[f] = found = bits is None or bool(bits[at >> 3] >> (at & 7) & 1)
                return found

        class Heads(dict):
            """The beginnings of words; a longer one has no more rows than a shorter one, so the first that fails ends them."""

            def __missing__(self, word: str) -> tuple[str, ...]:
                out = []
                for n in BEGINNINGS:
                    if len(word) < n or not passing[word[:n]]:
                        break
                    out.append(word[:n])
                self[word] = found = tuple(out)
                return found

        passing, heads = Passing(), Heads()

        def flushed():
            counts: dict[str, list[int]] = {f: [n, 0] for f, n in rows.items()}
            for word, k in occurs.items():
                for f in heads[word]:
                    counts[f][1] += k
                if (len(word) < BEGINNINGS[0] or heads[word]) and passing["=" + word]:
                    counts["=" + word] = [seen[word], k]
            by_number, trigrams = defaultdict(list), Counter()
            for word, n in seen.items():
                by_number[n].append(word)
            for n, words in by_number.items():
                line = "^^" + "$^^".join(words) + "$"
                for x, k in Counter(zip(line, line[1:], line[2:])).items():
                    if x[0] != "$" and x[1:] != ("$", "^"):
                        trigrams["~" + "".join(x)] += n * k
            counts |= {f: [n, 0] for f, n in trigrams.items()} | {"": list(all_of)}
            all_of[:] = 0, 0
            for memory in (seen, occurs, rows, passing, heads):
                memory.clear()
            return pa.RecordBatch.from_pydict({"feature": pa.array(list(counts), pa.string())} | {c: pa.array([v[i] for v in counts.values()], pa.int64()) for i, c in enumerate(("n", "words"))})

        for batch in batches:
            for text in batch.column("text").to_pylist():
                text = text.lower()
                words = LETTERS.findall(text)
                occurs.update(words)
                own = set(words)
                seen.update(own)
                rows.update(set(chain.from_iterable(map(heads.__getitem__, own))))
                all_of[0] += 1
                all_of[1] += len(text.split())
                if len(seen) + len(rows) > most:
                    yield flushed()
        if all_of[0]:
            yield flushed()

    return run


#: Bits of the filters that keep rows and features out of shuffles. They never deny what they were made of.
FILTER_BITS = 1 << 24


def bits_of(rows: DataFrame, name: str):
    """A filter of the strings in a column, for tasks: its size does not depend on the rows."""
    at = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
    found = rows.select(at.alias("at")).groupBy(F.shiftright("at", 3).alias("byte")).agg(F.expr("bit_or(shiftleft(1, CAST(at % 8 AS INT)))").alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    bits[found["byte"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return rows.sparkSession.sparkContext.broadcast(bits.tobytes())


def keeper(wanted):
    """The rows whose place _at passes a filter."""

    def run(batches):
        bits = np.frombuffer(wanted.value, np.uint8)
        import pyarrow as pa

        for batch in batches:
            at = batch.column("_at").to_numpy()
            yield batch.filter(pa.array(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)).drop_columns(["_at"])

    return run


def near(rows: DataFrame, name, wanted: DataFrame) -> DataFrame:
    """The rows whose value of the expression name is in the one column of wanted, and few others, without a shuffle."""
    bits = bits_of(wanted, wanted.columns[0])
    placed = rows.withColumn("_at", F.pmod(F.xxhash64(name), F.lit(FILTER_BITS)))
    return placed.mapInArrow(tidy(keeper(bits)), rows.schema)


def only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents whose identifier is in rows, and of few others, without a shuffle."""
    name = F.col("doc_id").cast("string")
    return near(docs.where("doc_id IS NOT NULL").select("doc_id", whole_text().alias("text")), name, rows.select(name.alias("name")))


def training_rows(docs: DataFrame, labels: DataFrame, folds: int) -> DataFrame:
    """(doc_id, text, toxic) of all labelled rows whose crc32 modulo folds is not 0, without copies."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(crc_mod("doc_id", folds) != 0)
    known = materialize(known, "labels")
    # What is short of the signatures meets the labels; a text moves once, if its row stays.
    signed = materialize(signatures(only(docs, known)), "signed")
    rows = materialize(short_of(signed).join(known, "doc_id"), "labelled")
    kept = materialize(distinct_rows(rows, signed), "kept")
    drop_frame(signed)
    return with_texts(only(docs, kept), kept)


def with_texts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the rows kept (doc_id, _hash, toxic); rows equal in identifier and text once."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash")).join(kept, ["doc_id", "_hash"])
    return materialize(rows.dropDuplicates(["doc_id", "_hash", "toxic"]).select("doc_id", "text", "toxic"), "training")


#: Bits of a sketch of a set of words: those that its words' hashes name are set.
SKETCH_BITS = 1024

#: Salts of the min-hashes, two for each band.
SALTS = np.array([(k * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1) for k in range(1, 17)], np.uint64)


def signer(bands: int):
    """Rows with, instead of the text, a digest of its set of words, 32-bit hashes of it, a sketch of these and a hash for each band of two min-hashes."""

    def run(batches):
        import hashlib

        import pyarrow as pa
        import xxhash

        for batch in batches:
            digests, sets, sketches, hashes = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = sorted(set(LETTERS.findall(text.lower())))
                digests.append(hashlib.sha256(" ".join(words).encode()).digest())
                h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))
                short = np.unique(h.astype(np.uint32))
                sets.append(short.view(np.int32))
                bits = np.zeros(SKETCH_BITS, bool)
                bits[short % SKETCH_BITS] = True
                sketches.append(np.packbits(bits).view(np.int64))
                if len(h):
                    t = (h[None, :] ^ SALTS[: 2 * bands, None]) * C2
                    t ^= t >> np.uint64(32)
                    t *= C1
                    t ^= t >> np.uint64(29)
                    least = t.min(1)
                    hashes.append(mix(least[0::2], least[1::2]).view(np.int64))
                else:
                    hashes.append(None)
            new = [pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))]
            batch = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "_set", "_words", "_sketch", "_bands"])

    return run


def signatures(rows: DataFrame, bands: int = 8) -> DataFrame:
    """The rows with signatures instead of their texts, and a number of each row."""
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    plain = StructType([f for f in rows.schema.fields if f.name != "text"])
    fields = [("_set", BinaryType()), ("_words", ArrayType(IntegerType())), ("_sketch", ArrayType(LongType())), ("_bands", ArrayType(LongType()))]
    schema = StructType([*plain.fields, *(StructField(n, t) for n, t in fields)])
    return rows.mapInArrow(tidy(signer(bands)), schema).withColumn("_id", F.monotonically_increasing_id())


def short_of(signed: DataFrame) -> DataFrame:
    """Written signatures with the number of words instead of words and sketches."""
    return signed.withColumn("_n", F.size("_words")).drop("_words", "_sketch")


def distinct_rows(rows: DataFrame, signed: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, _hash, toxic) of rows (short_of() signed, and toxic) without copies (see without_copies).

    Most rows that share a band are not alike. Their sizes tell of most of them,
    and the sketches of nearly all the rest: each bit that only one set has
    stands for a word at least that the other lacks. Only the words of rows that
    neither tells apart move.
    """
    key = F.struct("doc_id", "_id", "_n")
    first = rows.groupBy("toxic", "_set").agg(F.min(F.struct("doc_id", "_id", "_hash")).alias("_row")).select("toxic", "_row.*")
    one = rows.select("toxic", "_id", key.alias("_key"), "_bands").where("_bands IS NOT NULL").join(first.select("_id"), "_id", "left_semi")
    hashes = one.select("toxic", "_key", F.posexplode("_bands").alias("_band", "_hash"))
    least = hashes.groupBy("toxic", "_band", "_hash").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_all")).where("_all > 1").drop("_all")
    pairs = hashes.join(least, ["toxic", "_band", "_hash"]).where("_key != _first").select("_key._id", "_key._n", F.col("_first._id").alias("_first"), F.col("_first._n").alias("_o"))
    pairs = pairs.where(100 * F.least("_n", "_o") >= percent * F.greatest("_n", "_o")).distinct()
    other = lambda c, name: signed.select(F.col("_id").alias("_first"), F.col(c).alias(name))
    lacks = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda n, x: n + x)
    most = F.least(F.col("_n") - lacks("_sketch", "_other"), F.col("_o") - lacks("_other", "_sketch"))
    close = pairs.join(signed.select("_id", "_sketch"), "_id").join(other("_sketch", "_other"), "_first").where(most * (100 + percent) >= percent * (F.col("_n") + F.col("_o")))
    close = materialize(close.select("_id", "_first"), "close")
    sets = near(signed.select("_id", "_words"), "_id", close.select("_id").unionByName(close.select(F.col("_first").alias("_id"))))
    both = F.size(F.array_intersect("_words", "_others"))
    alike = close.join(sets, "_id").join(sets.select(F.col("_id").alias("_first"), F.col("_words").alias("_others")), "_first").where(100 * both >= percent * (F.size("_words") + F.size("_others") - both))
    return first.join(alike.select("_id"), "_id", "left_anti").select("doc_id", "_hash", "toxic")


def without_copies(rows: DataFrame, percent: int = 80, bands: int = 8) -> DataFrame:
    """The rows (doc_id, text, toxic) without copies of others with the same label.

    Of texts with equal sets of words the smallest doc_id stays. Of the rest, a row
    goes if its set has a Jaccard similarity of percent/100, which is computed, to
    that of a row with a smaller doc_id. Candidates share two min-hashes of a band:
    each row is held against the smallest of each of its bands' groups, so that a
    group of thousands of near copies makes no more pairs than rows and bands.
    """
    signed = materialize(signatures(rows.select("doc_id", "text", "toxic"), bands), "signed")
    return with_texts(rows.select("doc_id", "text"), distinct_rows(short_of(signed), signed, percent))


def evidence_of(docs: DataFrame, labels: DataFrame, folds: int = 5, least_count: int = 3, least_odds: float = 4.5, often: tuple[int, float, float] = (8, 1.0, 2.5)) -> tuple[dict, DataFrame]:
    """The model without its curve (weights and clean rates of evidence, counts for the letters), and the training rows.

    Evidence is in least_count toxic rows or more with smoothed log odds of
    least_odds, or in often[0] with log odds of often[1] by rows and often[2] by
    occurrences. Features of fewer toxic rows can't be any, so clean rows count
    only the others, and those that a filter of them lets through.
    """
    # Near copies would make every word of theirs look like evidence.
    rows = training_rows(docs, labels, folds)
    count = lambda toxic, wanted=None: rows.where(F.col("toxic") == toxic).select("text").mapInArrow(tidy(feature_counts(wanted)), "feature string, n long, words long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    toxic = materialize(count(1), "toxic-features").selectExpr("feature", "n AS toxic", "words AS toxic_words")
    enough = toxic.where((F.col("toxic") >= min(least_count, often[0])) | (F.col("feature") == "") | F.startswith("feature", F.lit("~")))
    clean = count(0, bits_of(enough.where(~F.startswith("feature", F.lit("~"))), "feature")).selectExpr("feature", "n AS clean", "words AS clean_words")
    clean = materialize(clean, "clean-features")
    counts = materialize(enough.join(clean, "feature", "left").fillna(0).unionByName(clean.where("feature LIKE '~%'").join(enough, "feature", "left_anti").withColumns({"toxic": F.lit(0).cast("long"), "toxic_words": F.lit(0).cast("long")})), "features")
    total = counts.where("feature = ''").first()
    if not total or not total["toxic"] or not total["clean"]:
        return {"weights": {}, "rates": {}, "letters": {}, "slope": 0.0, "base": -math.inf}, rows
    share = lambda c: F.log((F.col(c) + 0.5) / (total[c] + 1.0))
    odds = counts.where("feature != '' AND feature NOT LIKE '~%'").withColumn("by_rows", share("toxic") - share("clean")).withColumn("w", share("toxic_words") - share("clean_words"))
    strong = (F.col("toxic") >= least_count) & (F.col("by_rows") >= least_odds)
    frequent = (F.col("toxic") >= often[0]) & (F.col("by_rows") >= often[1]) & (F.col("w") >= often[2])
    found = odds.where(strong | frequent).orderBy("feature").collect()
    weights = specific({r["feature"]: (r["w"], r["toxic"]) for r in found})
    rates = {r["feature"]: (r["clean_words"] + 0.5) / (total["clean_words"] + 1.0) for r in found if r["feature"] in weights}
    # The letters' model counts all words; those of the evidence weigh as the most frequent
    # one of toxic rows: an obfuscated word is rather one of these.
    n = F.col("toxic") + F.col("clean")
    trigrams = {r["x"]: r["n"] for r in counts.where("feature LIKE '~%'").select(F.substr("feature", F.lit(2)).alias("x"), n.alias("n")).orderBy("x").collect()}
    heavy = counts.where("feature LIKE '=%'").agg(F.max(n).alias("n")).first()["n"] or 1
    letters = {f.lstrip("="): heavy for f in weights}
    return {"weights": weights, "rates": rates, "letters": letters, "trigrams": trigrams}, rows


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, **bounds) -> dict:
    """The model: what evidence_of() finds, and the curve."""
    model, rows = evidence_of(docs, labels, folds, **bounds)
    if "base" in model:
        return model
    return with_curve(model, rows.select("text", "toxic").mapInArrow(tidy(sum_maker(model)), "s double, toxic int"))


def with_curve(model: dict, sums: DataFrame) -> dict:
    seen = sums.groupBy("s", "toxic").count().collect()
    return model | curve([(r["s"], r["toxic"], r["count"]) for r in seen])


def learn_and_score(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """What score() returns with the model of learn(); every text is read once, and the curve is fitted on what came out."""
    model, rows = evidence_of(docs, labels, folds)
    if "base" in model:
        return score(docs, model)
    read = docs.select("doc_id", whole_text().alias("text"))
    schema = wider(read, ("s", DoubleType()), ("evidence", ArrayType(StringType())))
    sums = read.mapInArrow(tidy(scorer(model | {"slope": 1.0, "base": 0.0}, 1, False, True)), schema)
    sums = materialize(sums.select("doc_id", F.xxhash64("text").alias("_hash"), "s", "evidence"), "sums")
    learnt = sums.select("doc_id", "_hash", F.round("s", 2).alias("s")).distinct().join(rows.select("doc_id", F.xxhash64("text").alias("_hash"), "toxic"), ["doc_id", "_hash"])
    model = with_curve(model, learnt.select("s", "toxic"))
    return sums.select("doc_id", (1 / (1 + F.exp(-(F.col("s") * model["slope"] + model["base"])))).alias("score"), "evidence")


def specific(found: dict[str, tuple[float, int]], share: float = 0.9) -> dict[str, float]:
    """A beginning goes if one longer form of it accounts for nearly all of its toxic documents."""
    toxic = {f: n for f, (_, n) in found.items()}
    longer: dict[str, int] = defaultdict(int)
    for f, n in toxic.items():
        bare = f.lstrip("=")
        for k in range(4, len(bare) + (f[0] == "=")):
            longer[bare[:k]] = max(longer[bare[:k]], n)
    return {f: w for f, (w, n) in found.items() if f[0] == "=" or longer[f] < share * n}


def sum_maker(model):
    def run(batches):
        import pyarrow as pa

        reader = Reader(model["weights"], model["letters"], model.get("trigrams"))
        for batch in batches:
            sums = [round(surprise(*reader.evidence(x), model["rates"]), 2) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"s": pa.array(sums, pa.float64()), "toxic": batch.column("toxic").cast(pa.int32())})

    return run


def curve(rows: list[tuple[float, int, int]]) -> dict:
    """Slope and base of a logistic curve, by Newton's method with a small penalty."""
    x, y, n = (np.array(v, float) for v in zip(*rows))
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(n * (y - p) * x).sum() - 0.1 * a, (n * (y - p)).sum() - 0.01 * b])
        v = n * p * (1 - p) + 1e-9
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -2, 2)
    return {"slope": float(a), "base": float(b)}


def scorer(model, text_at: int, reject: bool, bare: bool = False):
    def run(batches):
        import pyarrow as pa

        reader = Reader(model["weights"], model["letters"], model.get("trigrams"))
        for batch in batches:
            scores, evidence = [], []
            texts = batch.column(text_at)
            for i in range(len(texts)):
                n, found = reader.evidence(texts[i].as_py() or "")
                s = model["slope"] * surprise(n, found, model["rates"]) + model["base"]
                scores.append(s if bare else 1 / (1 + math.exp(-s)) if s > -700 else 0.0)
                evidence.append(sorted(found))
            if reject:
                yield batch.filter(pa.array([s < 0.5 for s in scores], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.string()))], [*batch.schema.names, "score", "evidence"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, evidence (the words and beginnings that were found, as restored)."""
    rows = docs.select("doc_id", "text")
    schema = wider(rows, ("score", DoubleType()), ("evidence", ArrayType(StringType())))
    return rows.mapInArrow(tidy(scorer(model, 1, False)), schema).drop("text")


def without_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, all columns, whose score is under 0.5."""
    return docs.mapInArrow(tidy(scorer(model, docs.columns.index("text"), True)), docs.schema)
