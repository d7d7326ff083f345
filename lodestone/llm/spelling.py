"""Spelling variant grouping.

Words are near if they differ by one inserted, deleted or replaced code point.
Of two near words one half of the shorter is whole in both: before the middle
if the error comes behind it, else after the middle. So words gather in groups,
one for each shared half, and each near pair meets in exactly one of them, by
the rightmost place that its error can have.

Spark shuffles the groups; a task takes them in buckets of BUCKET words or so.
A bucket's words go into a minimal acyclic automaton, forward for shared
beginnings, of the reversed words for shared ends. A word is looked up by
matching its half exactly and completing the rest with one error; what is
counted along the path is the number of the word found (perfect hashing), which
leads to its occurrences. No pair is found twice, so none has to be dropped.

A group beyond `limit` words is halved again: the part where the error may be
is cut at its middle, and what lies outside of the half with the error is shared.
A part of one code point is as small as groups get; they are bounded then by
the number of letters.

Defined results: a null text has no words, a null identifier counts as an empty
one; equal rows count each; runs of any length are words of that length; ties of
n go to the word that comes first in code-point order; an empty table gives no
rows; other columns of docs, whatever their names, are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, functions as F

from .common import materialize, whole_text

#: Maximal runs of these are words. A match of the shortest length or more takes the whole run.
LETTERS = r"[A-Za-zÀ-ÿ]"
BUCKET = 1 << 15
LIMIT = 1 << 17


class Automaton:
    """The minimal acyclic automaton of ascending distinct words. A word's number is its place among them."""

    def __init__(self, words):
        #: Of each state: letter -> (next state, words that come before those behind this letter), and whether a word ends here.
        self.next: list[dict] = []
        self.ends: list[bool] = []
        sizes: list[int] = []
        known: dict = {}

        def state(edges: dict, ends: bool) -> int:
            key = (ends, *edges.items())
            at = known.get(key)
            if at is None:
                at = known[key] = len(self.next)
                before, out = int(ends), {}
                for letter, to in edges.items():
                    out[letter] = (to, before)
                    before += sizes[to]
                self.next.append(out)
                self.ends.append(ends)
                sizes.append(before)
            return at

        # The states on the path of the last word may still grow, those behind are fixed.
        path, ends, last = [{}], [False], ""

        def fix(depth: int) -> None:
            for d in range(len(last), depth, -1):
                path[d - 1][last[d - 1]] = state(path[d], ends[d])
            del path[depth + 1 :], ends[depth + 1 :]

        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            fix(same)
            path += [{} for _ in range(len(word) - same)]
            ends += [False] * (len(word) - same)
            ends[-1], last = True, word
        fix(0)
        self.root = state(path[0], ends[0])

    def follow(self, at: int, number: int, rest: str) -> int:
        """The number of the word that goes on from a state with the rest, or -1."""
        for letter in rest:
            edge = self.next[at].get(letter)
            if edge is None:
                return -1
            at, number = edge[0], number + edge[1]
        return number if self.ends[at] else -1

    def near(self, word: str, first: int, last: int, backward: bool):
        """(number, longer) of the words that begin like `word` up to `first`, end like it from `last`, and have one error between.

        word itself is in the automaton. An inserted letter stands at the
        rightmost of its possible places, read from the word's own beginning;
        that place is first up to before last, or at the end if last is there.
        Backward, word and automaton are reversed, so the place is the leftmost
        one and lies behind first, up to last.
        """
        at, number, n = self.root, 0, len(word)
        for i in range(n + 1):
            edges = self.next[at]
            if i >= first:
                if i < last:
                    for letter, (to, before) in edges.items():
                        if letter != word[i] and (found := self.follow(to, number + before, word[i + 1 :])) >= 0:
                            yield found, False
                if first < i <= last if backward else i < last or i == n:
                    other = word[i - 1] if backward else word[i] if i < n else ""
                    for letter, (to, before) in edges.items():
                        if letter != other and (found := self.follow(to, number + before, word[i:])) >= 0:
                            yield found, True
            if i >= last:
                return
            edge = edges[word[i]]
            at, number = edge[0], number + edge[1]


def search(groups, backward: bool):
    """groups: (base, lo, ro, words with their n). Rows (word, n_near, near_n, near): the near words in these groups, the best one of each word."""
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    n_of = {turn(w): n for _, _, _, words in groups for w, n in words}
    words = sorted(n_of)
    automaton = Automaton(words)
    found: dict = {}

    def note(word, near):
        own = (-n_of[near], turn(near))
        had = found.get(word)
        found[word] = (1, own) if had is None else (had[0] + 1, min(had[1], own))

    for base, lo, ro, members in groups:
        first, last = (ro, base - lo) if backward else (lo, base - ro)
        for word in (turn(w) for w, _ in members if len(w) == base):
            for number, longer in automaton.near(word, first, last, backward):
                note(word, words[number])
                if longer:
                    note(words[number], word)
    return [(turn(w), count, -best[0], best[1]) for w, (count, best) in found.items()]


def searcher(batches):
    import pyarrow as pa

    names = ["word", "n_near", "near_n", "near"]

    def rows(groups, backward):
        columns = list(zip(*search(groups, backward))) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    held, size, now, backward = [], 0, None, False
    for batch in batches:
        for key in zip(*(batch.column(i).to_pylist() for i in range(6))):
            group, member = key[:4], key[4:]
            if group != now:
                turned = group[2] > group[1]
                if held and (size >= BUCKET or turned != backward):
                    yield rows(held, backward)
                    held, size = [], 0
                backward, now = turned, group
                held.append((*group[:3], []))
            held[-1][3].append(member)
            size += 1
    if held:
        yield rows(held, backward)


def words_of(docs: DataFrame, shortest: int, least: int, every: int) -> DataFrame:
    """word, n: the runs of letters, A-Z in lower case; of one run in `every`, by its and its document's hash, a letter is gone."""
    found = F.explode(F.regexp_extract_all(whole_text(), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))).alias("run")
    runs = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("lead"), found)
    runs = runs.select("lead", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("lead", "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")) if every else F.col("run")
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def shared(rows: DataFrame) -> DataFrame:
    """rows (base, lo, ro, word, n) with the key of their group: what is shared on the left and on the right."""
    key = F.concat(F.left("word", F.col("lo")), F.lit("|"), F.right("word", F.col("ro")))
    return rows.select("base", "lo", "ro", key.alias("key"), "word", "n")


def grouped(words: DataFrame, shortest: int, limit: int) -> DataFrame:
    """base, lo, ro, key, word, n: the groups of words of base letters and of one more that share their first lo and last ro."""
    length = F.length("word")
    half = lambda base: F.floor(base / 2).cast("int")
    struct = lambda base, lo, ro: F.struct(base.alias("base"), lo.alias("lo"), ro.alias("ro"))
    kinds = [struct(base, *ends) for base in (length, length - 1) for ends in ((half(base), F.lit(0)), (F.lit(0), base - half(base)))]
    rows = words.select("word", "n", F.explode(F.array(*kinds)).alias("g")).select("g.*", "word", "n").where(F.col("base") >= shortest)
    rows, done = shared(rows), None
    group = ["base", "lo", "ro", "key"]
    while True:
        part = F.col("base") - F.col("lo") - F.col("ro")
        hot = rows.groupBy(*group).count().where((F.col("count") > limit) & (part > 1)).select(*group)
        hot = materialize(hot, "hot")
        if hot.isEmpty():
            return rows if done is None else done.unionAll(rows)
        rest = rows.join(hot, group, "left_anti").select(rows.columns)
        done = rest if done is None else done.unionAll(rest)
        middle = half(part)
        behind = F.struct("base", (F.col("lo") + middle).alias("lo"), "ro")
        before = F.struct("base", "lo", (F.col("base") - F.col("lo") - middle).alias("ro"))
        rows = rows.join(hot, group).select(F.explode(F.array(behind, before)).alias("g"), "word", "n")
        rows = materialize(shared(rows.select("g.*", "word", "n")), "groups")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): where following forms ends. Each round doubles how far a word has been followed."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialize(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, ratio: int = 10, every: int = 31, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs (doc_id, text).

    shortest: code points of a word; least: its occurrences; ratio: how many
    times a word's own n its form's n is at least; every: see words_of (0: no
    letters go); limit: words of a group beyond which it is halved.
    """
    words = materialize(words_of(docs, shortest, least, every), "words")
    rows = grouped(words, shortest, limit)
    rows = rows.repartition("base", "lo", "ro", "key").sortWithinPartitions(F.col("ro") > F.col("lo"), "base", "lo", "ro", "key", "word")
    near = rows.mapInArrow(searcher, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    joined = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    joined = materialize(joined, "forms")
    ends = roots(joined.where("form is not null"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
