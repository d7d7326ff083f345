"""A semantic cache for a whole batch of questions, as if they came one after the other.

A question is a hit if an entry lies within `distance` of it: one that the cache
had before, or an earlier question of the batch that was no hit itself. Else it
becomes an entry. So entries are the greedy independent set, in order of
position, of the graph of near questions.

It is elected by prefixes that double. In a prefix only what no entry covers yet
is compared with itself: after the first questions have been decided, few of
the later ones have many near ones left. Inside a prefix, rounds decide all
questions at once that have no undecided earlier one near them. New entries then
take out what they cover of the rest. Equal vectors go as one, whatever their
number, so a group of copies makes no pairs. Last, each hit goes to its nearest
entry before it; entries are far from each other, so those are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..sources.tables import written
from .vector_index import build_index, within

FIRST = 1024


def near_pairs(queries: DataFrame, targets: DataFrame, distance: float) -> DataFrame:
    """position, entry, distance of queries and targets (position, vector) that are near."""
    index = build_index(targets.select(F.col("position").alias("vec_id"), F.col("vector").alias("embedding")))
    found = within(index, queries.select(F.col("position").alias("question_id"), F.col("vector").alias("query_vector")), distance)
    return found.select(F.col("question_id").alias("position"), F.col("vec_id").alias("entry"), "distance")


def first_of_all(open_: DataFrame, pairs: DataFrame) -> DataFrame:
    """position of the greedy independent set of open_ (position), in ascending order; pairs: position, entry (an earlier one that is near)."""
    chosen = None
    while True:
        pairs = written(pairs.select("position", "entry"), "pairs")
        blocked = pairs.select("position").distinct()
        now = written(open_.join(blocked, "position", "left_anti"), "chosen")
        chosen = now if chosen is None else chosen.unionByName(now)
        if pairs.isEmpty():
            return chosen
        # What the chosen ones are near to is decided; whatever is left waits for undecided ones only.
        covered = pairs.join(now.select(F.col("position").alias("entry")), "entry", "left_semi").select("position").distinct()
        open_ = written(open_.join(now, "position", "left_anti").join(covered, "position", "left_anti"), "open")
        left = open_.select("position")
        pairs = pairs.join(left, "position", "left_semi").join(left.select(F.col("position").alias("entry")), "entry", "left_semi")


def elect(questions: DataFrame, distance: float = 0.2, entries: DataFrame | None = None, first: int = FIRST) -> DataFrame:
    """question_id, hit (is it answered from the cache?), entry_id (the question or entry that answers it, itself if it becomes one), distance.

    questions: question_id, position (a distinct number from 0, the order of
    arrival), vector; entries: entry_id, vector, of before the batch. Squared
    distances. Questions without a vector are never hits and never entries:
    their entry_id is null. Of equally near entries the earlier one answers.
    """
    usable = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    asked = written(questions.select("question_id", F.col("position").cast("long").alias("position"), F.col("vector").cast("array<double>").alias("vector")), "asked")
    good = asked.where(usable)
    # Entries of before take the negative positions, in the order of their names.
    known = None
    if entries is not None:
        order = W.orderBy(F.desc("entry_id"))  # the cache's size, not the batch's
        known = written(entries.where(usable).select("entry_id", (-F.row_number().over(order)).cast("long").alias("position"), F.col("vector").cast("array<double>").alias("vector")), "known")
    same = written(good.groupBy("vector").agg(F.min("position").alias("position")), "same")
    open_, leaders = same, None
    if known is not None:
        open_ = written(open_.join(near_pairs(open_, known, distance).select("position").distinct(), "position", "left_anti"), "open")
    end = good.agg(F.max("position")).first()[0]
    upto = first
    while end is not None:
        part = written(open_.where(F.col("position") < upto), "prefix")
        pairs = near_pairs(part, part, distance).where("entry < position")
        new = written(part.join(first_of_all(part.select("position"), pairs), "position", "left_semi"), "leaders")
        leaders = new if leaders is None else leaders.unionByName(new)
        rest = open_.where(F.col("position") >= upto)
        if upto > end:
            break
        open_ = written(rest.join(near_pairs(rest, new, distance).select("position").distinct(), "position", "left_anti"), "open")
        upto *= 2
    if leaders is None:
        leaders = same.where("false")
    all_entries = leaders.select("position", "vector")
    if known is not None:
        all_entries = all_entries.unionByName(known.select("position", "vector"))
    all_entries = written(all_entries, "entries")
    # Each different vector with the entries near it; a copy looks at those before itself.
    around = near_pairs(same, all_entries, distance).withColumnRenamed("position", "copy_of")
    each = good.join(same.withColumnRenamed("position", "copy_of"), "vector").select("question_id", "position", "copy_of")
    best = each.join(around, "copy_of").where("entry <= position").groupBy("question_id", "position").agg(F.min(F.struct("distance", "entry")).alias("b"))
    named = good.select(F.col("position").alias("entry"), F.col("question_id").cast("string").alias("entry_id"))
    if known is not None:
        named = named.unionByName(known.select(F.col("position").alias("entry"), F.col("entry_id").cast("string").alias("entry_id")))
    rows = best.select("position", F.col("b.entry").alias("entry"), F.col("b.distance").alias("distance")).join(named, "entry")
    out = asked.select("question_id", "position").join(rows, "position", "left")
    is_entry = F.col("entry") == F.col("position")
    return out.select("question_id", F.coalesce(~is_entry, F.lit(False)).alias("hit"), "entry_id", F.when(~is_entry, F.col("distance")).alias("distance"))
