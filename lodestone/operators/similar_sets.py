"""The most similar others of each small set of terms, by Jaccard similarity.

Two sets of n and m terms that are similar by t share at least `need(n, m, t)`
of them, so both have their rarest common one among their first n - need + 1
and m - need + 1, rarest first. Sets meet only at such terms, only with sizes
that can be similar enough, and only at terms that no more than OFTEN sets have.

What is left are pairs whose common terms are all more frequent. These terms of
a set have few subsets, and each subset is a bucket, of which each size keeps
the first top + 1 sets. That loses nothing: of a pair look at the bucket of
all its common terms. If the bucket keeps top + 1 sets before the partner, all
of its size, at least `top` of them are others than the source, share as much
or more with it and have smaller keys, so the partner is not among its best.

The threshold falls in rounds. A set that has found enough others above it
stops looking, since all that are left are less similar than its last one: for
it the bounds on prefixes and sizes have risen to its k-th best. Equal sets are
one set with its first members, so copies are never paired with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.tables import written

#: Thresholds before the last one, which the caller gives.
STEPS = (0.6, 0.35)
#: Sets with a common term meet pair by pair if no more than so many have it.
OFTEN = 256
#: Terms of a set at most, as its subsets are listed.
LARGEST = 16


def need(n, m, least: float) -> Column:
    """The fewest common terms with which sets of n and m terms can be similar by `least`."""
    return F.greatest(F.ceil((F.col(n) + F.col(m)) * least / (1 + least) - 1e-9), F.lit(1))


def distinct_sets(rows: DataFrame, within: list[str], key: str, terms: str, top: int, often: int = OFTEN) -> tuple[DataFrame, DataFrame]:
    """(members: within, key, id; sets: within, id, n, terms rarest first, rare: how many of them no more than `often` sets have, first: the first top + 1 keys of the set)."""
    own = F.array_sort(F.array_distinct(F.filter(terms, lambda x: x.isNotNull())))
    own = F.when(F.size(own) > LARGEST, F.raise_error(F.lit(f"a set has more than {LARGEST} terms"))).otherwise(own)
    told = written(rows.select(*within, F.col(key).alias("_key"), own.alias("_set")).where((F.size("_set") > 0) & F.col("_key").isNotNull()), "told")
    order = W.partitionBy(*within, "_set").orderBy("_key")
    first = told.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top + 1)
    first = first.groupBy(*within, "_set").agg(F.array_sort(F.collect_list("_key")).alias("first"))
    plain = written(first.withColumn("id", F.get("first", F.lit(0))), "plain")
    each = plain.select(*within, "id", F.explode("_set").alias("_t"))
    common = each.groupBy(*within, "_t").agg(F.count(F.lit(1)).alias("_f"))
    ordered = each.join(common, [*within, "_t"]).groupBy(*within, "id").agg(F.array_sort(F.collect_list(F.struct("_f", "_t"))).alias("_o"))
    sets = plain.join(ordered, [*within, "id"]).select(*within, "id", F.size("_set").alias("n"), F.transform("_o", lambda x: x["_t"]).alias("terms"), F.size(F.filter("_o", lambda x: x["_f"] <= often)).alias("rare"), "first")
    return told.join(plain.select(*within, "_set", "id"), [*within, "_set"]).drop("_set"), written(sets, "sets")


def meetings(sources: DataFrame, sets: DataFrame, within: list[str], least: float) -> DataFrame:
    """Rows where a source and another set share a rare term in both prefixes: within, a, b, n, m, mine, theirs, t, first."""
    sizes = sets.select(*within, F.col("n").alias("m")).distinct()
    fits = (F.col("m") >= F.col("n") * least - 1e-9) & (F.col("n") >= F.col("m") * least - 1e-9)
    length = F.least(F.greatest(F.col("n") - need("n", "m", least) + 1, F.lit(0)), F.col("rare")).cast("int")
    prefix = lambda rows: rows.join(sizes, within).where(fits).withColumn("t", F.explode(F.slice("terms", F.lit(1), length)))
    one = prefix(sources).select(*within, F.col("id").alias("a"), "n", "m", F.col("terms").alias("mine"), "t")
    two = prefix(sets).select(*within, F.col("id").alias("b"), F.col("n").alias("m"), F.col("m").alias("n"), F.col("terms").alias("theirs"), "first", "t")
    return one.join(two, [*within, "t", "n", "m"]).where("a != b")


def bucket_rows(sets: DataFrame, least: float) -> DataFrame:
    """Adds s: each subset of a set's frequent terms, in their order, that is large enough for some partner."""
    often = F.slice("terms", F.col("rare") + 1, F.size("terms"))
    enough = F.ceil(F.col("n") * least - 1e-9)
    rows = sets.withColumn("_often", often).where(F.size("_often") >= F.greatest(enough, F.lit(1)))
    rows = rows.withColumn("_mask", F.explode(F.sequence(F.lit(1), F.expr("shiftleft(1, size(_often)) - 1"))))
    rows = rows.where(F.bit_count("_mask") >= enough)
    return rows.withColumn("s", F.expr("filter(_often, (x, i) -> (shiftright(_mask, i) & 1) = 1)")).drop("_mask", "_often")


def bucketed(sources: DataFrame, sets: DataFrame, within: list[str], least: float, top: int) -> DataFrame:
    """Pairs whose common terms are all frequent and one bucket, as meetings() has them: within, a, b, n, m, mine, theirs, first."""
    order = W.partitionBy(*within, "s", "n").orderBy("id")
    kept = bucket_rows(sets, least).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top + 1)
    two = kept.select(*within, "s", F.col("id").alias("b"), F.col("n").alias("m"), F.col("terms").alias("theirs"), "first")
    one = bucket_rows(sources, least).select(*within, "s", F.col("id").alias("a"), "n", F.col("terms").alias("mine"))
    return one.join(two, [*within, "s"]).where((F.col("a") != F.col("b")) & (F.array_intersect("mine", "theirs") == F.col("s"))).drop("s")


def most_similar(rows: DataFrame, within: list[str], key: str, terms: str, least: float, top: int, often: int = OFTEN) -> DataFrame:
    """within, source, target, similarity: of each row's others with the same `within` the `top` most similar, at least `least` (above 0); ties to the smallest key.

    `key` tells the rows of a `within` apart. Null terms and repeated ones do
    not count; a row without terms, or with a null key or `within`, has no others. A set of more than LARGEST terms is an error.
    """
    members, sets = distinct_sets(rows, within, key, terms, top, often)
    sources, lists = sets, None
    for level in [s for s in STEPS if s > least] + [least]:
        # A pair is made once: at its rarest common term, or in the bucket of all its common terms.
        shared = F.array_intersect("mine", "theirs")
        met = meetings(sources, sets, within, level).where(F.get(shared, F.lit(0)) == F.col("t")).drop("t")
        pairs = met.unionByName(bucketed(sources, sets, within, level, top)).withColumn("_c", shared)
        pairs = pairs.withColumn("similarity", F.size("_c") / (F.col("n") + F.col("m") - F.size("_c"))).where(F.col("similarity") >= level)
        found = pairs.select(*within, F.col("a").alias("id"), F.explode("first").alias("target"), "similarity")
        own = sources.select(*within, "id", F.explode("first").alias("target"), F.lit(1.0).alias("similarity"))
        order = W.partitionBy(*within, "id").orderBy(F.desc("similarity"), "target")
        best = own.unionByName(found).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top + 1)
        best = written(best, "best")
        if level != least:
            full = best.where(F.col("_r") == top + 1).select(*within, "id")
            sources = written(sources.join(full, [*within, "id"], "left_anti"), "sources")
            best = best.join(full, [*within, "id"], "left_semi")
        lists = best if lists is None else lists.unionByName(best)
    each = members.join(lists.drop("_r"), [*within, "id"]).where(F.col("_key") != F.col("target"))
    ranked = each.withColumn("_r", F.row_number().over(W.partitionBy(*within, "_key").orderBy(F.desc("similarity"), "target")))
    return ranked.where(F.col("_r") <= top).select(*within, F.col("_key").alias("source"), "target", "similarity")
