"""Mixing sources to target weights (DataFrame functions only).

Targets: sources in the order of their code points (null last) weigh 5, 2, 1,
repeating, and share `share` times all words; a target stops at `cap` times its
source's size, and what is over goes to the others by weight until none is
above. With t(l) = min(cap, l * weight), the total grows with the level l, and
the sources reach their caps in the order of cap / weight; so one pass over
the sources in that order finds the level.

Cut: a document's key is a hash of its identifier and a seed. Each source's
key space is cut in `ranges` equal parts; their word counts are summed, and a
running sum over the parts gives each part's start. Inside a part the rows are
sorted by key and summed again. A document is taken for every whole epoch and,
in the last one, as far as its span of words lies under the budget, so that
each source's words come to its rounded target exactly. No shuffle has
documents of one source in one task: a part has 1/ranges of them.

Defined results: a null text has size 0; a null source is one source, the
last; rows with equal identifiers are ordered by size, which leaves the taken
words of their source as they are; empty sources have the target 0; an empty
table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialize, whole_text

#: Hex digits of a key.
DIGITS = 10


def hash_key(seed: int) -> Column:
    """A hash-random key of the identifier, which other engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, DIGITS), 16, 10).cast("long")


def word_count(text: Column | None = None) -> Column:
    return F.regexp_count(whole_text() if text is None else text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(totals: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """totals: (_src, _null, source_size), a row for each source. Adds target.

    If exactly the i sources that reach their caps first were capped, the level
    would be (total - their caps) / (the others' weights). That rises as long as
    the next source lies under the level, and falls after: the level is its maximum.
    """
    n = len(weights)
    order = W.orderBy("_reach", "_rank")
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % n + 1).cast("int"))
    return (
        totals.withColumn("_rank", F.row_number().over(W.orderBy("_null", "_src")))
        .withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_reach", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_level", (F.col("_total") - before("_cap")) / (F.sum("_weight").over(everything) - before("_weight")))
        .withColumn("target", F.least(F.col("_cap"), F.max("_level").over(everything) * F.col("_weight")))
        .select("_src", "_null", "source_size", "target")
    )


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, ranges: int = 1024, seed: int = 17, size: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, and the columns of `keep`."""
    part = ["_src", "_null", "_part"]
    sized = materialize(
        docs.select(
            "doc_id",
            *keep,
            F.coalesce("source", F.lit("")).alias("_src"),
            F.col("source").isNull().alias("_null"),
            (word_count() if size is None else size).alias("size"),
            hash_key(seed).alias("_key"),
            # Rows that agree in identifier and size, but not in what is kept, have an order, too.
            (F.xxhash64(*keep) if keep else F.lit(0)).alias("_tie"),
        ).withColumn("_part", F.floor(F.col("_key") * F.lit(ranges) / F.lit(16.0**DIGITS)).cast("int")),
        "sized",
    )
    parts = sized.groupBy(*part).agg(F.sum("size").alias("_words"))
    targets = source_targets(parts.groupBy("_src", "_null").agg(F.sum("_words").alias("source_size")), weights, share, cap)
    ahead = W.partitionBy("_src", "_null").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    plan = parts.withColumn("_start", F.coalesce(F.sum("_words").over(ahead), F.lit(0))).join(targets, ["_src", "_null"]).drop("_words")
    inside = W.partitionBy(*part).orderBy("_key", "doc_id", "size", "_tie").rowsBetween(W.unboundedPreceding, -1)
    budget = F.round("target").cast("long")
    rows = (
        sized.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(plan, part)
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("_rest", budget - F.col("_epochs") * F.col("source_size"))
    )
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_start") - F.col("_before")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + last).cast("long").alias("taken"), *keep)
