"""Exact dedup by a tree-merge of sorted digest runs (DataFrame functions only).

The digests of all rows are taken once and written as runs: what a task read,
sorted by digest, length and a second hash, is a piece of one of `slots` runs.
A run's entry for a digest is how many rows it has and the identifier that
would stay. The runs merge in binomial rounds: in each, a run and its neighbour
make one, on (digest, length, second hash), which also verifies at every level
that equal digests come from equal texts; the identifier that stays is the
best of both. Entries of a text are summed before they move. The final answers
go back down to the runs, and only there to the rows, on (run, digest): no
shuffle gets more than one row of a text from each task, but for the last,
where a run has as many rows of it as its tasks read.

Defined results: a null text counts as empty; empty texts are equal to each
other; a null identifier sorts before all others; rows that repeat an
identifier are separate rows, of which each is returned, and of which each
carries the same `kept`; very long texts count whole. An empty table gives an
empty result. Other columns of the input, whatever their names, are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import NULL_ID, materialize, whole_text

KEY = ["_digest", "_len", "_check"]


def digest_runs(docs: DataFrame, text: Column, slots: int) -> DataFrame:
    """(id, run, digest, length, second hash) of every row, written as sorted runs."""
    body = text.cast("binary")
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.pmod(F.spark_partition_id(), F.lit(slots)).alias("_run"),
        F.sha2(body, 256).alias("_digest"),
        F.octet_length(text).alias("_len"),
        F.xxhash64(text).alias("_check"),
    )
    return materialize(rows.sortWithinPartitions("_run", *KEY), "digests")


def merge_tree(runs: DataFrame, keep: str = "max", slots: int = 64, fan_in: int = 2) -> DataFrame:
    """Merge runs of (run, digest, ..., _keep, _n) round by round into one."""
    best = {"max": F.max, "min": F.min}[keep]
    while slots > 1:
        slots = -(-slots // fan_in)
        runs = (
            runs.withColumn("_run", F.floor(F.col("_run") / F.lit(fan_in)).cast("int"))
            .groupBy("_run", *KEY)
            .agg(best("_keep").alias("_keep"), F.sum("_n").alias("_n"))
        )
    return runs.drop("_run")


def exact_dedup(docs: DataFrame, text: Column | None = None, keep: str = "max", slots: int = 64, fan_in: int = 2) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    text: the text as it is compared, by default the whole text unchanged;
    keep: which identifier of equal texts stays, "max" or "min";
    slots: the runs at first; fan_in: how many merge into one in each round.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    best = {"max": F.max, "min": F.min}[keep]
    rows = digest_runs(docs, whole_text() if text is None else text, slots)
    runs = rows.groupBy("_run", *KEY).agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    # Texts that occur once need no answer: their rows keep themselves.
    shared = materialize(merge_tree(runs, keep, slots, fan_in).where("_n > 1"), "shared-digests")
    answers = rows.select("_run", *KEY).distinct().join(shared, KEY)
    kept = F.coalesce(F.col("_keep"), F.col("_id"))
    back = lambda c: F.when(c != NULL_ID, c)
    return rows.join(answers, ["_run", *KEY], "left").select(
        back(F.col("_id")).alias("doc_id"),
        back(kept).alias("keep_id"),
        F.coalesce(F.col("_n"), F.lit(1)).cast("long").alias("group_size"),
        (F.col("_id") == kept).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )
