"""Connected components of a table of links.

Each turn first cuts every task's links to a spanning forest, edge by edge from
a node to the smallest one that the task's links join it with. Then a large-star
and a small-star step follow: every node hands its larger neighbours to its
smallest one, then its smaller ones too. Turns go on until the links are stars
around the smallest node of each component, however many that takes: as long as
a component isn't a star, its smallest node gains neighbours with each turn and
loses none. A turn is a join and an aggregation with partial sums, written to
the shared folder; nothing is collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import drop_frame, materialize

#: Links that a task cuts to a forest at a time.
FOREST_LINKS = 1 << 20


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node that the links (a, b) join each with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label


def forest_maker(most: int):
    def cut(parts):
        import pyarrow as pa

        table = pa.Table.from_batches(parts)
        nodes, at = np.unique(np.concatenate([table.column("a").to_numpy(), table.column("b").to_numpy()]), return_inverse=True)
        label = roots(at[: len(table)], at[len(table) :], len(nodes))
        own = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_pydict({"a": pa.array(nodes[own]), "b": pa.array(nodes[label[own]])})

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            parts.append(batch)
            n += batch.num_rows
            if n >= most:
                yield cut(parts)
                parts, n = [], 0
        if n:
            yield cut(parts)

    return run


def forest(links: DataFrame) -> DataFrame:
    """links (a, b) as forests, one for each task's FOREST_LINKS links: a > b, no edge twice in one forest."""
    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(forest_maker(FOREST_LINKS), "a long, b long")


def star_round(links: DataFrame) -> DataFrame:
    """links: (a, b) with a > b, distinct."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("a", "_m"))
    # Large star: each larger neighbour is linked to the smallest node around.
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a > b").distinct()
    # Small star: the smaller neighbours are, too, and the node itself.
    low = large.groupBy("a").agg(F.min("b").alias("_m"))
    small = large.join(low, "a")
    return small.where("b != _m").select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(low.withColumnRenamed("_m", "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: (a, b), integers. Returns (node, component) for every node that is
    not the smallest of its component."""
    now, before = materialize(forest(links), "links"), None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        # A turn's links settle if they come out of it as they went in.
        before, last = state, now
        now = materialize(star_round(forest(now)), "links")
        drop_frame(last)
