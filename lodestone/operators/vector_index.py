"""A partitioned inverted-file index of vectors, and exact nearest neighbours by it.

Coarse centroids are fitted on a bounded sample: the `sample` vectors whose
identifiers hash lowest, whatever the table's size. Every vector goes to the
cell of its nearest centroid. Cells are stored as blocks of at most BLOCK
vectors in the order of their distance to the centroid, so that a block covers
a ring [low, high] around it. Blocks are ranged by cell and distance: a cell
with a third of all vectors is many blocks in many tasks.

A search probes the nearest cells of each query, and then what the triangle
inequality cannot rule out: a vector in a ring is at least d(query, centroid) -
high or low - d(query, centroid) away. When no further ring can hold a vector
nearer than the k-th found, the k found are the nearest of all. Only blocks meet
queries, in batches of QUERIES: no query meets a vector of a ring ruled out.

Null vectors, and vectors with null components, are not in the index. All
vectors have the same number of dimensions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import similarity_of
from ..sources.tables import written

#: A search within a distance deals cells into GROUPS and queries into PARTS: a vector goes once to each group, and a block to each part.
GROUPS, PARTS = 8, 8
BLOCK = 1024
QUERIES = 256
#: Distances that a product of matrices gives may be off by this much; what is near the k-th is taken again, exactly.
SLACK = 1e-9


@dataclass(frozen=True)
class VectorIndex:
    """blocks: by columns, cell, block, low, high, n, ids, data (float64, row by row). reach: how far each cell's vectors lie from its centroid, -1 for none."""

    centroids: np.ndarray
    reach: np.ndarray
    blocks: DataFrame
    by: tuple[str, ...]


def matrix(column) -> np.ndarray:
    """An Arrow column of lists of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows of the sample."""
    at = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        own = squares(sample, at).argmin(axis=1)
        n = np.bincount(own, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        at[n > 0] = sums[n > 0] / n[n > 0, None]
    return at


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T), 0.0)


def assigner(centroids, at: int):
    def run(batches):
        import pyarrow as pa

        means = centroids.value
        for batch in batches:
            if len(batch):
                far = squares(matrix(batch.column(at)), means)
                cell = far.argmin(axis=1)
                names = [*batch.schema.names, "cell", "away"]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(far[np.arange(len(cell)), cell]))], names)

    return run


def packer(keys: int):
    """Blocks from rows (keys..., cell, away, vec_id, embedding) that come in the order of keys, cell and away."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for batch in (b for b in batches if len(b)):
            labels = list(zip(*(batch.column(i).to_pylist() for i in range(keys + 1))))
            ids, away, data = batch.column(keys + 2).to_numpy(), batch.column(keys + 1).to_numpy(), matrix(batch.column(keys + 3))
            cuts = [0, *(i for i in range(1, len(labels)) if labels[i] != labels[i - 1]), len(labels)]
            for a, b in zip(cuts, cuts[1:]):
                for first in range(a, b, BLOCK):
                    own = slice(first, min(first + BLOCK, b))
                    columns = [*labels[first], (task << 32) + number, float(away[own][0]), float(away[own][-1]), own.stop - own.start, ids[own].astype("<i8").tobytes(), data[own].astype("<f8").tobytes()]
                    number += 1
                    kinds = [batch.schema.field(i).type for i in range(keys + 1)] + [None] * 6
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, kinds)], [*batch.schema.names[: keys + 1], "block", "low", "high", "n", "ids", "data"])

    return run


def build_index(vectors: DataFrame, cells: int = 64, sample: int = 8192, by: tuple[str, ...] = ()) -> VectorIndex:
    """vectors: vec_id, embedding and the columns `by`, inside which a search stays."""
    spark = vectors.sparkSession
    whole = vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    rows = whole.select(*by, F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # A bounded number of vectors, as documented above.
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    centroids = fit_centroids(matrix(first), cells) if len(first) else np.zeros((1, 1))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keyed = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    lead = keyed + ", " if by else ""
    placed = rows.mapInArrow(assigner(spark.sparkContext.broadcast(centroids), len(by) + 1), f"{lead}vec_id long, embedding array<double>, cell int, away double")
    order = [*by, "cell", "away", "vec_id"]
    placed = written(placed, "cells").select(*by, "cell", "away", "vec_id", "embedding").repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = placed.mapInArrow(packer(len(by)), f"{lead}cell int, block long, low double, high double, n long, ids binary, data binary")
    blocks, reach = written(blocks, "vectors"), np.full(len(centroids), -1.0)
    for row in blocks.groupBy("cell").agg(F.max("high").alias("high")).collect():  # as many rows as centroids
        reach[row.cell] = row.high
    return VectorIndex(centroids, reach, blocks, by)


def prober(centroids, reach, first: int, last: int | None, groups: int):
    """For queries (question_id, by..., query_vector, worst): the groups of cells of which some have rank first to last and an outermost ring that may be near enough.

    away: the distances to the group's cells (those that are equal modulo groups, in their order); NaN if a cell is ruled out.
    """

    def run(batches):
        import pyarrow as pa

        means, high = centroids.value, reach.value
        for batch in batches:
            if not len(batch) or high.max() < 0:
                continue
            vectors, worst = matrix(batch.column(batch.num_columns - 2)), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            far = np.sqrt(squares(vectors, means))
            rank = far.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
            near = (rank >= first) & (high >= 0) & (far - high <= worst[:, None] + SLACK)
            if last is not None:
                near &= rank < last
            # Cells in rows of one group each; what is missing in the last row is ruled out.
            wide = np.full((len(far), -(-len(means) // groups) * groups), np.nan)
            wide[:, : len(means)] = np.where(near, far, np.nan)
            wide = wide.reshape(len(far), -1, groups).transpose(0, 2, 1)
            row, group = np.nonzero(~np.isnan(wide).all(axis=2))
            rows, away = batch.take(pa.array(row)), wide[row, group]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(away) + 1, dtype=np.int32) * away.shape[1]), pa.array(away.ravel()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(group.astype(np.int32)), lists], [*rows.schema.names, "group", "away"])

    return run


def scanner(k: int):
    """Rows (ids, data, at, low, high, queries): the k nearest of a block to each query that its ring may concern, and how many vectors were looked at."""

    def run(batches):
        import pyarrow as pa

        names = ["question", "vec_id", "distance", "scanned"]
        for batch in batches:
            for r in range(len(batch)):
                asked = batch.column("queries")[r].values
                away, worst = matrix(asked.field("away"))[:, batch.column("at")[r].as_py()], asked.field("worst").to_numpy(zero_copy_only=False)
                low, high = batch.column("low")[r].as_py(), batch.column("high")[r].as_py()
                own = np.flatnonzero((away - high <= worst + SLACK) & (low - away <= worst + SLACK))
                if not len(own):
                    continue
                ids = np.frombuffer(batch.column("ids")[r].as_buffer(), "<i8")
                data = np.frombuffer(batch.column("data")[r].as_buffer(), "<f8").reshape(len(ids), -1)
                wanted = matrix(asked.field("query_vector"))[own]
                far = squares(wanted, data)
                some = np.partition(far, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                q, v = np.nonzero(far <= some[:, None] + SLACK)
                exact = ((wanted[q] - data[v]) ** 2).sum(axis=1)
                place = np.lexsort((ids[v], exact, q))
                q, v, exact = q[place], v[place], exact[place]
                number = np.arange(len(q)) - np.searchsorted(q, q)
                kept = number < k
                numbers = asked.field("number").to_numpy()[own]
                question = np.concatenate([numbers[q[kept]], numbers])
                vec = pa.array(np.concatenate([ids[v[kept]], np.zeros(len(own), np.int64)]), mask=np.concatenate([np.zeros(kept.sum(), bool), np.ones(len(own), bool)]))
                distance = np.concatenate([exact[kept], np.zeros(len(own))])
                scanned = np.concatenate([np.zeros(kept.sum(), np.int64), np.full(len(own), len(ids))])
                yield pa.RecordBatch.from_arrays([pa.array(question), vec, pa.array(distance), pa.array(scanned)], names)

    return run


def closer(batches):
    """Rows (at, low, high, ids, data, queries): all vectors of a block within each query's own distance `worst`."""
    import pyarrow as pa

    for batch in batches:
        for r in range(len(batch)):
            asked = batch.column("queries")[r].values
            away, worst = matrix(asked.field("away"))[:, batch.column("at")[r].as_py()], asked.field("worst").to_numpy(zero_copy_only=False)
            own = np.flatnonzero((away - batch.column("high")[r].as_py() <= worst + SLACK) & (batch.column("low")[r].as_py() - away <= worst + SLACK))
            if not len(own):
                continue
            ids = np.frombuffer(batch.column("ids")[r].as_buffer(), "<i8")
            data = np.frombuffer(batch.column("data")[r].as_buffer(), "<f8").reshape(len(ids), -1)
            wanted, most = matrix(asked.field("query_vector"))[own], worst[own] ** 2
            q, v = np.nonzero(squares(wanted, data) <= most[:, None] + SLACK)
            exact = ((wanted[q] - data[v]) ** 2).sum(axis=1)
            kept = exact <= most[q] * (1 + 1e-12)
            yield pa.RecordBatch.from_arrays([pa.array(asked.field("number").to_numpy()[own][q[kept]]), pa.array(ids[v[kept]]), pa.array(exact[kept]), pa.array(np.zeros(int(kept.sum()), np.int64))], ["question", "vec_id", "distance", "scanned"])


def meet(index: VectorIndex, probes: DataFrame, look, groups: int, parts: int = 1) -> DataFrame:
    """question, vec_id, distance, scanned, as `look` finds them in the blocks that probes (number, by..., query_vector, worst, group, away) ask for.

    A task has a group's blocks and a part of its queries. Queries are dealt once:
    they are numbered, put into batches and met by the blocks where they are.
    """
    keys = [*index.by, "group", "part"]
    order = W.partitionBy(*keys).orderBy("number")
    asked = probes.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(parts)).cast("int"))
    asked = asked.select(*keys, F.floor((F.row_number().over(order) - 1) / QUERIES).alias("batch"), F.struct("number", "query_vector", "worst", "away").alias("q"))
    asked = asked.groupBy(*keys, "batch").agg(F.collect_list("q").alias("queries"))
    blocks = index.blocks.withColumns({"group": F.col("cell") % groups, "at": (F.col("cell") / groups).cast("int"), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    on = [*[blocks[c].eqNullSafe(asked[c]) for c in index.by], *[blocks[c] == asked[c] for c in ("group", "part")]]
    pairs = blocks.join(asked, on).select("at", "low", "high", "ids", "data", "queries")
    return pairs.mapInArrow(look, "question long, vec_id long, distance double, scanned long")


def search_index(index: VectorIndex, queries: DataFrame, k: int, probes: tuple[int, ...] = (4,), exact: bool = True) -> DataFrame:
    """question_id, vec_id, distance (squared), dense, rank, scanned (vectors that the question was compared with).

    queries: question_id, query_vector and the index's by columns. probes: how
    many of its nearest cells a query has seen after each round; then, if exact,
    come all cells that the bound does not rule out. Ties go to the smaller vec_id.
    """
    spark, count = queries.sparkSession, len(index.centroids)
    whole = queries.where(F.col("query_vector").isNotNull() & ~F.exists("query_vector", lambda x: x.isNull()))
    asked = whole.select(F.monotonically_increasing_id().alias("number"), "question_id", *index.by, F.col("query_vector").cast("array<double>").alias("query_vector"))
    asked = written(asked, "queries")
    kinds = dict(asked.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("number", *index.by, "query_vector")) + ", worst double, group int, away array<double>"
    means, reach = spark.sparkContext.broadcast(index.centroids), spark.sparkContext.broadcast(index.reach)
    rounds = [min(p, count) for p in probes] + [None] * exact
    found, first = None, 0
    for last in rounds:
        if last is not None and last <= first:
            continue
        known = asked.select("number", *index.by, "query_vector")
        if found is None:
            known = known.withColumn("worst", F.lit(float("inf")))
        else:
            worst = found.where(f"rank = {k}").select("number", F.sqrt("distance").alias("worst"))
            known = known.join(worst, "number", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
        rows = meet(index, known.mapInArrow(prober(means, reach, first, last, count), schema), scanner(k), count).withColumnRenamed("question", "number")
        if found is not None:
            rows = rows.unionByName(found.select("number", "vec_id", "distance", "scanned"))
        scanned = F.sum("scanned").over(W.partitionBy("number"))
        order = W.partitionBy("number").orderBy(F.col("vec_id").isNull(), "distance", "vec_id")
        ranked = rows.withColumn("all", scanned).withColumn("rank", F.row_number().over(order))
        # The first row keeps what has been looked at so far.
        ranked = ranked.where((F.col("rank") <= k) & F.col("vec_id").isNotNull())
        found = written(ranked.select("number", "vec_id", "distance", F.when(F.col("rank") == 1, F.col("all")).otherwise(0).alias("scanned"), "rank"), "nearest")
        first = last
    out = found.join(asked.select("number", "question_id"), "number")
    total = F.sum("scanned").over(W.partitionBy("number")).alias("scanned")
    return out.select("question_id", "vec_id", "distance", similarity_of("distance").alias("dense"), "rank", total)


def within(index: VectorIndex, queries: DataFrame, distance: float) -> DataFrame:
    """question_id, vec_id, distance of all vectors whose squared distance to a query (question_id: long, query_vector) is at most `distance`."""
    spark = queries.sparkSession
    asked = queries.where(F.col("query_vector").isNotNull() & ~F.exists("query_vector", lambda x: x.isNull()))
    asked = asked.select(F.col("question_id").cast("long").alias("number"), *index.by, F.col("query_vector").cast("array<double>").alias("query_vector"), F.lit(float(np.sqrt(distance))).alias("worst"))
    kinds = dict(asked.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in asked.columns) + ", group int, away array<double>"
    means, reach = spark.sparkContext.broadcast(index.centroids), spark.sparkContext.broadcast(index.reach)
    found = meet(index, asked.mapInArrow(prober(means, reach, 0, None, GROUPS), schema), closer, GROUPS, PARTS)
    return found.select(F.col("question").alias("question_id"), "vec_id", "distance")
