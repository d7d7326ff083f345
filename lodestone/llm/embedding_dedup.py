"""Embedding near-dedup: subspace pigeonhole join.

Unit vectors with a cosine of at least c lie at a squared distance of at most
2 - 2c. After a rotation the coordinates are cut into blocks; as the blocks'
squared distances sum to the whole, at least one block is within its share of
that budget. So each block is range-joined alone under its share, and the
union of the candidates is verified exactly, in double precision, on the
vectors as given. A pair counts in the first block that finds it.

Range join of a block: its first two coordinates make a grid whose cells are as
wide as the block's radius, so partners lie in the same cell or in one beside
it. A cell with more than `slot` vectors is cut into slots by a hash, and a
tile joins one slot with some slots of its own cell and of four of the cells
beside it; hot cells thus spread over many tasks, and a tile's rows are
bounded. Tiles return sums of links for each vector and the edges of a spanning
forest, never the pairs: the output grows with the rows of the tiles.

The grid lies in a square of side 2, so the number of its cells is bounded by
the threshold, whatever the input; only their counts go to the driver.

Defined results: a vector that is null, empty or zero, or that holds a null or
non-finite component, links with nothing; vectors of different lengths don't
link; rows with equal identifiers are separate vectors; a null identifier
counts as the smallest; an empty table gives an empty result; other columns,
whatever their names, are not touched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import NULL_ID, materialize, scramble
from .components import components

#: Slots that a tile joins with its own slot at most.
PROBES = 64
NEIGHBOURS = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(20_011 + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def edges_of_blocks(dim: int, blocks: int) -> list[tuple[int, int]]:
    """First and last coordinate of each block."""
    cuts = np.linspace(0, dim, min(blocks, dim) + 1).astype(int).tolist()
    return list(zip(cuts, cuts[1:]))


def turned(x: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated. Plain loops: a row's result must not depend on the others, as a matrix library's may."""
    return np.einsum("ij,jk->ik", x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], rotation(x.shape[1]))


def cells(y: np.ndarray, cut: tuple[int, int], width: float) -> np.ndarray:
    """The grid cell of each vector in a block."""
    a, b = cut
    first = np.floor(y[:, a] / width)
    second = np.floor(y[:, a + 1] / width) if b - a > 1 else np.zeros(len(y))
    return np.stack([first, second], 1).astype(np.int64)


def reader(kind: str):
    """(row, vec_id, dim, vector): dim is 0 for vectors that can't link. kind: f4 or f8, as the input has them."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            lists = batch.column(1)
            dims, vectors = [], []
            for i in range(len(lists)):
                v = np.zeros(0)
                if lists[i].is_valid and not lists[i].values.null_count:
                    v = lists[i].values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(v).max(initial=0.0)
                good = bool(np.isfinite(v).all() and top > 0)
                if kind == "f8" and good and not 1e-100 < top < 1e100:
                    v = v / top  # the squares would leave the range of doubles
                dims.append(len(v) if good else 0)
                vectors.append(v.astype(kind).tobytes() if good else None)
            n = len(lists)
            yield pa.RecordBatch.from_pydict({"row": pa.array(row + np.arange(n)), "vec_id": batch.column(0), "dim": pa.array(dims, pa.int32()), "vector": pa.array(vectors, pa.binary())})
            row += n

    return run


def doubles(raw: list[bytes], dim: int) -> np.ndarray:
    kind = "f4" if raw and len(raw[0]) == 4 * dim else "f8"
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), dim).astype(np.float64)


def by_dim(batch):
    """(dim, rows, vectors) of a batch."""
    dims = batch.column("dim").to_numpy()
    rows = batch.column("row").to_numpy()
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        raw = batch.column("vector").take(at)
        yield d, rows[at], raw.to_pylist()


def counter(blocks: int, budget: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for d, _, raw in by_dim(batch):
                y = turned(doubles(raw, d))
                cuts = edges_of_blocks(d, blocks)
                for b, cut in enumerate(cuts):
                    kinds, n = np.unique(cells(y, cut, cell_width(budget, len(cuts))), axis=0, return_counts=True)
                    out += [(d, b, *map(int, k), int(c)) for k, c in zip(kinds, n)]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["dim", "block", "cx", "cy", "n"])

    return run


def cell_width(budget: float, blocks: int) -> float:
    return float(np.sqrt(budget / blocks)) * (1 + 1e-9) + 1e-9


def slots_of(rows: np.ndarray, n: int) -> np.ndarray:
    return (scramble(rows.astype(np.uint64), 7) % np.uint64(n)).astype(np.int64)


def tiles(blocks: int, budget: float, slots: dict):
    """Copies of every vector for the tiles (dim, block, cell, slot, part) it takes part in.

    The tile of a slot sees, numbered in turn, its cell's slots and those of the
    cells beside it; PROBES of these numbers make a part.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for d, rows, raw in by_dim(batch):
                y = turned(doubles(raw, d))
                cuts = edges_of_blocks(d, blocks)
                for b, cut in enumerate(cuts):
                    place = cells(y, cut, cell_width(budget, len(cuts)))
                    kinds, which = np.unique(place, axis=0, return_inverse=True)
                    order = np.argsort(which.ravel(), kind="stable")
                    for k, at in zip(kinds.tolist(), np.split(order, np.cumsum(np.bincount(which.ravel()))[:-1])):
                        mine, own = slots[d, b, k[0], k[1]], slots_of(rows[at], slots[d, b, k[0], k[1]])
                        found: list[tuple[str, int, np.ndarray]] = []
                        seen = sum(slots.get((d, b, k[0] + p, k[1] + q), 0) for p, q in NEIGHBOURS)
                        for s in range(mine):
                            home = at[own == s]
                            if not len(home):
                                continue
                            for part in range(-(-seen // PROBES)):
                                found.append((f"{d}:{b}:{k[0]}:{k[1]}:{s}:{part}", 0, home))
                            for t in range(s):  # later slots of a cell meet the earlier ones there
                                found.append((f"{d}:{b}:{k[0]}:{k[1]}:{t}:{s // PROBES}", 1, home))
                            for p, q in NEIGHBOURS[1:]:
                                other = (k[0] - p, k[1] - q)
                                n = slots.get((d, b, *other), 0)
                                before = 0
                                for u, v in NEIGHBOURS:
                                    if (u, v) == (p, q):
                                        break
                                    before += slots.get((d, b, other[0] + u, other[1] + v), 0)
                                for t in range(n):
                                    found.append((f"{d}:{b}:{other[0]}:{other[1]}:{t}:{(before + s) // PROBES}", 1, home))
                        for key, role, some in found:
                            yield pa.RecordBatch.from_pydict({"tile": pa.array([key] * len(some)), "role": pa.array([role] * len(some), pa.int32()), "row": pa.array(rows[some]), "vector": pa.array([raw[v] for v in some], pa.binary())})

    return run


def joiner(blocks: int, budget: float, least: float):
    def run(key, table):
        import pyarrow as pa

        d, block, *_, part = map(int, key[0].as_py().split(":"))
        table = table.sort_by("row")
        role, row = table.column("role").to_numpy(), table.column("row").to_numpy()
        x = doubles(table.column("vector").to_pylist(), d)
        y = turned(x)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        cuts = edges_of_blocks(d, blocks)
        share = budget / len(cuts) * (1 + 1e-9) + 1e-12
        home = np.flatnonzero(role == 0)
        links, label = np.zeros(len(row), np.int64), np.arange(len(row))
        a, b = cuts[block]
        small = np.ascontiguousarray(y[:, a:b])
        square = np.einsum("ij,ij->i", small, small)

        def within(u, v, cut):
            diff = y[u, cut[0] : cut[1]] - y[v, cut[0] : cut[1]]
            return np.einsum("ij,ij->i", diff, diff) <= share

        def verify(u, v):
            keep = within(u, v, (a, b))
            for cut in cuts[:block]:
                keep[keep] = ~within(u[keep], v[keep], cut)
            u, v = u[keep], v[keep]
            keep = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v]) >= least
            u, v = u[keep], v[keep]
            np.add.at(links, u, 1)
            np.add.at(links, v, 1)
            while len(u):
                low = np.minimum(label[u], label[v])
                np.minimum.at(label, label[u], low)
                np.minimum.at(label, label[v], low)
                label[:] = label[label]
                live = label[u] != label[v]
                u, v = u[live], v[live]

        # A slot meets itself in the part that holds its own number.
        own_slot = int(key[0].as_py().split(":")[4])
        sides = [(home, np.flatnonzero(role == 1), False)]
        if own_slot // PROBES == part:
            sides.append((home, home, True))
        for left, right, same in sides:
            for i in range(0, len(left), 512):
                p = left[i : i + 512]
                for j in range(0, len(right), 2048):
                    q = right[j : j + 2048]
                    near = square[p][:, None] + square[q][None, :] - 2 * (small[p] @ small[q].T) <= share + 1e-9
                    u, v = np.nonzero(near)
                    u, v = p[u], q[v]
                    if same:
                        u, v = u[u < v], v[u < v]
                    for c in range(0, len(u), 1 << 16):
                        verify(u[c : c + (1 << 16)], v[c : c + (1 << 16)])
        while (label[label] != label).any():
            label[:] = label[label]
        some = np.flatnonzero(links)
        return pa.table({"row": pa.array(row[some]), "links": pa.array(links[some]), "root": pa.array(row[label[some]])})

    return run


def embedding_dedup(vectors: DataFrame, least: float = 0.9, blocks: int = 4, slot: int = 4096, vector: str = "embedding") -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept."""
    budget = 2 - 2 * least + 1e-9
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    rows = materialize(source.mapInArrow(reader("f4" if source.schema["vector"].dataType.simpleString() == "array<float>" else "f8"), "row long, vec_id long, dim int, vector binary"), "vectors")
    live = rows.where("dim > 0").select("row", "dim", "vector")
    # One count for each cell of the grids: their number is bounded by the budget.
    counts = live.mapInArrow(counter(blocks, budget), "dim long, block long, cx long, cy long, n long").groupBy("dim", "block", "cx", "cy").agg(F.sum("n").alias("n"))
    slots = {(r["dim"], r["block"], r["cx"], r["cy"]): -(-r["n"] // slot) for r in counts.collect()}
    copies = live.mapInArrow(tiles(blocks, budget, slots), "tile string, role int, row long, vector binary")
    found = materialize(copies.groupBy("tile").applyInArrow(joiner(blocks, budget, least), "row long, links long, root long"), "tiles")
    sums = found.groupBy("row").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("row").alias("a"), F.col("root").alias("b")))
    named = rows.select("row", F.coalesce("vec_id", F.lit(NULL_ID)).alias("vec_id")).join(sums, "row", "left").join(group.withColumnRenamed("node", "row"), "row", "left")
    named = materialize(named.withColumn("group", F.coalesce("component", "row")), "grouped")
    # Only vectors with links need their group's smallest identifier.
    lowest = named.where("links IS NOT NULL").groupBy("group").agg(F.min("vec_id").alias("_low"))
    out = named.withColumn("key", F.when(F.col("links").isNotNull(), F.col("group"))).join(lowest.withColumnRenamed("group", "key"), "key", "left")
    back = lambda c: F.when(c != NULL_ID, c)
    low = F.coalesce("_low", "vec_id")
    return out.select(back(F.col("vec_id")).alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), back(low).alias("component_id"), (F.col("vec_id") == low).alias("kept"))
