"""Blocks of documents, and the exchange of sorted key runs between them.

A block is some megabytes of whole documents, packed and compressed; a very
long document is a block of its own. The blocks are a table in the shared
folder, bucketed by their number, so that answers can be brought back to them
without another shuffle of the text.

An exchange sends from each block one packed run of keys to each shard (a
range of hashes). A shard merges the runs of all blocks and answers each block
in the order of its keys. A key that every document has is one entry for each
block: the blocks pre-aggregate.
"""

from __future__ import annotations

import atexit
import uuid

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import NULL_ID, drop_path, give_back, new_path, tidy, whole_text

BLOCK_SCHEMA = "block long, n_docs int, n_bytes long, ids binary, lens binary, body binary"
RUN_SCHEMA = "shard int, block long, body binary"
#: Documents of a block at most.
MOST_DOCS = 1 << 13
ANSWER_SCHEMA = "block long, kind int, shard int, body binary"


def pack(data) -> bytes:
    """zstd with the length in front."""
    import pyarrow as pa

    data = np.ascontiguousarray(data).tobytes() if isinstance(data, np.ndarray) else bytes(data)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def unpack(data: bytes) -> bytes:
    import pyarrow as pa

    n = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], n, asbytes=True)


def text_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, and len + 1 offsets into them."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[off[0] : off[-1]], off - off[0]


def packer(target: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            if not batch.num_rows:
                continue
            body, off = text_of(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = max(1, -(-int(off[-1]) // target), -(-len(ids) // MOST_DOCS))
            cuts = np.unique(np.searchsorted(off, np.arange(1, parts) * (off[-1] / parts)).clip(1, len(ids)))
            cuts = np.unique(np.concatenate([cuts, np.arange(MOST_DOCS, len(ids), MOST_DOCS)])).astype(int)
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                if a < b:
                    yield pa.RecordBatch.from_pydict(
                        {"block": [number], "n_docs": pa.array([int(b - a)], pa.int32()), "n_bytes": [int(off[b] - off[a])], "ids": [pack(ids[a:b])], "lens": [pack(np.diff(off[a : b + 1]))], "body": [pack(body[off[a] : off[b]])]}
                    )
                    number += 1

    return run


class Blocks:
    """The blocks table of some documents: its frame, its bytes, its shards."""

    def __init__(self, docs: DataFrame, target: int = 8 << 20, shard_bytes: int = 4 << 20, least_shards: int = 256):
        spark = self.spark = docs.sparkSession
        self.name, self.path = f"blocks_{uuid.uuid4().hex}", new_path(spark, "blocks")
        source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), whole_text().alias("text"))
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        (
            source.mapInArrow(tidy(packer(target)), BLOCK_SCHEMA)
            .write.bucketBy(buckets, "block")
            .option("path", self.path)
            .option("compression", "uncompressed")
            .format("parquet")
            .saveAsTable(self.name)
        )
        self.frame = spark.table(self.name)
        atexit.register(self.drop)
        self.n_bytes = self.frame.agg(F.sum("n_bytes")).first()[0] or 0
        self.shards = max(least_shards, self.n_bytes // shard_bytes)

    def runs(self, make) -> DataFrame:
        """make(ids, offsets, body, shards) -> iterable of (shard, bytes)."""
        return self.frame.mapInArrow(tidy(run_maker(make, self.shards)), RUN_SCHEMA)

    def answers(self, runs: DataFrame, answer, kind: int) -> DataFrame:
        """answer(list of bytes, one for each block in turn) -> list of bytes.

        If answer returns one more, that goes out as kind 0 of block -1: what the shard says of all.
        """
        return runs.groupBy("shard").applyInArrow(answerer(answer, kind), ANSWER_SCHEMA)

    def finish(self, answers: DataFrame, make, schema: str) -> DataFrame:
        """make(block, ids, offsets, body, {kind: {shard: bytes}}, shards) -> dict of columns."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        arrow = to_arrow_schema(StructType.fromDDL(schema))
        return self.frame.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finisher(make, arrow, self.shards), schema)

    def drop(self) -> None:
        """Drop the table and its files; at the driver's end at the latest."""
        atexit.unregister(self.drop)
        if self.spark.sparkContext._jsc is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            drop_path(self.spark, self.path)


def opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, offsets and body of a block."""
    ids, lens = np.frombuffer(unpack(row["ids"]), np.int64), np.frombuffer(unpack(row["lens"]), np.int64)
    return ids, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64), np.frombuffer(unpack(row["body"]), np.uint8)


def run_maker(make, shards):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("block", "ids", "lens", "body")}
                found = list(make(*opened(row), shards))
                yield pa.RecordBatch.from_pydict({"shard": pa.array([k for k, _ in found], pa.int32()), "block": pa.array([row["block"]] * len(found), pa.int64()), "body": pa.array([v for _, v in found], pa.binary())})

    return run


def answerer(answer, kind):
    def run(table):
        import pyarrow as pa

        table = table.sort_by("block")  # the order of arrival differs from run to run
        said = answer(table.column("body").to_pylist())
        n = table.num_rows
        more = len(said) - n
        blocks, shard = table.column("block").to_pylist() + [-1] * more, table.column("shard").to_pylist()
        return pa.table({"block": pa.array(blocks, pa.int64()), "kind": pa.array([kind] * n + [0] * more, pa.int32()), "shard": pa.array(shard + shard[:more], pa.int32()), "body": pa.array(said, pa.binary())})

    return run


def finisher(make, arrow, shards):
    def run(left, right):
        import pyarrow as pa

        out = []
        for row in left.to_pylist():
            said: dict = {}
            for k, s, v in zip(right.column("kind").to_pylist(), right.column("shard").to_pylist(), right.column("body").to_pylist()):
                said.setdefault(k, {})[s] = v
            columns = make(row["block"], *opened(row), said, shards)
            out.append(pa.table([pa.array(columns[f.name], f.type, from_pandas=True) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in arrow], schema=arrow))
        row = said = columns = None
        give_back()
        return pa.concat_tables(out) if out else arrow.empty_table()

    return run


def shard_slices(shard_of_sorted: np.ndarray):
    """(shard, start, end) of the runs in a sorted array of shard numbers."""
    if not len(shard_of_sorted):
        return
    cuts = np.flatnonzero(np.diff(shard_of_sorted)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard_of_sorted)]):
        yield int(shard_of_sorted[a]), a, b
