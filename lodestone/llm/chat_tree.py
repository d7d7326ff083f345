"""Chat formatting as a prefix tree.

Each turn becomes `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts a
backslash is doubled and `<|` becomes `<\\|`, so that control strings occur as
marks only; a line break in a role becomes `\\n`. Reading undoes it.

Conversations that share their first turns share nodes of a tree. Its tokens
are laid out once, depth-first: distinct paths (one digest for each turn) are
sorted by range, and each path lays out the nodes that the path before it does
not have, so a node stands before all nodes below it, and a subtree is one
stretch. Running sums inside a range and over the ranges give each node's
place. A node has, besides, the position of its first token in its
conversations, and the stretches of its ancestors, which its tokens attend to
together with its own earlier ones; adjoining stretches are one.

Tokens are byte-level BPE ids; the two marks follow the vocabulary's ids.

A first turn that many conversations share is a node like any other: paths
differ further on, so the ranges stay even, and the two joins that bring a
node's place back to the paths through it are ordinary joins, whose hot keys
adaptive execution splits.

Defined results: null texts and roles are empty; turns of a conversation are
ordered by turn, then role, then text, nulls first; rows of a null conv_id are
one conversation; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructType

from . import bpe
from .common import materialize, wider

BEGIN, FINISH = "<|im_start|>", "<|im_end|>"
#: Bytes of a turn's digest in a path.
STEP = 16


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], text)


def header(role: str) -> str:
    return escape(role).replace("\n", "\\n") + "\n"


def pather(batches):
    """(conv_id, path, roles, texts) with roles and texts formatted."""
    import pyarrow as pa

    for batch in batches:
        out = {"conv_id": batch.column("conv_id"), "path": [], "roles": [], "texts": []}
        for turns in batch.column("turns").to_pylist():
            path, last = [], b""
            roles, texts = [header(t["role"]) for t in turns], [escape(t["text"]) for t in turns]
            for r, t in zip(roles, texts):
                # The header ends at its only line break, so the pair is unambiguous.
                last = hashlib.sha256(last + r.encode() + t.encode()).digest()[:STEP]
                path.append(last)
            out["path"].append(b"".join(path))
            out["roles"].append(roles)
            out["texts"].append(texts)
        strings = pa.list_(pa.string())
        yield pa.RecordBatch.from_pydict(out | {"path": pa.array(out["path"], pa.binary()), "roles": pa.array(out["roles"], strings), "texts": pa.array(out["texts"], strings)})


def shared_steps(batches):
    """Adds how many first turns a path shares with the one before."""
    import pyarrow as pa

    for batch in batches:
        shared = []
        for path, prev in zip(batch.column("path").to_pylist(), batch.column("prev").to_pylist()):
            n, prev = 0, prev or b""
            while n < min(len(path), len(prev)) and path[n : n + STEP] == prev[n : n + STEP]:
                n += STEP
            shared.append(n // STEP)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared, pa.int32())], [*batch.schema.names, "shared"])


def node_of(k) -> Column:
    return F.substring(F.col("path"), k * STEP + 1, F.lit(STEP))


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, roles, texts): a row for each conversation."""
    turns = conversations.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    schema = wider(gathered.select("conv_id"), ("path", BinaryType()), ("roles", ArrayType(StringType())), ("texts", ArrayType(StringType())))
    return materialize(gathered.mapInArrow(pather, schema), "paths")


def prefix_tree(conversations: DataFrame, ranks_path: str, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes and the membership.

    nodes: node, parent, depth, tokens, loss_start, loss_end (the tokens under
    the loss mask, counted in the node), place (of the first token in the
    layout), position (of the first token in a conversation), ancestors (array
    of start and end in the layout). membership: conv_id, depth, node.
    """
    spark = conversations.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = conversation_paths(conversations)
    # Equal conversations are one path; any of them has its turns.
    distinct = paths.where(F.octet_length("path") > 0).groupBy("path").agg(F.any_value("roles").alias("roles"), F.any_value("texts").alias("texts"))
    sorted_ = materialize(distinct.repartitionByRange(ranges, "path").withColumn("part", F.spark_partition_id()), "sorted")
    # The last path of each range, for the first of the next: one row for each range.
    ends = sorted_.groupBy("part").agg(F.max("path").alias("last"))
    ends = ends.select("part", F.lag("last").over(W.orderBy("part")).alias("last"))
    before = F.lag("path").over(W.partitionBy("part").orderBy("path"))
    with_prev = sorted_.withColumn("prev", before).join(ends, "part").withColumn("prev", F.coalesce("prev", "last")).drop("last")
    laid = with_prev.mapInArrow(shared_steps, wider(with_prev, ("shared", IntegerType()))).drop("prev")
    steps = laid.select("path", "part", "shared", F.posexplode(F.arrays_zip("roles", "texts")).alias("depth", "t")).where("depth >= shared")
    heads = steps.select("path", "part", "depth", (F.col("t.roles") == "assistant\n").alias("loss"), F.col("t.texts").alias("body"), F.col("t.roles").alias("text"))
    bodies = bpe.encode(heads, ranks_path).withColumnsRenamed({"ids": "head", "body": "text"})
    coded = bpe.encode(bodies, ranks_path)
    begin, finish, newline = marks(ranks_path)
    start = F.when(F.col("loss"), 1 + F.size("head"))
    new = coded.select(
        "path",
        "part",
        "depth",
        node_of(F.col("depth")).alias("node"),
        F.when(F.col("depth") > 0, node_of(F.col("depth") - 1)).alias("parent"),
        F.concat(F.array(F.lit(begin)), "head", "ids", F.array(F.lit(finish), F.lit(newline))).alias("tokens"),
        start.alias("loss_start"),
        (start + F.size("ids")).alias("loss_end"),
    )
    new = materialize(new.withColumn("n", F.size("tokens").cast("long")), "nodes")
    # One sum for each range; then a running sum inside each.
    offsets = new.groupBy("part").agg(F.sum("n").alias("_sum"))
    offsets = offsets.select("part", F.coalesce(F.sum("_sum").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = F.sum("n").over(W.partitionBy("part").orderBy("path", "depth")) - F.col("n")
    placed = materialize(new.withColumn("_inside", inside).join(offsets, "part").withColumn("place", F.col("_offset") + F.col("_inside")).drop("_offset", "_inside", "part"), "placed")
    # The nodes that a path has from the one before it: their tokens and stretches.
    above = laid.where("shared > 0").select("path", F.explode(F.sequence(F.lit(0), F.col("shared") - 1)).alias("depth"))
    above = above.withColumn("node", node_of(F.col("depth"))).join(placed.select("node", "n", "place"), "node")
    above = above.groupBy("path").agg(F.sum("n").alias("_base"), F.array_sort(F.collect_list(F.struct(F.col("place").alias("start"), (F.col("place") + F.col("n")).alias("end")))).alias("_above"))
    own = F.sum("n").over(W.partitionBy("path").orderBy("depth")) - F.col("n")
    rows = placed.withColumn("_own", own).join(above, "path", "left")
    none = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")
    mine = F.when(F.col("_own") > 0, F.array(F.struct((F.col("place") - F.col("_own")).alias("start"), F.col("place").alias("end")))).otherwise(none)
    stretches = F.concat(F.coalesce("_above", none), mine)

    def joined(done, x):
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), x["end"].alias("end"))))
        return F.when(F.size(done) == 0, F.array(x)).when(last["end"] == x["start"], longer).otherwise(F.concat(done, F.array(x)))

    nodes = rows.select("node", "parent", "depth", "tokens", "loss_start", "loss_end", "place", (F.coalesce("_base", F.lit(0)) + F.col("_own")).alias("position"), F.aggregate(stretches, none, joined).alias("ancestors"))
    steps_of = F.sequence(F.lit(0), (F.octet_length("path") / STEP).cast("int") - 1)
    membership = paths.where(F.octet_length("path") > 0).select("conv_id", "path", F.explode(steps_of).alias("depth")).select("conv_id", "depth", node_of(F.col("depth")).alias("node"))
    return nodes, membership


def marks(ranks_path: str) -> tuple[int, int, int]:
    """The ids of the two marks, which follow the vocabulary's, and of a line break."""
    ranks = bpe.read_ranks(ranks_path)
    top = max(ranks.values())
    return top + 1, top + 2, ranks[b"\n"]


def reading(ranks):
    def run(batches):
        import pyarrow as pa

        token = {v: k for k, v in ranks.value.items()}
        top = max(token)
        token |= {top + 1: BEGIN.encode(), top + 2: FINISH.encode()}
        text_of = lambda ids: b"".join(map(token.__getitem__, ids)).decode()
        for batch in batches:
            turns, loss, formatted = [], [], []
            for nodes in batch.column("nodes").to_pylist():
                whole = text_of(t for n in nodes for t in n["tokens"])
                parts = whole.split(BEGIN)[1:]
                if any(not p.endswith(FINISH + "\n") for p in parts) or len(parts) != len(nodes):
                    raise ValueError("a conversation does not follow the template")
                own = [p[: -len(FINISH) - 1].split("\n", 1) for p in parts]
                turns.append([{"role": unescape(r), "text": unescape(t)} for r, t in own])
                loss.append("".join(unescape(text_of(n["tokens"][n["loss_start"] : n["loss_end"]])) for n in nodes if n["loss_start"] is not None))
                formatted.append(whole)
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), "turns": pa.array(turns, kind), "loss_text": pa.array(loss, pa.string()), "formatted": pa.array(formatted, pa.string())})

    return run


def read_back(nodes: DataFrame, membership: DataFrame, ranks_path: str) -> DataFrame:
    """conv_id, turns (role, text), loss_text and formatted, all decoded from the nodes' tokens."""
    ranks = nodes.sparkSession.sparkContext.broadcast(bpe.read_ranks(ranks_path))
    own = membership.join(nodes.select("node", "tokens", "loss_start", "loss_end"), "node")
    own = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "tokens", "loss_start", "loss_end"))).alias("nodes"))
    turn = StructType().add("role", StringType()).add("text", StringType())
    schema = wider(own.select("conv_id"), ("turns", ArrayType(turn)), ("loss_text", StringType()), ("formatted", StringType()))
    return own.mapInArrow(reading(ranks), schema)


def digest_columns(read: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
