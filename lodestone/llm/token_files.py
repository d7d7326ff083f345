"""Token ids in binary files: encoded by a tokenizers library, written in the order of the identifiers, and read back.

Rows are ranged by identifier and sorted inside each range. A task encodes its
range's texts one stretch after the other and writes a file (rans.py) for each
FILE_IDS ids or so; a file is a binary value of a row, so that Spark's own
writer, committer and any Hadoop file system carry it. A file has a frequency
table of its own, which its blocks share, so a task keeps no more than one
file's ids, and ids are written once. Where a document starts among all ids
comes from the files' numbers of ids, by sums over ranges and over the files
of a range.

Texts are cut at blanks: there the tokenizer's pattern always cuts too, unless
white space stands on both sides of the blank. Texts with such a place are
encoded whole. Of the others each distinct part of a worker's texts is encoded
once; a worker remembers MOST parts at most, then begins anew. Parts without
white space go to the library as lines of one text, LINES at a time: a line feed
that stands alone is a token of its own, so its id tells where each part ends.
Where it is not, as the number of such ids tells, each part is encoded by itself.

Defined results: a null text is empty, and has only the end id; null
identifiers come first and are read back as null; rows with equal identifiers
each have their place, in the order of a hash of their texts; strings of
special tokens are ordinary text; a text of any length is encoded whole, and is
in one file; an empty table makes no files and no rows; other columns of docs,
whatever their names, are not looked at.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import NULL_ID, materialize, whole_text
from .rans import File, encode_file

FILE_IDS = 1 << 22
#: Bytes of the texts whose parts are numbered together.
STRETCH = 4 << 20
MOST = 1 << 20
#: Parts that the library gets at a time, so that what it makes of them stays small.
CALL = 10_000
#: Parts that go to the library as lines of one text.
LINES = 100
WHITE = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
#: A blank with white space on both sides, or on its left and the end on its right.
WIDE_BLANK = rf"{WHITE} (?:{WHITE}|$)"


class Parts:
    """The ids of parts of texts. Known parts are numbered; off and ids hold what number has which ids."""

    def __init__(self, tokenizer: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.clear()

    def clear(self) -> None:
        import pyarrow as pa

        self.known = {lead: pa.array([], pa.string()) for lead in ("", " ")}
        self.number = {lead: np.zeros(0, np.int64) for lead in ("", " ")}
        self.ids, self.off = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), CALL):
            found = [e.ids for e in self.library.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    def encode_lines(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What encode() returns, for parts that have no white space but a blank before others, and are not empty."""
        end = self.library.encode("\n", add_special_tokens=False).ids
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(parts), CALL):
            own = parts[at : at + CALL]
            found = self.library.encode_batch_fast(["\n".join([*own[k : k + LINES], ""]) for k in range(0, len(own), LINES)], add_special_tokens=False)
            got = np.concatenate([np.array(e.ids, np.uint32) for e in found])
            is_end = got == end[0] if len(end) == 1 else np.zeros(len(got), bool)
            ends = np.flatnonzero(is_end)
            if len(ends) == len(own):
                got, n = got[~is_end], np.diff(ends, prepend=-1) - 1
            else:
                got, n = self.encode(own)
            ids.append(got)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def enter(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers for new ids."""
        first = len(self.off) - 1
        self.ids = np.concatenate([self.ids, ids])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(counts)])
        return np.arange(first, first + len(counts))

    def numbers(self, parts, lead: str) -> np.ndarray:
        """The numbers of an Arrow array of distinct parts, each with lead before it."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(parts, value_set=self.known[lead])
        new = parts.filter(at.is_null())
        out = np.empty(len(parts), np.int64)
        is_new = at.is_null().to_numpy(zero_copy_only=False)
        out[~is_new] = self.number[lead][at.drop_null().to_numpy()]
        if len(new):
            white = pc.or_(pc.match_substring_regex(new, WHITE), pc.equal(new, ""))
            more = np.empty(len(new), np.int64)
            for how, which in ((self.encode_lines, pc.invert(white)), (self.encode, white)):
                more[which.to_numpy(zero_copy_only=False)] = self.enter(*how([lead + x for x in new.filter(which).to_pylist()]))
            out[is_new] = more
            self.known[lead] = pa.concat_arrays([self.known[lead], new])
            self.number[lead] = np.concatenate([self.number[lead], more])
        return out

    def stretch(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array of texts, each followed by end_id, and how many each has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.off) > MOST:
            self.clear()
        wide = pc.match_substring_regex(texts, WIDE_BLANK).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(wide), "", texts)
        split = pc.split_pattern(plain, " ")
        first, sizes = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py(), split.value_lengths().to_numpy()
        coded = split.flatten().dictionary_encode()
        number = self.numbers(coded.dictionary, " ")[coded.indices.to_numpy()]
        heads = coded.take(pa.array(first))
        distinct, inverse = np.unique(heads.indices.to_numpy(), return_inverse=True)
        number[first] = self.numbers(heads.dictionary.take(pa.array(distinct)), "")[inverse]
        if wide.any():
            number[first[wide]] = self.enter(*self.encode(texts.filter(pa.array(wide)).to_pylist()))
        number = np.insert(number, first + sizes, self.enter(np.array([end_id], np.uint32), np.ones(1, np.int64)))
        lens = self.off[number + 1] - self.off[number]
        ends = np.cumsum(lens)
        ids = self.ids[np.repeat(self.off[number] - (ends - lens), lens) + np.arange(int(ends[-1]))]
        return ids, np.diff(ends[np.cumsum(sizes + 1) - 1], prepend=0)


def own_parts(tokenizer: str) -> Parts:
    """The parts that this worker process knows, kept from task to task for one tokenizer."""
    import sys
    import types

    kept = sys.modules.setdefault("lodestone_token_parts", types.ModuleType("lodestone_token_parts"))
    if getattr(kept, "tokenizer", None) != tokenizer:
        kept.tokenizer, kept.parts = tokenizer, Parts(tokenizer)
    return kept.parts


def writer(tokenizer, end_id: int, file_ids: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        parts, held, size, seq = own_parts(tokenizer.value), [], 0, 0

        def file():
            docs, counts, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, seq, len(docs), len(ids), encode_file(docs, counts, ids))], ["part", "seq", "n_docs", "n_ids", "data"])

        for batch in batches:
            docs, texts = batch.column(0).to_numpy(), batch.column(1)
            ends = texts.offsets.to_numpy() if hasattr(texts, "offsets") else np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            at = 0
            while at < len(docs):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + STRETCH, "right")) - 1)
                ids, counts = parts.stretch(texts.slice(at, to - at), end_id)
                held.append((docs[at:to], counts, ids))
                size, at = size + len(ids), to
                if size >= file_ids:
                    yield file()
                    size, seq = 0, seq + 1
                    pa.default_memory_pool().release_unused()
        if held:
            yield file()

    return run


def write_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Files (part, seq, n_docs, n_ids, data) of the ids of docs (doc_id, text), written to the shared folder.

    In the order of part and seq, and inside each, documents ascend by doc_id.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumns({"digest": F.xxhash64("text"), "row": F.monotonically_increasing_id()})  # so that no identifier is too much for a range
    rows = rows.repartitionByRange("doc_id", "digest", "row").sortWithinPartitions("doc_id", "digest", "row").select("doc_id", "text")
    schema = "part long, seq long, n_docs long, n_ids long, data binary"
    return materialize(rows.mapInArrow(writer(tokenizer, end_id, file_ids), schema), "tokens")


def reader(batches):
    import pyarrow as pa

    for batch in batches:
        for k in range(len(batch)):
            part, seq = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            file = File(batch.column(2)[k].as_buffer())
            raw = file.ids().astype("<u4", copy=False)
            ends = np.cumsum(file.counts)
            if len(ends) and int(ends[-1]) != len(raw):
                raise ValueError("the documents do not fit the ids")
            n = len(ends)
            lists = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, ends * 4).astype(np.int32)), pa.py_buffer(raw)])
            doc_ids = pa.array(file.doc_ids, mask=file.doc_ids == NULL_ID)
            yield pa.RecordBatch.from_arrays([pa.repeat(part, n), pa.repeat(seq, n), doc_ids, pa.array(ends - file.counts), pa.array(file.counts), lists], ["part", "seq", "doc_id", "before", "n_tokens", "ids"])


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents of files; ids are little-endian unsigned 32-bit integers, start counts all ids before."""
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    before = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("own"))
    starts = starts.join(parts, "part").select("part", "seq", (F.col("base") + F.col("own")).alias("base"))
    rows = files.select("part", "seq", "data").mapInArrow(reader, "part long, seq long, doc_id long, before long, n_tokens long, ids binary")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")
