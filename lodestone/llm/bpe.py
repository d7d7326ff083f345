"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are cut by the tokenizer's pattern. The distinct pieces of a stretch of
documents are merged together: an inverted index leads from each possible
merge to the places where its pair stands, and merges are applied in the order
of their ranks to all their places, leftmost first. Each one only changes the
links and the index entries of its two neighbours. If a merge makes a pair of
lower rank, its piece is merged again alone, where that pair goes first.

Memory holds one stretch of documents and its distinct pieces. Pieces are not
gathered over tasks: their number grows with the corpus, and a join of every
piece with a table of them would shuffle the corpus itself.

The rank file is a parameter. The driver reads it, and executors get its
entries (their number is the vocabulary's, whatever the input) as a broadcast.

Defined results: a null text is empty and has no tokens; rows with equal
identifiers are encoded separately; very long texts are encoded whole; an empty
table gives an empty result; other columns pass through unchanged, but for such
as are called ids or decoded, whose place the results take.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from .common import tidy, whole_text, wider

#: The cut before the merges, as the tokenizers that publish such ranks have it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token, space, rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Replay:
    """Merges pieces of bytes by ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.span = max(ranks.values()) + 1
        raw = [bytes([i]) for i in range(256)]
        self.first = np.array([ranks.get(x + y, -1) for x in raw for y in raw], np.int64)
        # Every pair that merges to a token, sorted.
        get, found = ranks.get, []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                x, y = get(token[:i]), get(token[i:])
                if x is not None and y is not None:
                    found.append((x * self.span + y, rank))
        found.sort()
        self.pair = np.array([k for k, _ in found] or [-1], np.int64)
        self.rank = np.array([r for _, r in found] or [-1], np.int64)

    def merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What pairs merge to, or -1."""
        key = a.astype(np.int64) * self.span + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (a >= 0) & (b >= 0), self.rank[at], -1)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and len + 1 offsets into them. A piece that is a token itself needs no merges."""
        whole = [self.ranks.get(p, -1) for p in pieces]
        parts = [p if token < 0 else b"" for p, token in zip(pieces, whole)]
        # Each piece is followed by a stop, with which nothing merges.
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        n = int(ends[-1]) if len(parts) else 0
        raw = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)
        stop = np.zeros(n, bool)
        stop[ends - 1] = True
        symbol = np.where(stop, -1, self.byte[raw]).astype(np.int32)
        merge = np.full(n + 1, -1, np.int32)
        if n > 1:
            merge[: n - 1] = np.where(stop[:-1] | stop[1:], -1, self.first[raw[:-1].astype(np.int64) * 256 + raw[1:]])
        again = self.replay(symbol, merge, ends)
        symbol[stop] = whole
        kept = symbol >= 0
        off = np.concatenate([[0], np.cumsum(kept)[ends - 1]]).astype(np.int64)
        ids = symbol[kept]
        if len(again):
            lists = np.split(ids, off[1:-1])
            for i in again.tolist():
                lists[i] = np.array(self.alone(pieces[i]), np.int64)
            ids, off = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        return ids, off

    def replay(self, symbol: np.ndarray, merge: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Merges in place. Returns the pieces whose merges would not go in the order of ranks."""
        n = len(symbol)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        # The inverted index: from a merge to the places of its pair.
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            starts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()]
            for a, b, r in zip(starts, [*starts[1:], len(ranks)], ranks[starts].tolist()):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(heap, r)

        live = np.flatnonzero(merge >= 0).astype(np.int32)
        if len(live):
            enter(live, merge[live])
        again: list[np.ndarray] = []
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            i = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            i = i[merge[i] == rank]
            if not len(i):
                continue
            j = after[i]
            if (merge[j] == rank).any():
                # Places that overlap, as in a run of one letter: from the left, each takes its neighbour.
                own, taken = [], set()
                for a, b in zip(i.tolist(), j.tolist()):
                    if a not in taken:
                        own.append(a)
                        taken.add(b)
                i = np.array(own, np.int32)
                j = after[i]
            k = after[j]
            # Where two such pairs adjoin, the first merge alone makes a pair that must not have a lower rank.
            close = merge[k] == rank
            if close.any():
                between = self.merges(np.full(int(close.sum()), rank), symbol[k[close]])
                if ((between >= 0) & (between < rank)).any():
                    again.append(np.searchsorted(ends, i[close][(between >= 0) & (between < rank)], "right"))
            symbol[i] = rank
            symbol[j] = -2
            merge[j] = -1
            after[i] = k
            before[k] = i
            right = self.merges(symbol[i], symbol[np.minimum(k, n - 1)])
            merge[i] = right
            p = before[i]
            left = self.merges(np.where(p >= 0, symbol[p], -1), symbol[i])
            inside = (p >= 0) & (symbol[p] >= 0)
            merge[p[inside]] = left[inside]
            places, found = np.concatenate([i, p]), np.concatenate([right, left])
            good = found >= 0
            if good.any():
                places, found = places[good], found[good]
                low = found < rank
                if low.any():
                    again.append(np.searchsorted(ends, places[low], "right"))
                enter(places, found)
        return np.unique(np.concatenate(again)) if again else np.zeros(0, np.int64)

    def alone(self, piece: bytes) -> list[int]:
        """The ids of one piece: the merge of the lowest rank, leftmost first, by a heap of places."""
        symbol = [int(self.byte[c]) for c in piece] + [-1]
        after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))

        def rank_of(x: int, y: int) -> int:
            at = int(np.searchsorted(self.pair, x * self.span + y))
            return int(self.rank[at]) if x >= 0 and y >= 0 and at < len(self.pair) and self.pair[at] == x * self.span + y else -1

        merge = [rank_of(x, y) for x, y in zip(symbol, symbol[1:])] + [-1]
        heap = [(r, i) for i, r in enumerate(merge) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if merge[i] != r:
                continue
            j = after[i]
            symbol[i], symbol[j], merge[j] = r, -2, -1
            after[i] = after[j]
            before[after[i]] = i
            for p in (before[i], i):
                if p >= 0 and symbol[p] >= 0:
                    merge[p] = rank_of(symbol[p], symbol[after[p]])
                    if merge[p] >= 0:
                        heapq.heappush(heap, (merge[p], p))
        return [s for s in symbol if s >= 0]


def encoder(ranks, pattern: str, text_at: int, stretch: int, decoded: bool):
    def run(batches):
        import pyarrow as pa
        import regex

        replay, cut = Replay(ranks.value), regex.compile(pattern).findall
        token = token_table(ranks.value).__getitem__
        for batch in batches:
            texts, at = batch.column(text_at), 0
            while at < len(texts):
                # The pieces of a stretch of documents are numbered as they come up.
                number: dict = defaultdict()
                number.default_factory = number.__len__
                start, docs, size = at, [], 0
                while at < len(texts) and (not docs or size < stretch):
                    text = texts[at].as_py() or ""
                    size += len(text)
                    found = cut(text)
                    docs.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                    at += 1
                known, off = replay.encode([p.encode() for p in number])
                known, lens = known.astype(np.int32), np.diff(off)
                del number
                ids, counts, raw = [], [], []
                for d in docs:
                    n = lens[d]
                    total = int(n.sum())
                    first = np.cumsum(n) - n
                    got = known[np.repeat(off[d] - first, n) + np.arange(total)]
                    ids.append(got)
                    counts.append(total)
                    if decoded:
                        raw.append(b"".join(map(token, got.tolist())))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.concatenate(ids)))
                part = batch.slice(start, at - start)
                kept = [c for i, c in enumerate(part.columns) if i != text_at]
                names = [c for i, c in enumerate(part.schema.names) if i != text_at]
                more = [pa.array(raw, pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([*kept, lists, *more], [*names, "ids", *["decoded"] * decoded])

    return run


def token_table(ranks: dict[bytes, int]) -> list[bytes | None]:
    """The bytes of each id."""
    known = {v: k for k, v in ranks.items()}
    return [known.get(i) for i in range(max(known) + 1)]


def encode(docs: DataFrame, path: str, pattern: str = PATTERN, stretch: int = 4 << 20, decoded: bool = False) -> DataFrame:
    """The rows of docs with `ids` (array of int) in the place of `text`; with `decoded`, also the bytes that the ids decode to.

    stretch: characters of the documents whose pieces are merged together.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    names = [c for c in docs.columns if c not in ("text", "ids", "decoded")]
    rows = docs.select(*names, whole_text().alias("text"))
    schema = wider(docs.select(*names), ("ids", ArrayType(IntegerType())), *[("decoded", BinaryType())] * decoded)
    return rows.mapInArrow(tidy(encoder(ranks, pattern, len(names), stretch, decoded)), schema)


def decoder(ranks, at: int):
    def run(batches):
        import pyarrow as pa

        token = token_table(ranks.value).__getitem__
        for batch in batches:
            lists = batch.column(at)
            raw = [b"".join(map(token, lists[i].values.to_numpy().tolist())) if lists[i].is_valid else None for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded` (bytes) to rows that have `ids`."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    rows = encoded.drop("decoded")
    return rows.mapInArrow(tidy(decoder(ranks, rows.columns.index("ids"))), wider(rows, ("decoded", BinaryType())))


def digest_columns(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of decoded rows."""
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
