"""Suffix-array dedup: difference-cover blockwise construction.

A byte goes if it lies in a string of `length` bytes (a window) that also
starts in a document with a smaller identifier. Equal windows are neighbours
in the suffix array of all texts. It is built one suffix bucket at a time:

1. Buckets. A window's anchor is its k-gram with the smallest hash (leftmost
   of equals), so equal windows have equal anchors at equal places. All
   suffixes with one anchor are in one shard; inside it, the bucket of a suffix
   is its distance to its anchor. Windows whose anchor occurs in one document
   only cannot repeat; an exchange of anchor hashes finds these first, and only
   the others' text moves on, as segments (runs of windows with one anchor),
   one for equal segments of a block, with the smallest identifier.
2. Cover sample. In each shard the suffixes whose distance from the anchor,
   modulo V, is in the difference cover are ranked once by their middle bytes.
3. A bucket is sorted by the leading 8 bytes; longer ties take the rank of the
   first cover position at most V-1 bytes on, which covers all but the last
   bytes of the window, and then those. All suffixes of a bucket have the same
   residue, so one shift serves all of them. Memory holds one shard's segments,
   the sample's ranks and one bucket's keys.
4. Neighbours with equal keys are equal windows; the smallest identifier of
   each group decides. The keys are bytes and exact ranks, no hashes.

Defined results: null texts are empty; texts shorter than `length` keep
everything; rows with equal identifiers do not remove from each other; a null
identifier is smaller than all others; very long texts count whole; an empty
table gives an empty result; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .blocks import Blocks, pack, shard_slices, unpack
from .common import NULL_ID, materialize, mix

#: Bytes of an anchor's k-gram.
GRAM = 20
#: {1, 2, 4} is a perfect difference cover modulo 7: each difference of two residues is one of two of its members.
V, COVER = 7, (1, 2, 4)
CHUNK = 1 << 18
WORD = 8


def gram_hashes(body: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM (20) bytes from each position."""
    x = body.astype(np.uint64) + np.uint64(1)
    two = mix(x[:-1], x[1:])
    four = mix(two[:-2], two[2:])
    eight = mix(four[:-4], four[4:])
    sixteen = mix(eight[:-8], eight[8:])
    return mix(sixteen[:-4], four[16:])


def segments(body: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first and last window, anchor, its hash, document."""
    n, grams = len(body), length - GRAM + 1
    low = np.uint64((1 << 24) - 1)
    valid = np.ones(max(0, n - length + 1), bool)
    for s, e in zip(off[:-1].tolist(), off[1:].tolist()):
        valid[max(s, e - length + 1) : e] = False
    found = []
    for c in range(0, len(valid), CHUNK):
        d = min(len(valid), c + CHUNK)
        h = gram_hashes(body[c : d + length - 1])
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= grams:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < grams:
            m = np.minimum(m[: len(m) - (grams - width)], m[grams - width :])
        at = (m & low).astype(np.int64)[: d - c]
        ok = valid[c:d]
        new = ok.copy()
        new[1:] &= ~(ok[:-1] & (at[1:] == at[:-1]))
        end = ok.copy()
        end[:-1] &= ~(ok[1:] & (at[1:] == at[:-1]))
        first, last = np.flatnonzero(new), np.flatnonzero(end)
        found.append((first + c, last + c, at[first] + c, h[at[first]]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    first, last, anchor, h = (np.concatenate(x) for x in zip(*found))
    return first, last, anchor, h, np.searchsorted(off, first, "right") - 1


def keyed(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard number in the upper half, 32 bits of the hash in the lower."""
    return (((h >> np.uint64(32)) % np.uint64(shards)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def anchor_runs(length: int):
    def make(ids, off, body, shards):
        *_, h, doc = segments(body, off, length)
        key = keyed(h, shards)
        order = np.lexsort((doc, key))
        key, doc = key[order], ids[doc[order]]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        several = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
        key = key[first]
        for shard, a, b in shard_slices(key >> np.uint64(32)):
            yield shard, key[a:b].astype(np.uint32).tobytes() + np.packbits(several[a:b]).tobytes() + (b - a).to_bytes(4, "little")

    return make


def shared_anchors(bodies: list[bytes]) -> list[bytes]:
    """For each block a bit for each of its keys: does another document have it?"""
    sizes = [int.from_bytes(x[-4:], "little") for x in bodies]
    key = np.concatenate([np.frombuffer(x, np.uint32, n) for x, n in zip(bodies, sizes)])
    own = np.concatenate([np.unpackbits(np.frombuffer(x[4 * n : -4], np.uint8), count=n) for x, n in zip(bodies, sizes)]).astype(bool)
    order = np.argsort(key, kind="stable")
    k, o = key[order], own[order]
    same = k[1:] == k[:-1]
    hit = o.copy()
    hit[1:] |= same
    hit[:-1] |= same
    out = np.empty(len(key), bool)
    out[order] = hit
    return [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]


def chosen(ids, off, body, said, shards, length):
    """The runs whose anchor is shared, and the distinct segments among them.

    Returns first, last, document of each run, its segment; the segments' bytes,
    anchor places, smallest identifiers and shards in the order of the shards.
    """
    first, last, anchor, h, doc = segments(body, off, length)
    key = keyed(h, shards)
    distinct, which = np.unique(key, return_inverse=True)
    flags = np.zeros(len(distinct), bool)
    for shard, a, b in shard_slices(distinct >> np.uint64(32)):
        flags[a:b] = np.unpackbits(np.frombuffer(said[shard], np.uint8), count=b - a)
    pick = np.flatnonzero(flags[which]) if len(which) else np.zeros(0, np.int64)
    pick = pick[np.argsort(key[pick] >> np.uint64(32), kind="stable")]
    first, last, anchor, doc, shard = first[pick], last[pick], anchor[pick], doc[pick], (key[pick] >> np.uint64(32)).astype(np.int64)
    raw, seen, segment = body.tobytes(), {}, np.empty(len(pick), np.int64)
    for i, (a, b) in enumerate(zip(first.tolist(), (last + length).tolist())):
        segment[i] = seen.setdefault(raw[a:b], len(seen))
    least = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(least, segment, ids[doc])
    place, at = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
    place[segment], at[segment] = anchor - first, shard
    return first, last, doc, segment, list(seen), place, least, at


def segment_runs(length: int):
    def make(block, ids, off, body, said, shards):
        *_, texts, place, least, at = chosen(ids, off, body, said.get(1, {}), shards, length)
        out = {"shard": [], "block": [], "body": []}
        for shard, a, b in shard_slices(at):
            lens = np.fromiter(map(len, texts[a:b]), np.uint16, b - a)
            out["shard"].append(shard)
            out["block"].append(block)
            out["body"].append((b - a).to_bytes(4, "little") + pack(lens.tobytes() + place[a:b].astype(np.uint16).tobytes() + least[a:b].tobytes() + b"".join(texts[a:b])))
        return out

    return make


def dense(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorts by keys (first: most significant); the order, and each one's dense rank in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def repeated_windows(length: int):
    """Per block, for each of its segments, a bit for each window: does a smaller identifier have it?"""

    def answer(bodies: list[bytes]) -> list[bytes]:
        lens, place, least, texts, sizes = [], [], [], [], []
        for x in bodies:
            n, raw = int.from_bytes(x[:4], "little"), unpack(x[4:])
            lens.append(np.frombuffer(raw, np.uint16, n))
            place.append(np.frombuffer(raw, np.uint16, n, 2 * n))
            least.append(np.frombuffer(raw, np.int64, n, 4 * n))
            texts.append(raw[12 * n :])
            sizes.append(n)
        lens, place, least = (np.concatenate(x).astype(np.int64) for x in (lens, place, least))
        text = np.frombuffer(b"".join(texts) + bytes(WORD), np.uint8)
        start = np.concatenate([[0], np.cumsum(lens)[:-1]])
        word = np.ndarray((len(text) - WORD + 1,), ">u8", text, strides=(1,))
        anchor, windows = start + place, lens - length + 1
        rank = cover_ranks(word, anchor, place, lens, length)
        bits = np.zeros(len(lens), np.uint64)
        # Window number t of a segment starts place - t bytes before the anchor.
        for back in range(length - GRAM + 1):
            t = place - back
            own = np.flatnonzero((t >= 0) & (t < windows))
            if not len(own):
                continue
            i = anchor[own] - back
            shift = next(d for d in range(V) if (d - back) % V in COVER)
            order, group = dense([word[i].astype(np.uint64), rank[i + shift], word[i + length - WORD].astype(np.uint64)])
            first = np.flatnonzero(np.concatenate([[True], np.diff(group) > 0]))
            smallest = np.minimum.reduceat(least[own[order]], first)[group]
            hit = own[order][smallest < least[own[order]]]
            bits[hit] |= np.uint64(1) << t[hit].astype(np.uint64)
        return [pack(x) for x in np.split(bits, np.cumsum(sizes)[:-1])]

    return answer


def cover_ranks(word, anchor, place, lens, length) -> np.ndarray:
    """Ranks by the middle length - 8 bytes of the suffixes at cover positions."""
    middle = length - WORD
    rank = np.zeros(len(word) + WORD, np.uint32)
    spots = []
    for off in range(-(length - GRAM), GRAM + V):
        if off % V in COVER:
            ok = (off + place >= 0) & (off + place + middle <= lens)
            spots.append(anchor[ok] + off)
    spots = np.concatenate(spots)
    at = [*range(0, middle - WORD, WORD), middle - WORD]
    order, group = dense([word[spots + a].astype(np.uint64) for a in at])
    rank[spots[order]] = group
    return rank


def spans_maker(length: int):
    def make(block, ids, off, body, said, shards):
        import pyarrow as pa

        n = len(body)
        first, last, doc, segment, texts, _, least, at = chosen(ids, off, body, said.get(1, {}), shards, length)
        bits = np.zeros(len(texts), np.uint64)
        for shard, a, b in shard_slices(at):
            bits[a:b] = np.frombuffer(unpack(said[2][shard]), np.uint64)
        change = np.zeros(n + 1, np.int32)
        everything = ids[doc] > least[segment]
        for t in range(length - GRAM + 1):
            hit = (first + t <= last) & (everything | ((bits[segment] >> np.uint64(t)) & np.uint64(1)).astype(bool))
            np.add.at(change, first[hit] + t, 1)
            np.add.at(change, first[hit] + t + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        # Spans end at the ends of documents.
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before, after = np.concatenate([[False], gone])[:n], np.concatenate([gone, [False]])[1 : n + 1]
        a = np.flatnonzero(gone & (~before | edge[:n]))
        b = np.flatnonzero(gone & (~after | edge[1 : n + 1])) + 1
        d = np.searchsorted(off, a, "right") - 1
        counts = np.bincount(d, minlength=len(ids))[: len(ids)]
        lists = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([pa.array(a - off[d]), pa.array(b - off[d])], ["start", "end"]))
        left = np.concatenate([[0], np.cumsum(~gone)])[off].astype(np.int64)
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(left.tobytes()), pa.py_buffer(body[~gone].tobytes())])
        return {"doc_id": pa.array(ids), "n_bytes": pa.array(np.diff(off)), "spans": spans, "kept": kept.cast(pa.binary())}

    return make


def suffix_dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row for each document: doc_id, n_bytes, spans (start and end in bytes) and kept (bytes)."""
    if not GRAM + V <= length <= GRAM + 63 or length < 2 * WORD + V:
        raise ValueError("length must lie between 27 and 83 bytes")
    blocks = Blocks(docs)
    shared = materialize(blocks.answers(blocks.runs(anchor_runs(length)), shared_anchors, 1), "anchors")
    runs = blocks.finish(shared, segment_runs(length), "shard int, block long, body binary")
    repeats = blocks.answers(runs, repeated_windows(length), 2)
    rows = blocks.finish(shared.unionByName(repeats), spans_maker(length), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
