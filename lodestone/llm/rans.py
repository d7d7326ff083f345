"""A file of token ids under a static range asymmetric numeral system.

A file holds whole documents. Its blocks share one table of frequencies, which
add up to 1 << SCALE; each block is coded by itself in LANES interleaved
states, so that blocks decode in parallel and each step is one array operation
over all lanes. Inside a block, checkpoints hold all states and the place in
the stream every EVERY rows: decoding can start at any of them. Each block has
checksums of its payload and of its ids.

Layout, all little-endian: MAGIC; the header (ids, documents, symbols, blocks,
bytes of the documents' part, bytes of the table's part) and a checksum of it and
of all up to the payloads; the documents (identifiers as int64, then numbers of
ids as uint64) and the table (symbols, then frequencies as uint32), both
deflated; a record for each block (its place among the blocks' bytes, ids,
lanes, words, checkpoints, checksum of the payload, checksum of the ids); the
payloads: checkpoints (row, words before it, states), then words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TOKRANS1"
HEADER = "<QQIIII"
RECORD = np.dtype([("at", "<u8"), ("ids", "<u4"), ("lanes", "<u4"), ("words", "<u4"), ("marks", "<u4"), ("crc", "<u4"), ("ids_crc", "<u4")])
SCALE = 20
LANES = 1024
EVERY = 256
BLOCK = 1 << 20
#: States lie in [LOW, LOW << 32); a state that would leave it gives or takes one word of 32 bits.
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)


class Broken(ValueError):
    """A file whose checksums or sizes do not fit."""


class Table:
    """Frequencies of the symbols of a file."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype(np.uint32), freq.astype(np.uint64)
        self.below = np.cumsum(self.freq) - self.freq

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        """The table of all ids: each symbol gets its share of 1 << SCALE, 1 at least."""
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        whole = 1 << SCALE
        if len(symbols) > whole:
            raise ValueError(f"more than {whole} symbols")
        counts = counts[symbols]
        freq = np.maximum(1, counts * (whole / max(1, counts.sum()))).astype(np.int64)
        over = int(freq.sum()) - whole
        if over > 0:  # taken from all in proportion to what each has above 1, the rest from the largest
            freq -= (freq - 1) * over // max(1, int((freq - 1).sum()))
        largest = np.argsort(-freq, kind="stable")
        while len(symbols) and (over := int(freq.sum()) - whole):
            if over < 0:
                freq[largest[0]] -= over
            else:
                own = largest[freq[largest] > 1][:over]
                freq[own] -= 1
        return cls(symbols, freq)

    def lookup(self) -> np.ndarray:
        """The place of the symbol of each slot."""
        return np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freq.astype(np.int64))


def lanes_for(n: int) -> int:
    return max(1, min(LANES, n // EVERY))


def encode_block(ids: np.ndarray, table: Table, place: np.ndarray) -> tuple[bytes, tuple]:
    """The payload and its record. place: the place of each id in the table."""
    n = len(ids)
    lanes = lanes_for(n)
    at = place[ids]
    freq, below = table.freq[at], table.below[at]
    limit = freq << np.uint64(63 - SCALE)
    scale, x, given, marks, out = np.uint64(SCALE), np.full(lanes, LOW), 0, [], []
    for row in range(-(-n // lanes) - 1, -1, -1):
        own = slice(row * lanes, min(n, (row + 1) * lanes))
        f = freq[own]
        s = x[: len(f)]
        over = np.flatnonzero(s >= limit[own])
        if len(over):
            full = s[over]
            out.append(full.astype(np.uint32))
            given += len(over)
            s[over] = full >> WORD
        q = s // f
        s[:] = (q << scale) + (s - q * f) + below[own]
        if row % EVERY == 0:
            marks.append((row, given, x.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    parts = [struct.pack("<II", row, given - had) + states.astype("<u8").tobytes() for row, had, states in reversed(marks)]
    payload = b"".join([*parts, words.astype("<u4").tobytes()])
    return payload, (n, lanes, len(words), len(marks), zlib.crc32(payload), zlib.crc32(ids.astype("<u4")))


def encode_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """Documents doc_ids, of which each has so many of the ids in turn, as one file."""
    table = Table.of(ids)
    place = np.zeros(int(table.symbols[-1]) + 1 if len(table.symbols) else 0, np.uint32)
    place[table.symbols] = np.arange(len(table.symbols))
    payloads, records, at = [], np.zeros(-(-len(ids) // BLOCK), RECORD), 0
    for k in range(len(records)):
        payload, record = encode_block(ids[k * BLOCK : (k + 1) * BLOCK], table, place)
        records[k] = (at, *record)
        payloads.append(payload)
        at += len(payload)
    docs = zlib.compress(doc_ids.astype("<i8").tobytes() + counts.astype("<u8").tobytes(), 1)
    shape = zlib.compress(table.symbols.astype("<u4").tobytes() + table.freq.astype("<u4").tobytes(), 1)
    front = docs + shape + records.tobytes()
    header = struct.pack(HEADER, len(ids), len(doc_ids), len(table.symbols), len(records), len(docs), len(shape))
    return b"".join([MAGIC, header, struct.pack("<I", zlib.crc32(header + front)), front, *payloads])


class File:
    """A file that is read: documents, and the ids of all or some blocks."""

    def __init__(self, data):
        self.data = memoryview(data)
        head = len(MAGIC) + struct.calcsize(HEADER)
        at = head + 4
        if len(data) < at or self.data[: len(MAGIC)] != MAGIC:
            raise Broken("not a file of token ids")
        self.n_ids, n_docs, n_symbols, n_blocks, docs, shape = struct.unpack_from(HEADER, self.data, len(MAGIC))
        self.body = at + docs + shape + n_blocks * RECORD.itemsize
        if self.body > len(data) or zlib.crc32(self.data[at : self.body], zlib.crc32(self.data[len(MAGIC) : head])) != struct.unpack_from("<I", self.data, head)[0]:
            raise Broken("the front part is damaged")
        raw = zlib.decompress(self.data[at : at + docs])
        self.doc_ids, self.counts = np.frombuffer(raw, "<i8", n_docs), np.frombuffer(raw, "<u8", n_docs, n_docs * 8).astype(np.int64)
        raw = zlib.decompress(self.data[at + docs : at + docs + shape])
        self.table = Table(np.frombuffer(raw, "<u4", n_symbols), np.frombuffer(raw, "<u4", n_symbols, n_symbols * 4))
        self.records = np.frombuffer(self.data, RECORD, n_blocks, at + docs + shape)
        self.slots = self.table.lookup()

    def payload(self, k: int) -> memoryview:
        r = self.records[k]
        size = int(r["marks"]) * (8 + 8 * int(r["lanes"])) + 4 * int(r["words"])
        start = self.body + int(r["at"])
        part = self.data[start : start + size]
        if len(part) != size or zlib.crc32(part) != r["crc"]:
            raise Broken(f"block {k} is damaged")
        return part

    def segment(self, k: int, mark: int, payload: memoryview | None = None) -> np.ndarray:
        """The ids of block k from one checkpoint to the next."""
        payload = self.payload(k) if payload is None else payload
        r = self.records[k]
        n, lanes, marks = int(r["ids"]), int(r["lanes"]), int(r["marks"])
        size = 8 + 8 * lanes
        row, p = struct.unpack_from("<II", payload, mark * size)
        last = struct.unpack_from("<I", payload, (mark + 1) * size)[0] if mark + 1 < marks else -(-n // lanes)
        x = np.frombuffer(payload, "<u8", lanes, mark * size + 8).copy()
        words = np.frombuffer(payload, "<u4", int(r["words"]), marks * size)
        freq, below, slots, scale, low_bits = self.table.freq, self.table.below, self.slots, np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
        out = np.empty(min(n, last * lanes) - row * lanes, np.uint32)
        for at in range(0, len(out), lanes):
            s = x[: min(lanes, len(out) - at)]
            slot = s & low_bits
            symbol = slots[slot]
            out[at : at + lanes] = symbol
            s >>= scale
            s *= freq[symbol]
            s += slot
            s -= below[symbol]
            low = np.flatnonzero(s < LOW)
            if len(low):
                s[low] = (s[low] << WORD) | words[p : p + len(low)]
                p += len(low)
        return self.table.symbols[out]

    def block(self, k: int) -> np.ndarray:
        payload = self.payload(k)
        ids = np.concatenate([self.segment(k, m, payload) for m in range(int(self.records[k]["marks"]))])
        if zlib.crc32(ids.astype("<u4")) != self.records[k]["ids_crc"]:
            raise Broken(f"block {k} decodes to other ids")
        return ids

    def ids(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *map(self.block, range(len(self.records)))])
