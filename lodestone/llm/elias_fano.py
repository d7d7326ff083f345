"""Elias-Fano sequences, and an n-gram level made of them.

A level holds, for each context, its successors. Their hashes are stored in the
order of the contexts, as one monotone sequence (context << SUCCESSOR_BITS |
successor): low bits packed, high bits in unary. The pointers from contexts to
their first successor are a second monotone sequence. A level is one buffer,
which can be written to a file and mapped into memory.
"""

from __future__ import annotations

import mmap

import numpy as np

SUCCESSOR_BITS = 40
#: Log10 steps of a quantised probability: code 0 is "not there", codes 1 to 255 lie between 10**-floor and 1.
FLOOR = 8.0


def floor_of(*probabilities: np.ndarray) -> float:
    """The floor of a level: FLOOR, or what its smallest probability needs, so that none is raised."""
    low = min((float(p[p > 0].min()) for p in probabilities if (p > 0).any()), default=1.0)
    return float(max(FLOOR, np.ceil(-np.log10(low))))


def quantise(p: np.ndarray, floor: float = FLOOR) -> np.ndarray:
    with np.errstate(divide="ignore"):
        x = np.log10(p)
    return np.where(p > 0, 1 + np.rint((1 + np.maximum(x, -floor) / floor) * 254), 0).astype(np.uint8)


def restore(code: np.ndarray, floor: float = FLOOR) -> np.ndarray:
    table = np.concatenate([[0.0], 10.0 ** ((np.arange(255) / 254 - 1) * floor)])
    return table[code]


class Sequence:
    """A non-decreasing sequence of unsigned integers below 2**63."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        bits = np.unpackbits(high)
        self.zeros = np.flatnonzero(bits == 0)
        self.word = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))

    @classmethod
    def of(cls, values: np.ndarray) -> Sequence:
        """Low parts are whole bytes, as many as the optimum rounded to bytes."""
        values = np.ascontiguousarray(values, "<u8")
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        size = round(max(0, (top // max(1, n)).bit_length() - 1) / 8)
        while (top >> (8 * size)) > 64 * n + 1024:
            size += 1
        low = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :size]).ravel()
        high = (values >> np.uint64(8 * size)).astype(np.int64)
        unary = np.zeros((int(high[-1]) + 1 if n else 0) + n + 1, np.uint8)
        unary[high + np.arange(n)] = 1
        return cls(n, 8 * size, np.concatenate([low, np.zeros(8, np.uint8)]), np.packbits(unary))

    def low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        return self.word[i * (self.low_bits >> 3)] & np.uint64((1 << self.low_bits) - 1)

    def bounds(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first index with these high bits, and the one past the last."""
        h = np.minimum(high, len(self.zeros) - 1)
        end = self.zeros[h] - h
        start = np.where(h > 0, self.zeros[h - 1] - (h - 1), 0)
        return np.minimum(start, self.n), np.where(high == h, np.minimum(end, self.n), np.minimum(start, self.n))

    def find(self, values: np.ndarray, first: np.ndarray | None = None, end_at: np.ndarray | None = None) -> np.ndarray:
        """The first index of each value, or -1: binary search among the elements that share its high bits,
        and, if they are given, lie between first and end_at."""
        values = values.astype(np.uint64)
        want = values & np.uint64((1 << self.low_bits) - 1)
        i, end = self.bounds((values >> np.uint64(self.low_bits)).astype(np.int64))
        if first is not None:
            i, end = np.maximum(i, first), np.minimum(end, end_at)
        i, last = i.copy(), end.copy()
        live = np.flatnonzero(i < end)
        while len(live):
            middle = (i[live] + end[live]) >> 1
            less = self.low_at(middle) < want[live]
            i[live[less]] = middle[less] + 1
            end[live[~less]] = middle[~less]
            live = live[i[live] < end[live]]
        there = i < last
        there[there] = self.low_at(i[there]) == want[there]
        return np.where(there, i, -1)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self.low_at(np.arange(self.n))

    def dump(self) -> bytes:
        return np.array([self.n, self.low_bits, len(self.low), len(self.high)], np.int64).tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def load(cls, buffer, at: int = 0) -> tuple[Sequence, int]:
        n, bits, a, b = np.frombuffer(buffer, np.int64, 4, at).tolist()
        at += 32
        return cls(n, bits, np.frombuffer(buffer, np.uint8, a, at), np.frombuffer(buffer, np.uint8, b, at + a)), at + a + b


class Level:
    """Successors of contexts, with a quantised probability for each."""

    def __init__(self, buffer):
        self.buffer = buffer
        self.successors, at = Sequence.load(buffer)
        self.pointers, at = Sequence.load(buffer, at)
        self.floor = float(np.frombuffer(buffer, np.float64, 1, at)[0])
        self.codes = np.frombuffer(buffer, np.uint8, self.successors.n, at + 8)
        self.first = self.pointers.values().astype(np.int64)

    @staticmethod
    def build(context: np.ndarray, successor: np.ndarray, contexts: int, probability: np.ndarray, floor: float = FLOOR) -> bytes:
        """context, successor: sorted; contexts: their number; floor: see floor_of."""
        keys = (context.astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successor.astype(np.uint64)
        first = np.searchsorted(context, np.arange(contexts + 1))
        return Sequence.of(keys).dump() + Sequence.of(first).dump() + np.float64(floor).tobytes() + quantise(probability, floor).tobytes()

    @classmethod
    def mapped(cls, data: bytes) -> Level:
        """Over an anonymous memory map; a file's map serves as well."""
        place = mmap.mmap(-1, max(1, len(data)))
        place[: len(data)] = data
        return cls(place)

    def look_up(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The probabilities' codes; 0 where the context doesn't have the successor.

        The pointers give a context's range, and the successor is searched inside it.
        """
        c = context.astype(np.int64)
        at = self.successors.find((context.astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successor.astype(np.uint64), self.first[c], self.first[c + 1])
        return np.where(at >= 0, self.codes[np.maximum(at, 0)] if len(self.codes) else 0, 0).astype(np.uint8)
