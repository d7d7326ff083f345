"""Words of many texts at once: places and 64-bit hashes, in array operations.

A word is a run of bytes other than white space (space and \\t to \\r), with
A-Z in lower case. Its hash is the sum of a random 64-bit value for each byte
times a power of an odd base, modulo 2**64, mixed with the length. Words longer
than LONG bytes are hashed by xxh3 instead.
"""

from __future__ import annotations

import numpy as np

from .common import mix

LONG = 1 << 12
CHUNK = 1 << 19
BASE = np.uint64(0x9FB21C651E98DF25)
INVERSE = np.uint64(pow(0x9FB21C651E98DF25, -1, 2**64))
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
VALUE = np.random.default_rng(0xB1B).integers(1, 2**64, 256, np.uint64)[LOWER]


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words_of(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word in turn, and the number of words of each text."""
    n, texts = len(body), len(off) - 1
    solid = ~SPACE[body]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], solid[:-1]])[:n]
    start = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.concatenate([solid[1:], [False]])[:n]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(start, off)) if texts else np.zeros(0, np.int64)
    length = end - start
    out = np.empty(len(start), np.uint64)
    up, down = powers(BASE, CHUNK + LONG + 1), powers(INVERSE, CHUNK + LONG + 1)
    long = np.flatnonzero(length > LONG)
    short = length <= LONG
    # Chunks of words that start inside CHUNK bytes.
    cuts = np.searchsorted(start, np.arange(0, n + CHUNK, CHUNK))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = np.flatnonzero(short[a:b]) + a
        if not len(own):
            continue
        s, e = start[own], end[own]
        part = body[s[0] : e[-1]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUE[part] * up[: len(part)])])
        out[own] = (sums[e - s[0]] - sums[s - s[0]]) * down[s - s[0]]
    if len(long):
        import xxhash

        for i in long.tolist():
            out[i] = xxhash.xxh3_64_intdigest(LOWER[body[start[i] : end[i]]].tobytes())
    return mix(out, length.astype(np.uint64)), counts
