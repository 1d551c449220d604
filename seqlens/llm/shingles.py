"""Sets of word shingles of many texts at once, by arrays over their bytes.

A word's hash is a difference of running sums over the bytes before and after it, so a
batch of texts is hashed without a loop over words; shingle hashes fold the hashes of
neighbouring words. Hashes have 64 bits: two different shingles of one pair of documents
count as equal with a probability of about the number of their shingles, squared, in 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at a time; a longer text is hashed in several steps.
STEP = 1 << 20
#: A word of more bytes is hashed by itself.
LONG_WORD = 1000
_FACTOR, _FOLD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(42).integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        powers = np.full(STEP + 1, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, with A-Z in lower case, and the number of each text's first word (one more at the end).

    data: the bytes of the texts one after another; offsets: where each begins, and the end.
    """
    import xxhash

    solid = ~_BLANK[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begin[inner] |= solid[inner]
    last = solid
    last[:-1] &= ~solid[1:] | begin[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    first, out, at = np.searchsorted(starts, offsets), np.empty(len(starts), np.uint64), 0
    up, down = _powers()
    while at < len(starts):
        a = int(starts[at])
        stop = max(int(np.searchsorted(ends, a + STEP, "right")), at + 1)
        s, e = starts[at:stop] - a, ends[at:stop] - a
        if e[-1] <= STEP:
            sums = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum(_BYTE[data[a:a + int(e[-1])]] * up[:int(e[-1])], out=sums[1:])
            out[at:stop] = (sums[e] - sums[s]) * down[s]
        for i in np.flatnonzero(e - s > LONG_WORD).tolist():
            out[at + i] = xxhash.xxh64_intdigest(data[a + s[i]:a + e[i]].tobytes().translate(_LOWER), 42)
        at = stop
    return mixed(out), first


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The set of shingles of every text, as sorted hashes; null counts as empty.

    A text of fewer than ``width`` words, but one at least, has one shingle, all of it.
    """
    column = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2] if len(column) else None
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        stop = max(int(np.searchsorted(offsets, offsets[at] + STEP, "right")) - 1, at + 1)
        words, first = word_hashes(data[offsets[at]:offsets[stop]], offsets[at:stop + 1] - offsets[at])
        n = max(len(words) - width + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for i in range(width):
            rolled = rolled * _FOLD + words[i:i + n]
        rolled = mixed(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a:b - width + 1])
            elif b > a:
                whole = np.full(1, b - a, np.uint64)
                for w in words[a:b]:
                    whole = whole * _FOLD + w
                yield mixed(whole)
            else:
                yield np.zeros(0, np.uint64)
        at = stop
