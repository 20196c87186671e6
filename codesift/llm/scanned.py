"""Hashes of the words of texts, straight from the buffers of an Arrow column.

A word is a run of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased or unchanged.  Its hash is a polynomial over random numbers
of its bytes: prefix sums give that of every word at once, and no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import shipped
from .words import CHUNK_WORDS, Chunk, mix

shipped(__name__)

SLICE = 1 << 21  # bytes hashed at a time, up to the end of a word
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
VALUE = mix(LOWER.astype(np.uint64), 11)  # a random number for each byte, one for both cases of a letter
CASED = mix(np.arange(256, dtype=np.uint64), 11)


class Powers:
    """Powers of the base and of its inverse, modulo 2**64; made once a task."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE)
            self.up, self.down = (np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, b, np.uint64)))
                                  for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


def one_hash(word: bytes) -> int:
    """The hash of one word, plainly."""
    total = sum(int(VALUE[b]) * pow(BASE, i, 1 << 64) for i, b in enumerate(word)) + len(word)
    return int(mix(np.array([total % (1 << 64)], np.uint64), 12)[0])


def _hashes(data: np.ndarray, first: np.ndarray, powers: Powers, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each word of some bytes; ``first`` are the places where a document begins."""
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = first[first > 0] - 1
    ends[last] = inside[last]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers.upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * up, out=sums[1:])
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64), 12), a


def hashed(column: pa.Array, powers: Powers, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after another, and how many each text has; null has none."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, buffer = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffer, np.uint8)[:offsets[-1]] if buffer is not None and len(offsets) else np.empty(0, np.uint8)
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]  # of texts that are not empty
    hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for a, b in _slices(data, int(offsets[0]) if len(offsets) else 0, begin):
        h, at = _hashes(data[a:b], begin[np.searchsorted(begin, a):np.searchsorted(begin, b)] - a, powers, VALUE if lower else CASED)
        hashes.append(h)
        places.append(at + a)
    place = np.concatenate(places)
    return np.concatenate(hashes), np.diff(np.searchsorted(place, offsets)) if len(offsets) else np.empty(0, np.int64)


def _slices(data: np.ndarray, a: int, begin: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of at least SLICE bytes that end where a word cannot go on."""
    while a < len(data):
        b, step = a + SLICE, 1 << 10
        while b < len(data):  # to the next space or the next document
            some = np.flatnonzero(SPACE[data[b:b + step]])
            i = np.searchsorted(begin, b)
            doc = int(begin[i]) if i < len(begin) else len(data)
            found = min(b + int(some[0]) if len(some) else len(data), doc)
            if found <= b + step or b + step >= len(data):
                b = found
                break
            b, step = b + step, 2 * step
        b = min(b, len(data))
        yield a, b
        a = b


def chunks(batch: pa.RecordBatch, powers: Powers, lower: bool, column: str = "text") -> Iterator[Chunk]:
    """The documents of an Arrow batch, some at a time; their texts are not kept.  A document is never cut."""
    texts, begin = batch.column(column), 0
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    while begin < len(texts):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + 6 * CHUNK_WORDS)))
        c = Chunk(list(range(begin, end)))
        h, n = hashed(texts.slice(begin, end - begin), powers, lower)
        c.parts = [h]
        c.close()
        c.n = n
        c.end = np.cumsum(n)
        c.begin = c.end - n
        yield c
        begin = end
