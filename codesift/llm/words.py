"""Words of whole texts as hashes, many documents at a time.

A word is a run of bytes other than space and 0x09 to 0x0D, which is what ``bytes.split()`` gives for UTF-8.
Texts are never cut: a chunk ends after the document that fills it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash

from . import shipped

shipped(__name__)

CHUNK_WORDS = 1 << 18  # words handled at a time; a single longer document makes a chunk of its own
CACHED_WORDS = 1 << 18  # hashes remembered by a task; the memory of a task stays bounded for any vocabulary


class WordHash(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A permutation of the 64-bit numbers (the finaliser of splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k consecutive values; position i stands for h[i:i+k]."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= MULTIPLIER
        out += h[j:j + n]
    return mix(out)


@dataclass
class Chunk:
    """Some documents: their rows, texts, and the hashes of their words one after another."""

    rows: list[int] = field(default_factory=list)  # positions in the Arrow batch
    texts: list[bytes | None] = field(default_factory=list)
    parts: list[np.ndarray] = field(default_factory=list)

    def close(self) -> Chunk:
        self.h = np.concatenate(self.parts) if self.parts else np.empty(0, np.uint64)
        self.n = np.array([len(p) for p in self.parts], np.int64)
        self.end = np.cumsum(self.n)
        self.begin = self.end - self.n
        self.parts = []
        return self

    @property
    def doc(self) -> np.ndarray:
        """Index of the document of each word."""
        return np.repeat(np.arange(len(self.n)), self.n)

    def whole(self, k: int) -> np.ndarray:
        """Whether the window of k words that starts at a position ends in the same document."""
        m = max(0, len(self.h) - k + 1)
        return np.repeat(self.end, self.n)[:m] >= np.arange(m) + k

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per word for each document."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.end] - total[self.begin]


def binary(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def chunks(batch: pa.RecordBatch, cache: WordHash, column: str = "text", lower: bool = False) -> Iterator[Chunk]:
    """The documents of an Arrow batch, some at a time."""
    now, size = Chunk(), 0
    for row, text in enumerate(binary(batch, column)):
        words = (text.lower() if lower else text).split() if text else []
        now.rows.append(row)
        now.texts.append(text)
        now.parts.append(cache.of(words))
        size += len(words)
        if size >= CHUNK_WORDS:
            yield now.close()
            now, size = Chunk(), 0
    if now.rows:
        yield now.close()


def covered(length: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of ``length`` positions lie in the union of the spans."""
    edge = np.bincount(starts, minlength=length + 1) - np.bincount(starts + lengths, minlength=length + 1)
    return np.cumsum(edge[:length]) > 0


def table(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c
                                       for c, f in zip(columns, schema)], schema=schema)
