"""Quality rules by repetition inside a document, found with a suffix array over its words.

Suffixes of many documents are ordered together by prefix doubling on numbers; the document is part of the
first rank, so suffixes of different documents are never equal.  The longest common prefix of neighbours gives
the intervals whose common prefix is a repeated substring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shipped
from .words import Chunk, WordHash, chunks, covered, mix

shipped(__name__)


@dataclass(frozen=True)
class Limits:
    """Production parameters.

    A repeat counts from ``min_repeat`` words.  A text is rejected when its repeats cover more than
    ``max_covered_percent`` of its words or when a single one is longer than ``max_longest`` words.
    """

    min_words: int = 50
    max_window_percent: int = 50
    min_repeat: int = 8
    max_covered_percent: int = 50
    max_longest: int = 50


@dataclass
class Suffixes:
    """Suffix array of a chunk, the common prefix of neighbours, and the longest repeat that starts at each word."""

    order: np.ndarray
    lcp: np.ndarray  # lcp[k] of order[k - 1] and order[k]; lcp[0] is 0
    longest: np.ndarray


def suffixes(chunk: Chunk) -> Suffixes:
    n = len(chunk.h)
    if n == 0:
        none = np.empty(0, np.int64)
        return Suffixes(none, none, none)
    doc, stop = chunk.doc, np.repeat(chunk.end, chunk.n)
    order, rank = _ranked(mix(chunk.h ^ mix(doc.astype(np.uint64))), np.arange(n))
    ranks, length = [rank], 1
    size = np.bincount(rank, minlength=n)
    open_ = np.flatnonzero(size[rank] > 1)
    while len(open_):
        # second half of the prefix: the rank of what follows; the end of a document precedes everything
        after = open_ + length
        follow = np.where(after < stop[open_], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[open_] * np.int64(n + 1) + follow
        by = np.argsort(key, kind="stable")
        sorted_key, base = key[by], rank[open_][by]
        new_group = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        new_base = np.concatenate([[True], base[1:] != base[:-1]])
        at = np.arange(len(by))
        first = np.maximum.accumulate(np.where(new_base, at, 0))  # where the old group begins in this list
        group = np.maximum.accumulate(np.where(new_group, at, 0))
        moved = open_[by]
        order[base + (at - first)] = moved
        rank = rank.copy()
        rank[moved] = base + (group - first)
        ranks.append(rank)
        length *= 2
        alone = new_group & np.concatenate([new_group[1:], [True]])
        open_ = np.sort(moved[~alone])
    # common prefix of neighbours, by the binary digits of its length
    a, b = order[:-1], order[1:]
    pair = np.flatnonzero((doc[a] == doc[b]) & (ranks[0][a] == ranks[0][b]))
    x, y, common = a[pair], b[pair], np.zeros(len(pair), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        r, p, q = ranks[level], x + common, y + common
        same = (p < stop[x]) & (q < stop[y])
        same &= r[np.minimum(p, n - 1)] == r[np.minimum(q, n - 1)]
        common += same * (1 << level)
    lcp = np.zeros(n, np.int64)
    lcp[pair + 1] = common
    longest = np.empty(n, np.int64)
    longest[order] = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
    return Suffixes(order, lcp, longest)


def _ranked(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = at[np.argsort(key, kind="stable")]
    k = key[order]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), np.arange(len(k)), 0))
    rank = np.empty(len(key), np.int64)
    rank[order] = first
    return order, rank


def maximal_repeats(chunk: Chunk, s: Suffixes, least: int) -> list[tuple[int, int, int]]:
    """Intervals (low, high, length) of the suffix array whose common prefix is a maximal repeated substring.

    Such a prefix of at least ``least`` words occurs at order[low..high], cannot be made longer to the right
    (the interval is that of its length), nor to the left (the words before differ).
    """
    before = np.where(s.order > np.repeat(chunk.begin, chunk.n)[s.order], chunk.h[s.order - 1], s.order.astype(np.uint64))
    differs = np.concatenate([[0], np.cumsum(np.concatenate([[0], before[1:] != before[:-1]]))])
    starts_text = s.order == np.repeat(chunk.begin, chunk.n)[s.order]
    edges = np.concatenate([[0], np.cumsum(starts_text)])

    def diverse(low: int, high: int) -> bool:
        return bool(differs[high + 1] > differs[low + 1] or edges[high + 1] > edges[low])

    found = []
    hot = s.lcp >= least
    runs = np.flatnonzero(np.diff(np.concatenate([[0], hot.astype(np.int8), [0]])))
    for begin, end in zip(runs[::2].tolist(), runs[1::2].tolist()):
        stack: list[list[int]] = []  # [length, low]
        for k in range(begin, end + 1):
            value = int(s.lcp[k]) if k < end else 0
            low = k - 1
            while stack and stack[-1][0] > value:
                length, low = stack.pop()
                if diverse(low, k - 1):
                    found.append((low, k - 1, length))
            if value and (not stack or stack[-1][0] < value):
                stack.append([value, low])
    return found


def repeat_cover(chunk: Chunk, s: Suffixes, least: int) -> np.ndarray:
    """Words inside the union of all repeats of at least ``least`` words.

    The longest repeat that starts at a word is the longest maximal repeat there or a tail of one, so the union
    over words is the union over the maximal repeats and their occurrences.
    """
    at = np.flatnonzero(s.longest >= least)
    return covered(len(chunk.h), at, s.longest[at])


# ---- decisions -------------------------------------------------------------------
NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "n_covered", "longest_repeat")
DECISIONS = f"doc_id long, {', '.join(f'{n} long' for n in NUMBERS)}, base_failed boolean, kept boolean"

WORD_START, SYMBOL = np.ones(256, np.int8), np.zeros(256, np.int8)
WORD_START[[32, *range(9, 14), *range(0x80, 0xC0)]] = 0  # white space and the later bytes of a character
SYMBOL[list(b"#*$%&|<>")] = 1


def repeated_lines(text: bytes | None) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in (text or b"").split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measure(chunk: Chunk, limits: Limits) -> dict[str, np.ndarray]:
    """Figures and decisions of each document of a chunk."""
    s = suffixes(chunk)
    texts = [t or b"" for t in chunk.texts]
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    begin = np.concatenate([[0], end[:-1]])

    def of_bytes(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        return total[end] - total[begin]

    longest, repeats = np.zeros(len(chunk.n), np.int64), np.zeros(len(chunk.n), np.int64)
    full = chunk.n > 0
    if full.any():
        longest[full] = np.maximum.reduceat(s.longest, chunk.begin[full])
        doc = chunk.doc
        found = [doc[s.order[low]] for low, _, _ in maximal_repeats(chunk, s, limits.min_repeat)]
        repeats += np.bincount(found, minlength=len(chunk.n)).astype(np.int64) if found else 0
    out = dict(zip(NUMBERS, (
        chunk.n, of_bytes(WORD_START), of_bytes(SYMBOL), np.array([repeated_lines(t) for t in texts], np.int64),
        chunk.sums(covered(len(chunk.h), np.flatnonzero(s.longest >= 3), 3)), repeats,
        chunk.sums(repeat_cover(chunk, s, limits.min_repeat)), longest)))
    out["base_failed"] = (chunk.n < limits.min_words) | (100 * out["n_repeat_words"] > limits.max_window_percent * chunk.n)
    out["kept"] = ~(out["base_failed"] | (100 * out["n_covered"] > limits.max_covered_percent * chunk.n)
                    | (longest > limits.max_longest))
    return out


def decisions(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """docs(doc_id, text) -> one row per document with its figures and the verdict; other columns are not read.

    Null and empty texts have no words and fail the base rule.  Repeated rows are judged each; a null doc_id is
    carried through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for c in chunks(batch, cache):
                out = measure(c, limits)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(c.rows)), *map(pa.array, out.values())],
                                                 names=["doc_id", *out])

    return docs.select("doc_id", "text").mapInArrow(run, DECISIONS)


def passing(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs, with all their columns, whose text is kept; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            keep = [measure(c, limits)["kept"] for c in chunks(batch, cache)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def repeats(docs: DataFrame, least: int = Limits.min_repeat) -> DataFrame:
    """docs(doc_id, text) -> a row per occurrence of a maximal repeated substring: doc_id, repeat, start, length.

    start and length count words; repeat numbers the substrings of a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for c in chunks(batch, cache):
                s, doc, rows = suffixes(c), c.doc, []
                for number, (low, high, length) in enumerate(maximal_repeats(c, s, least)):
                    for at in sorted(s.order[low:high + 1].tolist()):
                        d = doc[at]
                        rows.append((ids[c.rows[d]], number, at - int(c.begin[d]), length))
                columns = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns],
                                                 names=["doc_id", "repeat", "start", "length"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, repeat long, start long, length long")
