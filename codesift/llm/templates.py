"""Benchmark decontamination by template windows: the same question with other numbers, names or units is found.

Texts become templates: numbers, units and names are typed placeholders, every other word is its lower-case form
without outer punctuation.  Windows of templates are joined by hash; a window counts when its placeholders stand for
the same things throughout the window.  Windows of the plain words are joined beside them, so that a verbatim copy is
found however few literals it has and whatever its words were taken for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import shipped
from .store import Workspace
from .words import CHUNK_WORDS, binary, mix, windows

shipped(__name__)

# production parameters
WINDOW = 10
LEAST_LITERALS = 5  # a window of placeholders alone says nothing; windows of plain words have no such limit
BROADCAST_WINDOWS = 1_000_000  # up to so many benchmark windows (8 MB) reach every task; more are joined by shuffle

# fixed values: words that are numbers or units
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
                "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million").split()
UNIT_WORDS = ("mm cm m km inch inches foot feet yard yards mile miles g kg mg lb lbs pound pounds ounce ounces ton tons l ml "
              "liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years "
              "s min h cent cents dollar dollars euro euros usd eur percent degree degrees celsius km/h mph").split()

LITERAL, NUMBER, UNIT, NAME, NOTHING = range(5)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|[a-z]{1,3})?")
_OUTER = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_LETTER = re.compile(r"\w")
TYPED, PLAIN, MERGED, FREE = range(4)  # ways to read a text; windows meet only those of their own way
BREAK = b"\x00"
NUMBER_BYTES, UNIT_BYTES = ({w.encode() for w in words} for words in (NUMBER_WORDS, UNIT_WORDS))
VOCABULARY = 1 << 19  # words remembered by a task


class Vocabulary(dict):
    """Number of each word, with its placeholder, hash, and whether it may be a name, ends a sentence, or is a number word."""

    CAP, ENDS, SPELLED = 8, 16, 32  # flags beside the kind

    def __init__(self) -> None:
        self.flags, self.hash = np.zeros(1 << 12, np.uint8), np.zeros(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        i = len(self)
        if i >= len(self.flags):
            self.flags, self.hash = (np.concatenate([x, np.zeros_like(x)]) for x in (self.flags, self.hash))
        if word.isalpha() and word.islower():  # plain ASCII
            self.flags[i] = NUMBER + self.SPELLED if word in NUMBER_BYTES else UNIT if word in UNIT_BYTES else LITERAL
            self.hash[i] = xxhash.xxh3_64_intdigest(word)
        else:
            text = word.decode("utf-8", "replace")
            core = _OUTER.sub("", text)
            low = core.lower()
            kind = (NOTHING if not _LETTER.search(core) else NUMBER if _NUMBER.fullmatch(low) or low in NUMBER_WORDS
                    else UNIT if low in UNIT_WORDS else LITERAL)
            cap = core[:1].isupper() and core[1:].islower()
            ends = word == BREAK or text.rstrip("\"')]}»”’*#$%&").endswith((".", "!", "?", ":"))
            self.flags[i] = kind + self.CAP * cap + self.ENDS * ends + self.SPELLED * (low in NUMBER_WORDS)
            self.hash[i] = xxhash.xxh3_64_intdigest(low.encode("utf-8", "replace"))
        self[word] = i
        return i


def template(kind: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template words: hash, slot value (0 for literals), literal or not."""
    literal = kind == LITERAL
    return np.where(literal, value, mix(kind.astype(np.uint64), 9)), np.where(literal, np.uint64(0), value | np.uint64(1)), literal


def merged(kind: np.ndarray, value: np.ndarray, started: np.ndarray, spelled: np.ndarray, at: np.ndarray) -> tuple:
    """``template`` with neighbouring names of a sentence as one word, likewise a number and the number words behind it; and the places."""
    goes_on = np.zeros(len(kind), bool)
    goes_on[1:] = (kind[1:] == kind[:-1]) & ((kind[1:] == NAME) | spelled[1:]) & ~started[1:]
    head = np.flatnonzero(~goes_on)
    if len(head) < len(kind):
        place = np.arange(len(kind)) - np.repeat(head, np.diff(np.append(head, len(kind))))
        value = np.add.reduceat(np.where(place == 0, value, mix(value + mix(place.astype(np.uint64), 5), 7)), head)
    return *template(kind[head], value), at[head]


def readings(ids: np.ndarray, begins: np.ndarray, v: Vocabulary) -> Iterator[tuple]:
    """The ways to read texts one after another: number, then hash, slot value, literal or not, and place in ids of each word.

    ``begins`` tells the first word of each text.  TYPED: a name is a capitalised word that does not begin a sentence:
    since the last word before it nothing, be it that word, punctuation or a line end, has ended one.  MERGED: as
    before, with runs of names and of number words as one.  FREE: every capitalised word is a name, wherever it stands,
    and runs are one.  So a renamed person may begin a sentence, and typing does not depend on what stands before.
    PLAIN: words are all literals, without slots.
    """
    flags = v.flags[ids]
    kind = flags & 7
    at = np.flatnonzero(kind != NOTHING)
    ended = np.cumsum((flags & v.ENDS) != 0)
    ended = np.concatenate([[0], ended])  # ended[i]: ends before place i
    started = np.ones(len(at), bool)
    started[1:] = ended[at[1:]] > ended[at[:-1]]
    started |= np.concatenate([[True], np.cumsum(begins)[at[1:]] > np.cumsum(begins)[at[:-1]]])[:len(at)]
    kind, flags, value = kind[at], flags[at], v.hash[ids[at]]
    spelled, capital = (flags & v.SPELLED) != 0, (kind == LITERAL) & ((flags & v.CAP) != 0)
    typed = np.where(capital & ~started, np.uint8(NAME), kind)
    yield TYPED, *template(typed, value), at
    yield PLAIN, value, None, np.ones(len(at), bool), at
    yield MERGED, *merged(typed, value, started, spelled, at)
    yield FREE, *merged(np.where(capital, np.uint8(NAME), kind), value, started, spelled, at)


def template_windows(t: np.ndarray, literal: np.ndarray, end: np.ndarray, k: int, reading: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of k template words, and which lie in one text (that ends at ``end``) with enough literals."""
    w = mix(windows(t, k), k + (WINDOW + 1) * reading)
    many = np.concatenate([[0], np.cumsum(literal)])
    n = len(w)
    return w, (many[k:k + n] - many[:n] >= (0 if reading == PLAIN else min(LEAST_LITERALS, k))) & (end[:n] >= np.arange(n) + k)


ROW = "id long, reading int, k int, window long, place long, length long, slots array<long>"


def windows_of(rows: DataFrame, id_column: str, lengths: dict[int, list[int]] | None, wanted=None) -> DataFrame:
    """rows(id, text) -> windows with their slots: id, reading, k, window, place, length (template words of the text), slots.

    Without ``lengths`` each text gives windows of WINDOW words, or one of all its words when it has fewer;
    otherwise windows of all the lengths that a reading has there.  ``wanted`` is a broadcast sorted array of window hashes: others are
    not emitted.
    """

    def found(ids: list, parts: list[np.ndarray], v: Vocabulary, asked: np.ndarray | None, bits: np.ndarray) -> pa.RecordBatch:
        size = np.array([len(p) for p in parts], np.int64)
        words = np.concatenate(parts)
        doc = np.repeat(np.arange(len(parts)), size)
        begins = np.ones(len(doc), bool)
        begins[1:] = doc[1:] != doc[:-1]
        out: list[list] = [[], [], [], [], [], [], []]
        for reading, t, slots, literal, at in readings(words, begins, v):
            of = doc[at]
            size = np.bincount(of, minlength=len(parts))
            end, first = np.cumsum(size), np.cumsum(size) - size
            own = np.minimum(size, WINDOW)
            for k in lengths.get(reading, []) if lengths is not None else sorted(set(own[own > 0].tolist())):
                w, ok = template_windows(t, literal, end[of], k, reading)
                if lengths is None:
                    ok &= own[of[:len(w)]] == k
                if asked is not None:
                    ok &= bits[w >> np.uint64(44)]
                hits = np.flatnonzero(ok)
                if asked is not None and len(hits):
                    place = np.minimum(np.searchsorted(asked, w[hits]), len(asked) - 1)
                    hits = hits[asked[place] == w[hits]]
                for p in hits.tolist():
                    d = of[p]
                    for column, value in zip(out, (ids[d], reading, k, int(w[p].astype(np.int64)), p - int(first[d]), int(size[d]),
                                                   slots[p:p + k].view(np.int64).tolist() if slots is not None else [])):
                        column.append(value)
        kinds = [pa.int64(), pa.int32(), pa.int32()] + [pa.int64()] * 3 + [pa.list_(pa.int64())]
        names = ["id", "reading", "k", "window", "place", "length", "slots"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary()
        asked = wanted.value if wanted is not None else None
        bits = np.zeros(1 << 20, bool)
        if asked is not None:
            bits[asked >> np.uint64(44)] = True
        for batch in batches:
            names = batch.column(id_column).to_pylist()
            ids, parts, many = [], [], 0
            for name, text in zip(names, binary(batch, "text")):
                if not text:
                    continue
                words = text.replace(b"\n", b" \x00 ").split()
                ids.append(name)
                parts.append(np.fromiter(map(v.__getitem__, words), np.int32, len(words)))
                many += len(words)
                if many >= CHUNK_WORDS:
                    yield found(ids, parts, v, asked, bits)
                    ids, parts, many = [], [], 0
                    if len(v) > VOCABULARY:
                        v = Vocabulary()
            if parts:
                yield found(ids, parts, v, asked, bits)

    return rows.select(F.col(id_column).cast("long").alias(id_column), "text").mapInArrow(run, ROW)


def leaks(docs: DataFrame, benchmark: DataFrame, work: Workspace, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Pairs of a document and a benchmark item it contains: doc_id, item_id, n_windows, item_windows, reparameterised.

    docs(doc_id, text), benchmark(item_id, text); other columns are not read.  n_windows counts the item's
    consistent windows found in one alignment of the two texts, read in one way: a contradiction between slots costs the windows that hold
    both, no others; reparameterised says that some slot there has another value
    than in the item.  Null and empty texts match nothing; items with fewer than WINDOW template words are
    matched whole.  A copy of the plain words, in any case, is found always; with other values a window needs
    LEAST_LITERALS words that are literals.  Repeated rows of a document or an item give one pair; a null id is kept as an id.
    """
    items = work.put(windows_of(benchmark.filter("text is not null"), "item_id", None).select(
        F.col("id").alias("item_id"), "reading", "k", "window", F.col("place").alias("item_place"), F.col("length").alias("item_length"),
        F.col("slots").alias("item_slots")).distinct(), "items")
    lengths: dict[int, list[int]] = {}
    for reading, k in sorted(map(tuple, items.select("reading", "k").distinct().collect())):  # at most WINDOW numbers each
        lengths.setdefault(reading, []).append(k)
    wanted, count = None, items.select("window").distinct().count()
    if count <= broadcast_windows:
        hashes = np.array([r[0] for r in items.select("window").distinct().collect()], np.int64)
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(hashes.view(np.uint64)))
    found = windows_of(docs, "doc_id", lengths, wanted).drop("reading", "k").withColumnRenamed("id", "doc_id")
    pairs = F.filter(F.transform(F.arrays_zip("item_slots", "slots"), lambda x: F.struct(
        x["item_slots"].alias("i"), x["slots"].alias("d"))), lambda x: x["i"] != 0)
    found = work.put(found.join(items, "window"), "matches")
    aligned = found.select("doc_id", "item_id", "reading", (F.col("place") - F.col("item_place")).alias("shift"), "item_place",
                           (F.col("item_length") - F.col("k") + 1).alias("item_windows"), F.array_distinct(pairs).alias("pairs"))
    # within a window; one that is word for word the item's is always consistent
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["i"])))
    aligned = aligned.filter(consistent).groupBy("doc_id", "item_id", "reading", "shift").agg(
        F.count_distinct("item_place").alias("n_windows"), F.any_value("item_windows").alias("item_windows"),
        F.max(F.exists("pairs", lambda x: x["i"] != x["d"])).alias("reparameterised"))
    best = aligned.groupBy("doc_id", "item_id").agg(F.max(F.struct(
        "n_windows", (~F.col("reparameterised")).alias("same"), "item_windows")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_windows", "best.item_windows", (~F.col("best.same")).alias("reparameterised"))
