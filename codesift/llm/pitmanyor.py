"""Language-model scores by a hierarchical Pitman-Yor model over words.

Every word that occurs is a context with a restaurant of its own, which serves the words that follow it; all these
restaurants share one parent, the root restaurant of all words, whose parent is uniform over the known words and
one that stands for all others.  A customer of a context's restaurant is an occurrence, a customer of the root is a table
below it.  Gibbs sweeps take all customers of a dish from their tables and seat them again by the Chinese restaurant's rule: at
a table in proportion to its customers less a discount, at a new one in proportion to what the parent says.  What the model needs of a
seating is its number of tables, and that is drawn at once from its law.  After some sweeps every
further one gives a sample of the tables, and a word's probability is the mean of its predictive probabilities.

All dishes of a level are sampled at once, given the tables that the sweep before left to the others, so a sweep is
two exchanges of packed blocks: pairs of words tell the root their tables, the root answers with its counts.
Pairs lie in buckets by context, a common context in many; words lie in buckets by word.  Nothing but a few sums
goes to the driver, and buckets grow in number with the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import shipped
from .blocks import SCHEMA, Got, added, batches_of, grouped, joined, of_kind, row, runs, split
from .scanned import Powers, hashed, one_hash
from .store import Workspace
from .words import mix

shipped(__name__)

# production parameters
BURN_IN, SAMPLES = 2, 3  # sweeps before the first sample, samples
ROWS = 1024  # up to so many customers of a dish, weights of seatings come from a table; beyond, from an integral
NODES = 40  # of the integral, on either side
STRENGTH = 0.5  # of the restaurants of contexts
ROOT_STRENGTH = 1.0
BUCKET_BYTES = 4 << 20  # text for which there is a bucket
BLOCK_TOKENS = 1 << 20  # tokens handled at a time; a single longer document makes a block of its own
GROUPS = 5  # documents are scored in so many turns, so that few questions are on their way at once
SEED = 1

BEGIN, END = np.uint64(one_hash(b" begin")), np.uint64(one_hash(b" end"))  # no word holds a space

# kinds of rows: what is known of pairs and of words, samples of both, and messages
SINGLES, SEATS, PAIR_SAMPLE, FACTS, WORDS, WORD_SAMPLE, TOLD, REPLY, ASKED, FOUND, DOCS, SUMS = range(12)


# ---- seating ------------------------------------------------------------------------
@lru_cache(maxsize=4)
def stirling(discount: float) -> np.ndarray:
    """Logarithms of the weights of all seatings of c customers at t tables, for c and t up to ROWS.

    A seating weighs the product over its tables of (1 - discount)(2 - discount)...(size - 1 - discount).
    """
    out = np.full((ROWS + 1, ROWS + 1), -np.inf)
    out[1, 1] = 0
    t = np.arange(1, ROWS + 1)
    for c in range(1, ROWS):
        out[c + 1, 1:c + 2] = out[c, :c + 1]  # the next customer opens a table
        out[c + 1, 1:c + 1] = np.logaddexp(out[c + 1, 1:c + 1], out[c, 1:c + 1] + np.log(c - discount * t[:c]))
    return out


def log1p(z: np.ndarray) -> np.ndarray:
    """log(1 + z) of complex numbers, exact for small ones."""
    return 0.5 * np.log1p(z.real * (2 + z.real) + z.imag ** 2) + 1j * np.arctan2(z.imag, 1 + z.real)


def odds_of_tables(c: int, weight: float, discount: float) -> tuple[int, np.ndarray]:
    """Odds of k, k + 1, ... tables for many customers: all numbers of tables whose odds are not lost in rounding.

    The weight of all seatings of c customers at t tables is c!/(t! discount^t) times the coefficient of z^c in
    (1 - (1 - z)^discount)^t, which is Cauchy's integral.  Its path is the circle through the saddle point where the saddle is
    far from the cut of (1 - z)^discount, else a parabola around the cut, through the saddle or some 8/c from the branch point.
    """
    rate = weight / discount
    low, high = -600.0, 0.0  # log of the saddle x = 1 - z of rate * (1 - x^discount) - (c + 1) log(1 - x)
    for _ in range(60):
        middle = 0.5 * (low + high)
        x = math.exp(middle)
        low, high = (middle, high) if x >= 1 or weight * x ** (discount - 1) * (1 - x) > c + 1 else (low, middle)
    saddle = math.exp(low)
    likely = min(max(-rate * math.expm1(discount * low), 1.0), c)
    near = likely * c ** -discount < 0.5  # nearly all are at one table: what is left after the 1 of (1 - x^discount)^t
    z, inner = -math.expm1(low), -math.expm1(discount * low)
    far, bend = -math.log(z), discount * saddle ** (discount - 1) * z / inner
    # the second derivative of likely * log(1 - (1 - e^-y)^discount) + c * y
    spread = max(likely * (bend * (1 + (1 - discount) * z / saddle) - bend * bend), 0.0)
    if not near and (far > 1 or far * math.sqrt(spread) > 6):
        turn = min(math.pi, 12 / math.sqrt(spread)) if far * math.sqrt(spread) > 6 else math.pi
        angle = (np.arange(NODES) + 0.5) * (turn / NODES)
        x = 1 - z * np.exp(1j * angle)
        one, rest = log1p(-x ** discount), -1j * c * angle
    else:
        vertex, wide = max(saddle, 8 / c), 1 / math.sqrt(min(1, 2 - 2 * discount))
        nodes = math.ceil(NODES * wide)
        theta = (np.arange(nodes) + 0.5) * (math.sqrt(40 / (c * vertex)) * wide / nodes)
        x = vertex * (1 + 1j * theta) ** 2
        one, rest = log1p(-x ** discount), -(c + 1) * log1p(-x) + np.log(1 + 1j * theta)
    step = 8 * math.sqrt(min(likely, c - likely + 1)) + 16
    first, last = max(1, int(likely - step)), min(c, int(likely + step))
    while True:
        t = np.arange(first, last + 1)
        power = t[:, None] * one
        if near:
            values = (np.expm1(power) * np.exp(rest - rest[0].real)).real.sum(axis=1)
            scale = 0.0
        else:
            power += rest
            scale = power[:, 0].real
            values = np.exp(power - scale[:, None]).real.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            odds = t * math.log(rate) - np.array([math.lgamma(k + 1) for k in t.tolist()]) + scale + np.log(np.where(values > 0, values, 0))
        odds -= odds.max()
        more = 2 * int(step)
        before, after = first > 1 and odds[0] > -32, last < c and odds[-1] > -32
        if not before and not after:
            return first, np.exp(odds)
        step += more
        first, last = max(1, first - more * before), min(c, last + more * after)


def drawn_tables(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables after all customers of every dish got up and sat down again.

    Drawn at once from the law that seating one customer after another has in the long run: t tables are as
    likely as weight^t times the weight of all seatings at t tables.  Nothing depends on how they sat before.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    draw = rng.random(len(customers))
    log_weight = np.log(np.maximum(weight, 1e-300))
    ends = np.unique(np.ceil(1.25 ** np.arange(3, 1 + math.ceil(math.log(ROWS, 1.25)))).astype(int).clip(2, ROWS))
    size = np.searchsorted(ends, customers)  # dishes with about as many customers are done together
    order = np.argsort(np.where(customers < 2, -1, size), kind="stable")
    begins = np.searchsorted(np.where(customers < 2, -1, size)[order], np.arange(len(ends) + 1))
    for i, most in enumerate(ends.tolist()):
        t = np.arange(1, most + 1)
        rows, many = stirling(discount)[:, 1:most + 1], max(1, (1 << 19) // most)
        for begin in range(begins[i], begins[i + 1], many):
            here = order[begin:min(begin + many, begins[i + 1])]
            odds = rows[customers[here]] + log_weight[here, None] * t
            odds -= odds.max(axis=1, keepdims=True)
            total = np.cumsum(np.exp(odds, out=odds), axis=1, out=odds)
            tables[here] = 1 + (total <= (draw[here] * total[:, -1])[:, None]).sum(axis=1)
    for i in order[begins[-1]:].tolist():
        first, odds = odds_of_tables(int(customers[i]), float(weight[i]), discount)
        total = np.cumsum(odds)
        tables[i] = first + np.searchsorted(total, draw[i] * total[-1], side="right")
    return np.minimum(tables, customers)


def reseated(sizes: np.ndarray, tables: np.ndarray, weight: np.ndarray, discount: float,
             rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One Gibbs sweep over many dishes: table sizes dish after dish, tables per dish -> the same afterwards.

    ``weight`` is that of a new table.  All customers of a dish are seated again, however many they are.  The model
    depends on numbers of tables only, so the sizes are summed out: of the new ones all but the first are 1.
    """
    if not len(tables):
        return sizes, tables
    customers = np.add.reduceat(sizes, np.cumsum(tables) - tables).astype(np.int64)
    tables = drawn_tables(customers, weight, discount, rng)
    sizes = np.ones(int(tables.sum()), np.int64)
    sizes[np.cumsum(tables) - tables] += customers - tables
    return sizes, tables


def started(customers: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A seating to begin with: about as many tables as the rule opens for that many customers, older ones larger."""
    if not len(customers):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    expected = 1 + weight * np.log1p((customers - 1) / (1 + weight))
    tables = np.clip(np.rint(expected), np.minimum(customers, 1), customers).astype(np.int64)
    dish = np.repeat(np.arange(len(tables)), tables)
    first = np.cumsum(tables) - tables
    share = np.exp(-(np.arange(len(dish)) - first[dish]) / np.maximum(weight[dish], 0.1))
    total = np.bincount(dish, weights=share, minlength=len(tables))
    sizes = 1 + np.floor((customers - tables)[dish] * share / total[dish]).astype(np.int64)
    seated = np.bincount(dish, weights=sizes, minlength=len(tables)).astype(np.int64)
    some = tables > 0
    sizes[first[some]] += (customers - seated)[some]
    return sizes, tables


def changed(sizes: np.ndarray, tables: np.ndarray, customers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seatings whose dishes have other numbers of customers now: they come to, or go from, the first tables.

    A start for the next sweep.  A dish without tables gets one if it has customers.
    """
    dish = np.repeat(np.arange(len(tables)), tables)
    more = customers - np.bincount(dish, weights=sizes, minlength=len(tables)).astype(np.int64)
    first = np.cumsum(tables) - tables
    before = np.cumsum(sizes) - sizes
    before = before - before[np.minimum(first[dish], max(len(sizes) - 1, 0))] if len(sizes) else before
    sizes = sizes - np.clip(-more[dish] - before, 0, sizes)
    gains = np.flatnonzero((more > 0) & (tables > 0))
    sizes[first[gains]] += more[gains]
    left, opened = sizes > 0, np.flatnonzero((more > 0) & (tables == 0))
    dish, sizes = np.append(dish[left], opened), np.append(sizes[left], more[opened])
    back = np.argsort(dish, kind="stable")
    return sizes[back], np.bincount(dish, minlength=len(tables))


# ---- places -------------------------------------------------------------------------
def home_of_pair(context: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    """A context lies in one of 16 shares of all buckets by the word that follows: with a third of all pairs it fills
    no bucket more than some five times as much as another, and the pairs of most contexts stay together."""
    salt = mix(word, 3) % np.uint64(1 + buckets // 16)
    return (mix(context + salt * np.uint64(0x9E3779B97F4A7C15), 4) % np.uint64(buckets)).astype(np.int64)


def home_of_word(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(word, 5) % np.uint64(buckets)).astype(np.int64)


class Asked:
    """The words, as contexts and as dishes, that a bucket of pairs exchanges with the buckets of words."""

    def __init__(self, context: np.ndarray, word: np.ndarray, buckets: int):
        keys, at = np.unique(np.concatenate([context, word]), return_inverse=True)
        home = home_of_word(keys, buckets)
        by = np.argsort(home, kind="stable")
        self.keys, self.home = keys[by], home[by]
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.context, self.word = place[at[:len(context)]], place[at[len(context):]]

    def sums(self, place: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(place, weights=values, minlength=len(self.keys)).astype(np.int64)

    def answer(self, replies: list[tuple[int, list[np.ndarray]]]) -> list[np.ndarray]:
        """The columns of all replies in the order of the keys."""
        columns = max(len(arrays) for _, arrays in replies)
        out = [np.zeros(len(self.keys)) for _ in range(columns)]
        for home, arrays in replies:
            a, b = np.searchsorted(self.home, [home, home + 1])
            for to, values in zip(out, arrays):
                to[a:b] = values
        return out


# ---- counting -----------------------------------------------------------------------
class Block:
    """Some documents: the hashes of their words one after another and how many each has."""

    def __init__(self, hashes: list[np.ndarray], n: list[np.ndarray]):
        self.h, self.n = np.concatenate(hashes), np.concatenate(n)
        self.end = np.cumsum(self.n)
        self.begin = self.end - self.n


def blocks(batches: Iterator[pa.RecordBatch], extra: list[str]) -> Iterator[tuple[Block, list[pa.Array]]]:
    """The documents of a task in blocks, and some columns of their rows.  A document is never cut."""
    powers = Powers()
    hashes, n, columns, size = [], [], [[] for _ in extra], 0
    for batch in batches:
        begin, rows = 0, batch.num_rows
        lengths = pc.binary_length(batch.column("text").cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths + 1)
        while begin < rows:  # as many documents as may hold what the block still takes
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + 4 * max(BLOCK_TOKENS - size, 1))))
            h, k = hashed(batch.column("text").slice(begin, end - begin), powers)
            hashes.append(h)
            n.append(k)
            for to, name in zip(columns, extra):
                to.append(batch.column(name).slice(begin, end - begin))
            size += len(h) + len(k)
            begin = end
            if size >= BLOCK_TOKENS:
                yield Block(hashes, n), [pa.concat_arrays(x) for x in columns]
                hashes, n, columns, size = [], [], [[] for _ in extra], 0
    if size:
        yield Block(hashes, n), [pa.concat_arrays(x) for x in columns]


def pairs_of(c: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, word and document of each token, the end of every document included; equal pairs stand together.

    Sorted by half a hash of the context and half a hash of the word, documents in their order.  In the rare case that
    both halves are those of another pair, the two may alternate; whoever merges pairs compares them whole.
    """
    word = np.insert(c.h, c.end, END)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[c.begin + np.arange(len(c.n))] = BEGIN
    doc = np.repeat(np.arange(len(c.n), dtype=np.int32), c.n + 1)
    order = np.argsort(pair_key(context, word), kind="stable")
    return context[order], word[order], doc[order]


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Half a hash of the context before half a hash of the word."""
    half = np.uint64(32)
    return mix(context, 1) >> half << half | mix(word, 1) >> half


def distinct(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs stand together, by their keys, and where a new pair begins."""
    key = pair_key(context, word)
    order = np.argsort(key, kind="stable")
    at = steps(context[order], word[order])
    if len(at) != len(steps(key[order])):  # different pairs with one key
        order = np.lexsort((word, context, key))
        at = steps(context[order], word[order])
    return order, at


def steps(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def counted(docs: DataFrame, buckets: int) -> DataFrame:
    """docs(text) -> the pairs of their blocks, dealt out to the buckets of pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for c, _ in blocks(batches, []):
                context, word, _ = pairs_of(c)
                at = steps(context, word)
                n = np.diff(np.append(at, len(word)))
                for bucket, u, w, k in split(home_of_pair(context[at], word[at], buckets), context[at], word[at], n):
                    yield row(bucket, TOLD, 0, *runs(u), w, k)
        yield from batches_of(rows())
    return docs.select("text").mapInArrow(run, SCHEMA)


def paired(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """Contexts written out again."""
    return [np.repeat(arrays[0], arrays[1]), *arrays[2:]]


def first_seating(buckets: int):
    """Merge the counts of a bucket: pairs seen once, pairs with customers to seat, and what the words learn of both."""
    def work(bucket: int, got: Got) -> Iterator[tuple]:
        context, word, n = joined([paired(a) for _, a in got[TOLD]], 3)
        order, at = distinct(context, word)
        n = np.add.reduceat(n[order].astype(np.int64), at)
        context, word = context[order][at], word[order][at]
        once, more = n == 1, n > 1
        yield row(bucket, SINGLES, 0, *runs(context[once]), word[once],
                  stats=[int(n.sum()), int(once.sum()), int((n == 2).sum())])
        tables = np.ones(int(more.sum()), np.int64)
        yield row(bucket, SEATS, 0, *runs(context[more]), word[more], tables, n[more])
        asked = Asked(context, word, buckets)
        fixed = once.astype(np.int64)
        for to, *columns in split(asked.home, asked.keys, asked.sums(asked.word, n), asked.sums(asked.context, n),
                                  asked.sums(asked.word, fixed), asked.sums(asked.context, fixed)):
            yield row(to, FACTS, bucket, *columns)
        yield from told(bucket, Asked(context[more], word[more], buckets), tables)
    return work


def told(bucket: int, asked: Asked, tables: np.ndarray) -> Iterator[tuple]:
    """Tables by word and by context, for the buckets of words."""
    for to, *columns in split(asked.home, asked.keys, asked.sums(asked.word, tables), asked.sums(asked.context, tables)):
        yield row(to, TOLD, bucket, *columns)


# ---- sweeps -------------------------------------------------------------------------
def gathered_words(bucket: int, got: Got) -> Iterator[tuple]:
    """The words of a bucket: occurrences as word and as context; fixed customers and tables."""
    keys, *columns = joined([a for _, a in got[FACTS]], 5)
    words, at = np.unique(keys, return_inverse=True)
    count, size, customers, tables = (np.bincount(at, weights=c, minlength=len(words)).astype(np.int64) for c in columns)
    yield row(bucket, FACTS, 0, words, count, size, stats=[int((count > 0).sum())])
    yield row(bucket, WORDS, 0, words, customers, tables)


def root_sweep(turn: int, discount: float, new_table: float, sample: int | None):
    """New customers from the tables below, one sweep over the root's tables, and replies to the buckets of pairs."""
    def work(bucket: int, got: Got) -> Iterator[tuple]:
        words, fixed_customers, fixed_tables = got[WORDS][0][1]
        customers, below = fixed_customers.astype(np.int64), fixed_tables.astype(np.int64)
        places = []
        for _, (keys, k, t) in got.get(TOLD, []):
            places.append(np.searchsorted(words, keys))
            customers[places[-1]] += k
            below[places[-1]] += t
        rng = np.random.default_rng([SEED, turn, 0, bucket])
        tables = drawn_tables(customers, np.full(len(words), new_table), discount, rng)
        yield row(bucket, WORDS, 0, words, fixed_customers, fixed_tables,
                  stats=[int(customers.sum()), int(tables.sum()), int((customers == 1).sum()), int((customers == 2).sum())])
        if sample is not None:
            yield row(bucket, WORD_SAMPLE, sample, customers, tables, below)
        for (to, _), place in zip(got.get(TOLD, []), places):
            yield row(to, REPLY, bucket, customers[place], tables[place], below[place])
    return work


def pair_sweep(turn: int, discount: float, root: Root, buckets: int, sample: int | None):
    """One sweep over the tables of a bucket of pairs: what the words learn of it."""
    def work(bucket: int, got: Got) -> Iterator[tuple]:
        context, word, tables, customers = paired(got[SEATS][0][1])
        asked = Asked(context, word, buckets)
        if len(word):
            k, seats, below = asked.answer(got[REPLY])
            weight = (STRENGTH + discount * below[asked.context]) * root.predictive(k, seats)[asked.word]
            tables = drawn_tables(customers.astype(np.int64), weight, discount, np.random.default_rng([SEED, turn, 1, bucket]))
        if sample is not None:
            yield row(bucket, PAIR_SAMPLE, sample, tables)
        yield from told(bucket, asked, tables)
    return work


class Root:
    """The root restaurant as a whole: all customers, all tables, and the number of words."""

    def __init__(self, customers: int, tables: int, words: int, discount: float):
        self.customers, self.tables, self.words, self.discount = customers, tables, words, discount

    @property
    def new_table(self) -> float:
        return (ROOT_STRENGTH + self.discount * self.tables) / (self.words + 1)

    def predictive(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.discount * tables + self.new_table) / (ROOT_STRENGTH + self.customers)


def discount_of(ones: int, twos: int) -> float:
    """The estimate of absolute discounting from how many dishes have one customer and how many have two."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


class Model:
    """The written tables of a fitted model and its sums."""

    def __init__(self, pairs: DataFrame, words: DataFrame, tokens: int, types: int, discount: float, roots: list[Root], buckets: int):
        self.pairs, self.words, self.tokens, self.types = pairs, words, tokens, types
        self.discount, self.roots, self.buckets = discount, roots, buckets


def fitted(docs: DataFrame, work: Workspace, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Model:
    """docs(text), those to learn from -> the model."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // BUCKET_BYTES
    start = work.put(grouped(counted(docs, buckets), buckets, first_seating(buckets)), "start")
    tokens, ones, twos = added(of_kind(start, SINGLES), 3)
    discount = discount_of(ones, twos)
    words = work.put(grouped(of_kind(start, FACTS), buckets, gathered_words), "words0")
    types = added(of_kind(words, FACTS), 1)[0]
    known_words = [work.put(of_kind(words, FACTS), "facts")]
    pairs = work.put(of_kind(start, SINGLES, SEATS), "pairs")  # with all their customers at one table: a sweep needs their number only
    known_pairs = [pairs]
    seats = work.put(of_kind(start, TOLD), "seats0")
    work.drop("start")
    # a first root: every word has one table
    root = Root(0, types, types, 0.5)
    roots: list[Root] = []
    for turn in range(1, burn_in + samples + 2):
        sample = turn - burn_in - 2 if turn > burn_in + 1 else None  # the root follows the pairs by one exchange
        swept = grouped(of_kind(words, WORDS).unionByName(of_kind(seats, TOLD)), buckets,
                        root_sweep(turn, root.discount, root.new_table, sample))
        words = work.put(swept, f"words{turn}")
        customers, tables, one, two = added(of_kind(words, WORDS), 4)
        root = Root(customers, tables, types, discount_of(one, two) if turn == 1 else root.discount)
        if sample is not None:
            roots.append(root)
            known_words.append(work.put(of_kind(words, WORD_SAMPLE), f"word-sample{sample}"))
        work.drop(f"words{turn - 1}")
        if turn <= burn_in + samples:
            sample = turn - burn_in - 1 if turn > burn_in else None
            swept = grouped(of_kind(pairs, SEATS).unionByName(of_kind(words, REPLY)), buckets,
                            pair_sweep(turn, discount, root, buckets, sample))
            seats = work.put(swept, f"seats{turn}")
            if sample is not None:
                known_pairs.append(work.put(of_kind(seats, PAIR_SAMPLE), f"pair-sample{sample}"))
            work.drop(f"seats{turn - 1}")
    work.drop(f"words{turn}", f"seats{burn_in + samples}")
    return Model(reduce(DataFrame.unionByName, known_pairs), reduce(DataFrame.unionByName, known_words), tokens, types, discount, roots, buckets)


# ---- scoring ------------------------------------------------------------------------
def questions(docs: DataFrame, buckets: int) -> DataFrame:
    """docs(doc_id, held_out, text) -> their pairs, with the places where they stand, and their own rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            number = TaskContext.get().partitionId() << 32
            for block, (c, (ids, held)) in enumerate(blocks(batches, ["doc_id", "held_out"]), number):
                yield row(block % buckets, DOCS, block, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
                          held.to_numpy(zero_copy_only=False), c.n + 1)
                context, word, doc = pairs_of(c)
                place = steps(context, word, doc)
                times = np.diff(np.append(place, len(word)))
                at = steps(context[place], word[place])
                per_pair = np.diff(np.append(at, len(place)))
                home = home_of_pair(context[place][at], word[place][at], buckets)
                pairs = split(home, context[place][at], word[place][at], per_pair)
                places = split(np.repeat(home, per_pair), doc[place], times)
                for (bucket, u, w, k), (_, d, t) in zip(pairs, places):
                    yield row(bucket, ASKED, block, *runs(u), w, k, d, t)
        yield from batches_of(rows())
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, SCHEMA)


def looked_up(samples: int, buckets: int):
    """What a bucket of pairs knows of the pairs asked for, and its questions to the buckets of words."""
    def work(bucket: int, got: Got) -> Iterator[tuple]:
        for block, arrays in got.get(DOCS, []):
            yield row(block, DOCS, block, *arrays)
        if ASKED not in got:
            return
        known = []
        for _, arrays in got.get(SINGLES, []):
            u, w = paired(arrays)
            known.append((u, w, [np.ones(len(w), np.int64)] * (1 + samples)))
        for _, arrays in got.get(SEATS, []):
            u, w, tables, sizes = paired(arrays)
            n = np.bincount(np.repeat(np.arange(len(w)), tables), weights=sizes, minlength=len(w)).astype(np.int64)
            known.append((u, w, [n, *[a[0] for _, a in got[PAIR_SAMPLE]]]))
        known = [(pair_key(u, w), u, w, values) for u, w, values in known]
        keys = [np.empty(0, np.uint64)]
        for block, arrays in got[ASKED]:
            context, word, *places = paired(arrays)
            found = [np.zeros(len(word), np.int64) for _ in range(1 + samples)]
            key = pair_key(context, word)
            for known_key, u, w, values in known:
                here, there = matched(key, context, word, known_key, u, w)
                for to, value in zip(found, values):
                    to[here] = value[there]
            yield row(bucket, FOUND, block, arrays[0], arrays[1], word, *found, *places)
            keys += [arrays[0], word]
        keys = np.unique(np.concatenate(keys))
        for to, some in split(home_of_word(keys, buckets), keys):
            yield row(to, ASKED, bucket, some)
    return work


def matched(key: np.ndarray, context: np.ndarray, word: np.ndarray, known: np.ndarray, u: np.ndarray,
            w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal pairs in two lists with their keys; the second has no repeats and is sorted by key."""
    here, there = np.arange(len(key)), np.searchsorted(known, key)
    found = [(here[:0], there[:0])]
    while len(here):  # a second turn only for different pairs with one key
        inside = there < len(known)
        here, there = here[inside], there[inside]
        alike = known[there] == key[here]
        here, there = here[alike], there[alike]
        same = (u[there] == context[here]) & (w[there] == word[here])
        found.append((here[same], there[same]))
        here, there = here[~same], there[~same] + 1
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def word_replies(bucket: int, got: Got) -> Iterator[tuple]:
    """What a bucket of words knows of the words asked for; zeros for those it does not know."""
    words, *columns = got[FACTS][0][1] if FACTS in got else [np.empty(0, np.uint64)] * 3
    columns += [c for _, arrays in got.get(WORD_SAMPLE, []) for c in arrays]
    for to, (keys,) in got.get(ASKED, []):
        place = np.searchsorted(words, keys)
        known = place < len(words)
        known[known] = words[place[known]] == keys[known]
        out = []
        for column in columns:
            values = np.zeros(len(keys), np.int64)
            values[known] = column[place[known]]
            out.append(values)
        yield row(to, REPLY, bucket, *out)


def logarithms(c: np.ndarray, tables: list[np.ndarray], size: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]],
               below: list[np.ndarray], discount: float, roots: list[Root]) -> np.ndarray:
    """log10 of the mean over the samples of a pair's predictive probability.

    c and tables are those of the pair, size and below the customers and tables of its context, words the customers
    and tables of its word at the root.
    """
    total = np.zeros(len(c))
    for t, (k, r), b, root in zip(tables, words, below, roots):
        total += (c - discount * t + (STRENGTH + discount * b) * root.predictive(k, r)) / (STRENGTH + size)
    return np.log10(total / len(roots))


def document_sums(model_tokens: int, types: int, discount: float, roots: list[Root], buckets: int):
    """Per block the sums of its documents over the pairs of a bucket."""
    samples = len(roots)

    def work(bucket: int, got: Got) -> Iterator[tuple]:
        if FOUND not in got:
            return
        found = [(block, paired(arrays)) for block, arrays in got[FOUND]]
        context, word, c, *tables = joined([a[:3 + samples] for _, a in found], 3 + samples)
        asked = Asked(context, word, buckets)
        count, size, *kept = asked.answer(got[REPLY])
        if not kept:  # a bucket of words without any
            kept = [np.zeros(len(count))] * (3 * samples)
        score = logarithms(c, tables, size[asked.context], [(kept[3 * s][asked.word], kept[3 * s + 1][asked.word]) for s in range(samples)],
                           [kept[3 * s + 2][asked.context] for s in range(samples)], discount, roots)
        base = np.log10((count[asked.word] + 1) / (model_tokens + types + 1))
        known = count[asked.word] > 0
        begin = 0
        for block, (_, w, *_, per_pair, doc, times) in found:
            pair = begin + np.repeat(np.arange(len(w)), per_pair)
            docs, at = np.unique(doc, return_inverse=True)
            sums = [np.bincount(at, weights=times * values[pair], minlength=len(docs)) for values in (score, base, known)]
            yield row(block, SUMS, bucket, docs, sums[0], sums[1], sums[2].astype(np.int64))
            begin += len(w)
    return work


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def document_rows(model_tokens: int):
    def work(block: int, got: Got) -> Iterator[pa.RecordBatch]:
        ids, null, held, n = got[DOCS][0][1]
        score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for _, (docs, s, b, k) in got[SUMS]:
            score[docs] += s
            base[docs] += b
            known[docs] += k
        yield pa.RecordBatch.from_arrays([
            pa.array(ids.astype(np.int64), mask=null), pa.array(held), pa.array(n.astype(np.int64)), pa.array(known),
            pa.array(np.full(len(ids), model_tokens, np.int64)), pa.array(base), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return work


def scored_by(model: Model, docs: DataFrame, work: Workspace, groups: int = GROUPS) -> DataFrame:
    """docs(doc_id, held_out, text) -> the scores of all of them, some documents at a time."""
    out, buckets, samples = None, model.buckets, len(model.roots)
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups))
    for g in range(groups):
        asked = questions(docs.filter(turn == g), buckets)
        found = work.put(grouped(asked.unionByName(model.pairs), buckets, looked_up(samples, buckets)), f"found{g}")
        replies = work.put(grouped(of_kind(found, ASKED).unionByName(model.words), buckets, word_replies), f"replies{g}")
        sums = work.put(grouped(of_kind(found, FOUND).unionByName(replies), buckets, document_sums(
            model.tokens, model.types, model.discount, model.roots, buckets)).unionByName(of_kind(found, DOCS)), f"sums{g}")
        work.drop(f"found{g}", f"replies{g}")
        scores = work.put(grouped(sums, buckets, document_rows(model.tokens), RESULT), f"scores{g}")
        work.drop(f"sums{g}")
        out = scores if out is None else out.unionByName(scores)
    return out


def scored(docs: DataFrame, work: Workspace) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document.

    Held out are documents whose crc32(doc_id as text) mod 7 is 2; the others are learnt from.  A null or empty text
    has one token, its end.  A row with a null doc_id is learnt from.  Repeated rows are learnt from and scored each.
    Without a row to learn from all words are unknown, one type with probability 1.  Words and contexts are told apart by
    hashes of 64 bits: of 1e9 different words some 0.03 pairs are expected to share one.  Results are the same in
    every run over the same rows; other columns are not read.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return scored_by(fitted(rows.filter("not held_out"), work), rows, work)
