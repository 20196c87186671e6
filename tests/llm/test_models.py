"""Clustering, vector codes and language-model scores against brute force."""

import hashlib
import math
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from codesift.llm import clustering, pitmanyor as P, quantizer, scanned
from codesift.llm.blocks import of_kind
from codesift.llm.scanned import one_hash
from codesift.llm.store import Workspace

from . import brute
from .frames import document_rows, documents, with_clashes
from .test_documents import some

VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(n=120, width=64, seed=1):
    """Groups of near vectors, ties, copies, repeated rows, a hot vector, and all that is to be dropped."""
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = [(i, [float(np.float32(c + r.gauss(0, 0.2))) for c in middles[i % 6]], i % 4) for i in range(n)]
    rows += [(n + i, rows[5][1], 1) for i in range(n // 2)]
    rows += [(2 * n + i, [float((i + j) % 2) for j in range(width)], None) for i in range(8)]
    rows += [rows[0], rows[0], (None, rows[1][1], None), (None, rows[2][1], 7)]
    bad = [None, [], [None] * width, rows[3][1][:-1] + [None], rows[3][1][:-1] + [float("nan")], rows[3][1][:-1] + [float("-inf")]]
    rows += [(3 * n + i, v, 2) for i, v in enumerate(bad)]
    return rows


def whole(v):
    return [math.floor(1024 * c) for c in v]


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def brute_clusters(rows, centroids, rounds, seed, width):
    kept = [(d, whole(v)) for d, v, _ in rows if good(v) and len(v) == width]
    first = sorted((hashlib.sha256(f"{seed}:{d}".encode()).hexdigest(), v) for d, v in kept if d is not None)[:centroids]
    now = [v for _, v in first]
    for turn in range(rounds + 1):
        near = [min((apart(v, c), k) for k, c in enumerate(now)) for _, v in kept]
        if turn < rounds:
            for k in range(len(now)):
                mine = [v for (_, v), (_, j) in zip(kept, near) if j == k]
                now[k] = [sum(c) // len(mine) for c in zip(*mine)] if mine else now[k]
    inertia = Counter()
    for d, k in near:
        inertia[k] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return [(i, k, d, inertia[k], sum(inertia.values()), sha[k]) for (i, _), (d, k) in zip(kept, near)]


def frame(spark, rows):
    return with_clashes(spark.createDataFrame(rows, VECTORS).repartition(5))


@pytest.mark.parametrize("n, centroids, rounds", [(120, 8, 10), (6, 40, 2), (60, 1, 3)])
def test_clusters(spark, n, centroids, rounds):
    rows = vector_rows(n)
    got = clustering.clustered(frame(spark, rows), Workspace(spark, "t"), centroids, rounds).collect()
    assert some(got) == some(brute_clusters(rows, centroids, rounds, 3, 64))


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, None, 1), (2, [0.5] * 63, 1)], [(None, [0.5] * 64, 1)]):
        got = clustering.clustered(frame(spark, rows), Workspace(spark, "t"))
        assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_vectors_too_large_for_longs(spark):
    rows = [(i, [3e38 if i % 2 else -0.5] * 63 + [float(i)], 0) for i in range(9)] + [(20, [2e30] * 64, 0)]
    want = brute_clusters([(d, [float(np.float32(c)) for c in v], x) for d, v, x in rows], 2, 3, 3, 64)
    fit = [tuple(x if not isinstance(x, int) or x < 1 << 63 else None for x in r) for r in want]
    assert some(clustering.clustered(frame(spark, rows), Workspace(spark, "t"), 2, 3).collect()) == some(fit)
    assert quantizer.coded(frame(spark, rows), Workspace(spark, "t"), entries=4, rounds=1).count() == 10


def test_orchard_finds_the_nearest_and_measures_less():
    rng = np.random.default_rng(2)
    for width, k, n in ((2, 9, 4000), (8, 30, 3000), (3, 1, 10), (1, 6, 500)):
        x, c = rng.integers(-30, 30, (n, width)), rng.integers(-30, 30, (k, width))
        c[k // 2] = c[0]  # a tie everywhere
        near, d, measured = clustering.orchard(x, c)
        every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (near == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
        assert measured <= n * k * (0.6 if width == 2 else 1)
    got, d, _ = clustering.orchard(x.astype(object), c.astype(object))
    assert got.tolist() == near.tolist()


def test_equal_distances_at_the_bound_are_not_skipped():
    """The tie lies exactly twice the distance away from the start, with a smaller number."""
    near, d, _ = clustering.orchard(np.array([[5, 0]]), np.array([[10, 0], [0, 0]]))
    assert (near[0], d[0]) == (0, 25)


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, d, whole(v), label) for i, (d, v, label) in enumerate(rows) if good(v)]
    usable = sorted((d, rows[i][1], i) for i, d, v, _ in kept if d is not None and v and len(v) % parts == 0)
    width = len(usable[0][1])
    fit = [(i, v) for i, _, v, _ in kept if len(v) == width]
    cut = width // parts
    start = [whole(v) for _, v, _ in usable if len(v) == width][:entries]
    books = [[v[p * cut:(p + 1) * cut] for v in start] for p in range(parts)]
    for turn in range(rounds + 1):
        near = [[min((apart(v[p * cut:(p + 1) * cut], c), k) for k, c in enumerate(books[p])) for p in range(parts)] for _, v in fit]
        if turn < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    mine = [v[p * cut:(p + 1) * cut] for (_, v), n in zip(fit, near) if n[p][1] == k]
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)] if mine else books[p][k]
    code = {i: ("".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n)) for (i, _), n in zip(fit, near)}
    by_label = defaultdict(list)
    for i, _, _, label in kept:
        by_label[label] += [code[i][1]] if i in code else []
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return [(d, *code.get(i, (None, None)), sum(by_label[label]) if by_label[label] else None, sha) for i, d, _, label in kept]


@pytest.mark.parametrize("parts, entries, rounds", [(4, 256, 4), (4, 20, 4), (2, 5, 3)])
def test_codes(spark, parts, entries, rounds):
    rows = vector_rows(90, 16) + [(900, [0.5] * 12, 55), (901, [0.25] * 7, 1)]
    got = quantizer.coded(frame(spark, rows), Workspace(spark, "t"), parts, entries, rounds).collect()
    assert some(got) == some(brute_codes(rows, parts, entries, rounds))


def test_codes_of_nothing(spark):
    assert quantizer.coded(frame(spark, []), Workspace(spark, "t")).count() == 0
    got = quantizer.coded(frame(spark, [(1, [0.5] * 7, 3), (None, [0.5] * 8, None)]), Workspace(spark, "t")).collect()
    assert some(r[:4] for r in got) == some([(1, None, None, None), (None, None, None, None)])


def test_only_parts_with_another_entry_move(spark, monkeypatch):
    """A hot entry is dealt to several owners, and what stays is in the partition where it was."""
    monkeypatch.setattr(quantizer, "MEMBERS", 64)
    rows = [(i, v, 0) for i, (_, v, _) in enumerate(r for r in vector_rows(200, 16) if good(r[1]) and r[1])]
    df = spark.createDataFrame([(i, i, v) for i, v, _ in rows], "row long, vec_id long, embedding array<float>")
    books, members = quantizer.fitted(df.repartition(3), 16, 4, 8, 3)
    assert "PartitionerAwareUnionRDD" in members.toDebugString().decode()

    def seen(number, blocks):
        for position, entry, ids, _ in quantizer.gathered(d for _, d in blocks):
            yield from [(int(p), position, int(i)) for p, i in zip(np.full(len(ids), number), ids)]

    placed = members.mapPartitionsWithIndex(seen).collect()
    assert sorted((p, i) for _, p, i in placed) == sorted((p, i) for p in range(4) for i, _, _ in rows)
    assert members.getNumPartitions() > 8
    per_owner = Counter(number for number, _, _ in placed)
    assert max(per_owner.values()) < len(placed) / 4


def test_nearest_is_exact_beyond_doubles():
    big = 1 << 40
    x, book = np.array([[big + 1, 0]], object), np.array([[big, 0], [big + 1, 1], [big + 1, 0]], object)
    assert [v.tolist() for v in quantizer.nearest(x, book)] == [[2], [0]]
    x, book = x.astype(np.int64), book.astype(np.int64)
    assert [v.tolist() for v in quantizer.nearest(x, book)] == [[2], [0]]


@pytest.mark.parametrize("oracle, run", [(clustering.ORACLE, clustering.clustered), (quantizer.ORACLE, quantizer.coded)])
def test_vectors_against_sql(spark, oracle, run):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    pytest.importorskip("duckdb")
    con = duckdb.connect()
    try:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    except duckdb.IOException:
        pytest.skip("test tables are missing")
    cur = con.execute(oracle)
    got = run(spark.read.parquet(path), Workspace(spark, "t"))
    assert got.columns == [d[0] for d in cur.description]
    assert some(got.collect()) == some(cur.fetchall())


# ---- language model -----------------------------------------------------------------
def stirling_weights(c, discount, strength, weight):
    """Exact odds of 1..c tables for one dish: all partitions of c customers."""
    odds = defaultdict(float)

    def seat(sizes, left, odd):
        if not left:
            odds[len(sizes)] += odd
            return
        for i in range(len(sizes)):
            seat(sizes[:i] + [sizes[i] + 1] + sizes[i + 1:], left - 1, odd * (sizes[i] - discount))
        seat(sizes + [1], left - 1, odd * weight)
    seat([1], c - 1, weight)
    return {t: v / sum(odds.values()) for t, v in odds.items()}


def test_reseating_has_the_exact_distribution():
    rng, many = np.random.default_rng(4), 4000
    for c, discount, weight in ((2, 0.5, 0.3), (5, 0.7, 0.2), (6, 0.3, 1.5)):
        sizes, tables = np.full(many, c), np.ones(many, np.int64)
        seen = Counter()
        for sweep in range(30):
            sizes, tables = P.reseated(sizes, tables, np.full(many, weight), discount, rng)
            assert len(sizes) == tables.sum() and (np.add.reduceat(sizes, np.cumsum(tables) - tables) == c).all()
            if sweep >= 10:
                seen.update(tables.tolist())
        for t, p in stirling_weights(c, discount, 0, weight).items():
            assert abs(seen[t] / (20 * many) - p) < 0.015


def test_a_sweep_seats_all_customers_whatever_their_number():
    # odds by the table of weights against odds by the integral, for dishes nearly all at one table, nearly all alone and between
    for discount in (0.05, 0.4, 0.6, 0.8, 0.95):
        for weight in (1e-4, 0.4, 5.0, 60.0, 700.0, 2e4):
            first, odds = P.odds_of_tables(P.ROWS, weight, discount)
            want = P.stirling(discount)[P.ROWS, 1:] + np.log(weight) * np.arange(1, P.ROWS + 1)
            want, got = np.exp(want - want.max()), np.zeros(P.ROWS)
            got[first - 1:first - 1 + len(odds)] = odds / odds.sum()
            assert np.abs(got - want / want.sum()).sum() < 1e-5
    # one sweep is enough from any start: with random visits to a few customers, a start at one table or all alone would show
    rng, many = np.random.default_rng(6), 1500
    for c, weight in ((700, 20.0), (3000, 20.0)):
        one = P.reseated(np.full(many, c), np.ones(many, np.int64), np.full(many, weight), 0.5, rng)
        alone = P.reseated(np.ones(20 * c, np.int64), np.full(20, c), np.full(20, weight), 0.5, rng)
        first, odds = P.odds_of_tables(c, weight, 0.5)
        mean = (odds * np.arange(first, first + len(odds))).sum() / odds.sum()
        assert abs(one[1].mean() - mean) < 0.02 * mean and abs(alone[1].mean() - mean) < 0.2 * mean


def test_hashes_of_words_from_buffers(monkeypatch):
    r = random.Random(3)
    texts = [None, "", "  ", "A b\tC\x0bé\n", "one", " one", "long" * 900 + " x", "😀 ONE", "\x1f\x00 y"]
    texts += ["".join(r.choice("aB \n\té") for _ in range(r.randint(0, 50))) for _ in range(300)]
    want = [[one_hash(w) for w in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())] for t in texts]
    for size in (1 << 21, 7, 64):
        monkeypatch.setattr(scanned, "SLICE", size)
        powers = scanned.Powers()
        for column in (pa.array(texts, pa.string()), pa.array(["x y"] + texts, pa.large_string()).slice(1)):
            h, n = scanned.hashed(column, powers)
            assert n.tolist() == [len(w) for w in want] and h.tolist() == [x for w in want for x in w]
    assert one_hash(b"ONE") == one_hash(b"one") != one_hash(b"on") and one_hash(b"ab") != one_hash(b"ba")
    h, n = scanned.hashed(pa.array(["Ab ab AB"]), powers, lower=False)
    assert len(set(h.tolist())) == 3
    for size in (3, 1 << 18):
        monkeypatch.setattr(scanned, "CHUNK_WORDS", size)
        found = list(scanned.chunks(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), powers, True))
        assert [r for c in found for r in c.rows] == list(range(len(texts))) and [x for c in found for x in c.n.tolist()] == [len(w) for w in want]
        assert [x for c in found for x in c.h.tolist()] == [x for w in want for x in w]
    h, n = scanned.hashed(pa.array([], pa.string()), powers)
    assert len(h) == len(n) == 0


def test_a_start_has_all_customers():
    customers = np.array([2, 3, 10, 100000, 7, 0, 1])
    sizes, tables = P.started(customers, np.array([0.1, 50.0, 1.0, 3.0, 0.0, 1.0, 1.0]))
    assert np.bincount(np.repeat(np.arange(7), tables), sizes, 7).tolist() == customers.tolist() and (sizes > 0).all()
    assert tables[3] > 20 and tables[4] == 1


def test_reseating_of_unequal_dishes_keeps_their_customers():
    rng = np.random.default_rng(5)
    customers = np.array([2, 900, 3, 2, 40000, 17, 16, 5])
    tables = np.array([1, 3, 2, 2, 1, 1, 16, 1])
    sizes = np.concatenate([np.append(np.ones(t - 1, np.int64), c - t + 1) for c, t in zip(customers, tables)])
    for _ in range(5):
        sizes, tables = P.reseated(sizes, tables, rng.random(8) * 3, 0.6, rng)
        assert sizes.min() > 0 and (np.add.reduceat(sizes, np.cumsum(tables) - tables) == customers).all()
    other = np.array([0, 1000, 3, 1, 10, 17, 0, 6])
    sizes, tables = P.changed(sizes, tables, other)
    assert np.bincount(np.repeat(np.arange(8), tables), sizes, 8).tolist() == other.tolist() and (sizes > 0).all()
    sizes, tables = P.changed(sizes, tables, customers)
    assert np.bincount(np.repeat(np.arange(8), tables), sizes, 8).tolist() == customers.tolist()


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def token_list(text):
    return [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in brute.words(text)] + [None]


def base_scores(rows):
    count = Counter(w for d, t, _ in rows if not held(d) for w in token_list(t))
    n, v = sum(count.values()), len(count)
    for d, t, _ in rows:
        w = token_list(t)
        yield d, held(d), len(w), sum(x in count for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)


def unpacked(df, *kinds):
    by = defaultdict(lambda: defaultdict(list))
    for r in of_kind(df, *kinds).orderBy("bucket", "kind", "source").collect():
        by[r["bucket"]][r["kind"]].append(pickle.loads(r["data"]))
    return by.values()


def hash_of(word):
    return int(P.END) if word is None else one_hash(word.encode())


def scores_from_tables(model, rows):
    """The scores that follow from the model's written tables, one token after another."""
    pairs, words, samples = {}, {}, len(model.roots)
    for got in unpacked(model.pairs, P.SINGLES, P.SEATS, P.PAIR_SAMPLE):
        u, w = P.paired(got[P.SINGLES][0])
        pairs |= {(int(a), int(b)): (1,) * (1 + samples) for a, b in zip(u, w)}
        u, w, tables, sizes = P.paired(got[P.SEATS][0])
        n = [sum(x.tolist()) for x in np.split(sizes, np.cumsum(tables)[:-1])]
        pairs |= {(int(a), int(b)): (n[i], *[int(t[0][i]) for t in got[P.PAIR_SAMPLE]]) for i, (a, b) in enumerate(zip(u, w))}
    for got in unpacked(model.words, P.FACTS, P.WORD_SAMPLE):
        keys, *columns = got[P.FACTS][0]
        columns += [c for arrays in got[P.WORD_SAMPLE] for c in arrays]
        words |= {int(k): tuple(int(c[i]) for c in columns) for i, k in enumerate(keys)}
    return [score_of(model, pairs, words, [hash_of(w) for w in token_list(t)]) for _, t, _ in rows], pairs, words


def probability(model, pairs, words, u, w):
    total = 0
    nothing = (0,) * (2 + 3 * len(model.roots))
    for s, root in enumerate(model.roots):
        k, t = words.get(w, nothing)[2 + 3 * s:4 + 3 * s]
        below, size = words.get(u, nothing)[4 + 3 * s], words.get(u, nothing)[1]
        new = (P.ROOT_STRENGTH + root.discount * root.tables) / (root.words + 1)
        parent = (k - root.discount * t + new) / (P.ROOT_STRENGTH + root.customers)
        c = pairs.get((u, w), (0,) * (1 + len(model.roots)))
        total += (c[0] - model.discount * c[1 + s] + (P.STRENGTH + model.discount * below) * parent) / (P.STRENGTH + size)
    return total / len(model.roots)


def score_of(model, pairs, words, w):
    return sum(math.log10(probability(model, pairs, words, u, x)) for u, x in zip([int(P.BEGIN), *w], w))


def language_rows():
    rows = document_rows()
    return rows + [(100 + i, brute.prose(i % 17, 80), "s") for i in range(90)] + [(300, "the " * 3000, "s"), (301, "the  the A a", "s")]


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_BYTES", 6000)  # several buckets
    monkeypatch.setattr(P, "BLOCK_TOKENS", 3000)
    rows = language_rows()
    work = Workspace(spark, "t")
    got = P.scored(with_clashes(documents(spark, rows)), work).collect()
    assert some((*r[:5], round(r["base_score"], 6)) for r in got) == some(base_scores(rows))
    learnt = [r for r in rows if not held(r[0])]
    model = P.fitted(documents(spark, learnt), Workspace(spark, "t"))
    want, pairs, words = scores_from_tables(model, rows)
    assert model.buckets > 3
    # the same rows in other partitions give the same model and the same scores
    assert some((r["doc_id"], round(r["score"], 6)) for r in got) == some((d, round(s, 6)) for (d, _, _), s in zip(rows, want))
    # tables are consistent: what a context's restaurant counts are its pairs, what the root serves are tables below
    for s, root in enumerate(model.roots):
        below, above = Counter(), Counter()
        for (u, w), c in pairs.items():
            below[u] += c[1 + s]
            above[w] += c[1 + s]
            assert 1 <= c[1 + s] <= c[0]
        assert all(v[2 + 3 * s] == above[w] and v[4 + 3 * s] == below[w] for w, v in words.items())
        assert root.customers == sum(above.values()) and root.tables == sum(v[3 + 3 * s] for v in words.values())
    # probabilities after a context, a rare one and an unknown one sum to one over all known words and the unknown one
    known = [w for w, v in words.items() if v[0]]
    for u in (int(P.BEGIN), hash_of("the"), hash_of("kazoo-unknown"), known[3]):
        assert abs(sum(probability(model, pairs, words, u, w) for w in [*known, 1]) - 1) < 1e-9
    # better than the base on what was held out
    out = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert len(out) > 5 and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_language_model_without_rows_to_learn_from(spark):
    assert P.scored(documents(spark, []), Workspace(spark, "t")).count() == 0
    d = next(i for i in range(100) if held(i))
    got = P.scored(documents(spark, [(d, "a b", "s"), (d, None, None)]), Workspace(spark, "t")).collect()
    assert some(got) == some([(d, True, 3, 0, 0, 0.0, 0.0), (d, True, 1, 0, 0, 0.0, 0.0)])


def test_words_of_a_bucket_meet_their_answers():
    r = np.random.default_rng(1)
    context, word = r.integers(0, 50, 200).astype(np.uint64), r.integers(0, 50, 200).astype(np.uint64)
    asked = P.Asked(context, word, 7)
    replies = [(int(h), [asked.keys[asked.home == h].astype(float) * 2]) for h in np.unique(asked.home)]
    (twice,) = asked.answer(replies)
    assert (twice[asked.word] == word * 2).all() and (twice[asked.context] == context * 2).all()
