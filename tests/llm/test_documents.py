"""Operators on documents against brute force."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesift.llm import debruijn, minhash, mixing, quality, sharding, templates, tokens
from codesift.llm.components import components
from codesift.llm.store import Workspace
from codesift.llm.words import Chunk, WordHash

from . import brute
from .frames import document_rows, documents, with_clashes


def some(rows):
    return sorted(map(tuple, rows), key=str)


def test_near_duplicates(spark):
    rows = document_rows()
    df = with_clashes(documents(spark))
    got = minhash.near_duplicates(df, Workspace(spark, "t")).collect()
    want = brute.components([r[:2] for r in rows])
    assert some((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == some((*w, w[0] == w[2]) for w in want)
    assert len({w[2] for w in want}) < len(rows) - 10


def test_near_duplicates_of_an_empty_table(spark):
    got = minhash.near_duplicates(documents(spark, []), Workspace(spark, "t"))
    assert got.columns == ["doc_id", "key", "n_shingles", "component_id", "kept"] and got.count() == 0


def test_a_group_without_a_middle_is_whole(spark):
    """A chain: each text links with its neighbours only."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[k * 12:k * 12 + 120]), "s") for k in range(20)]
    got = minhash.near_duplicates(documents(spark, rows), Workspace(spark, "t")).collect()
    assert some((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == some(brute.components([r[:2] for r in rows]))
    assert {r["component_id"] for r in got} == {81}


def test_strays_in_large_buckets(spark, monkeypatch):
    """Many blocks of the rest and of the largest component: no link is lost, and a stray costs one row a member."""
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 5)
    r = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:100] + [f"x{i}y{k}" for k in range(r.randint(0, 3))]), "s") for i in range(60)]
    rows += [(100 + i, " ".join(base[20:] + [f"z{i}", f"z{i + 1}"]), "s") for i in range(25)]
    rows += [(200 + i, " ".join(base[:60] + [f"q{i}k{k}" for k in range(20)]), "s") for i in range(12)]
    got = minhash.near_duplicates(documents(spark, rows), Workspace(spark, "t")).collect()
    assert some((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == some(brute.components([x[:2] for x in rows]))


def test_signature_agreement_estimates_similarity():
    r = random.Random(3)
    for share in (0.3, 0.6, 0.9):
        a = [r.getrandbits(64) for _ in range(2000)]
        b = a[:int(share * 2000)] + [r.getrandbits(64) for _ in range(2000 - int(share * 2000))]
        j = share / (2 - share)
        sets = np.array(sorted(a) + sorted(b), np.uint64)
        s = minhash.signatures(sets, np.array([2000, 4000]), 1024)
        assert abs((s[0] == s[1]).mean() - j) < 0.06


def test_components_of_chains_rings_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (102, 100)] + [(200, 200 + i) for i in range(1, 50)] + [(7, 7)]
    edges = [(f"{a:04d}".encode(), f"{b:04d}".encode()) for a, b in edges]
    got = components(spark.createDataFrame(edges, "a binary, b binary"), Workspace(spark, "t"), "c").collect()
    label = {int(r["node"]): int(r["label"]) for r in got}
    assert label == {**{i: 0 for i in range(61)}, **{i: 100 for i in (100, 101, 102)}, **{i: 200 for i in range(200, 250)}}


def test_quality(spark):
    rows = [r for r in document_rows() if r[0] != 70]
    got = quality.decisions(with_clashes(documents(spark, rows))).collect()
    want = [(d, brute.quality(t)) for d, t, _ in rows]
    names = list(want[0][1])
    assert some((r["doc_id"], *[r[n] for n in names]) for r in got) == some((d, *[w[n] for n in names]) for d, w in want)
    assert {r["kept"] for r in got} == {True, False}
    assert quality.decisions(documents(spark, [])).count() == 0


def test_quality_keeps_whole_rows(spark):
    df = with_clashes(documents(spark))
    kept = quality.passing(df)
    assert kept.schema == df.schema
    want = [r for r in document_rows() if r[0] == 70 or brute.quality(r[1])["kept"]]
    assert some((r["doc_id"], r["text"]) for r in kept.collect()) == some(r[:2] for r in want)


def test_maximal_repeats_are_what_a_search_finds(spark):
    r = random.Random(5)
    for _ in range(60):
        w = [r.choice("abc").encode() for _ in range(r.randint(0, 40))]
        c = Chunk([0], [b""], [WordHash().of(w)]).close()
        s = quality.suffixes(c)
        got = set()
        for low, high, n in quality.maximal_repeats(c, s, 2):
            at = sorted(s.order[low:high + 1].tolist())
            assert len({tuple(w[i:i + n]) for i in at}) == 1
            got.add((tuple(w[at[0]:at[0] + n]), tuple(at)))
        want = set()
        for n in range(2, len(w)):
            by = defaultdict(list)
            for i in range(len(w) - n + 1):
                by[tuple(w[i:i + n])].append(i)
            for key, at in by.items():
                right = {w[i + n] if i + n < len(w) else i for i in at}
                left = {w[i - 1] if i else -1 for i in at}
                if len(at) > 1 and len(right) > 1 and len(left) > 1:
                    want.add((key, tuple(at)))
        assert got == want


def test_repeats_as_spans(spark):
    text = "a b c d e f g h X a b c d e f g h"
    got = quality.repeats(documents(spark, [(1, text, "s"), (2, None, "s")]), 4).collect()
    assert some(got) == [(1, 0, 0, 8), (1, 0, 9, 8)]


def test_mixing(spark):
    rows = document_rows()
    df = with_clashes(documents(spark))
    got = mixing.mixed(df, Workspace(spark, "t")).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(brute.words(t))
    assert some((r["doc_id"], r["size"], r["source_size"]) for r in got) == some((d, len(brute.words(t)), size[s]) for d, t, s in rows)
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, rest, free = {}, 1.5 * sum(size.values()), set(names)
    while True:
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            rest -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    by_size = {size[s]: target[s] for s in names}
    assert all(abs(r["target"] - by_size[r["source_size"]]) < 1e-6 for r in got)
    assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in got)
    assert some(got) == some(mixing.mixed(df.repartition(7), Workspace(spark, "t")).collect())
    assert mixing.mixed(documents(spark, []), Workspace(spark, "t")).count() == 0


def test_mixing_comes_near_its_targets(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(1, 60), f"s{i % 4}") for i in range(2000)]
    got = mixing.mixed(documents(spark, rows), Workspace(spark, "t")).collect()
    taken, target = Counter(), {}
    for x in got:
        taken[x["source_size"]] += x["taken"]
        target[x["source_size"]] = x["target"]
    assert all(abs(taken[s] - target[s]) < 0.01 * target[s] for s in target)
    assert all(abs(x["copies"] - x["target"] / x["source_size"]) < 1 for x in got)


def test_mixing_copies_by_prefix_sums(spark):
    """Each copy is an integer that the expected copies pass, from one offset of the source."""
    import math
    df = documents(spark)
    got = defaultdict(list)
    for x in mixing.mixed(df, Workspace(spark, "t"), carry=("source",)).collect():
        got[x["source"]].append(x)
    hashes = df.select("source", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("h"), "doc_id", mixing.word_count(F.col("text")).alias("size"))
    order = defaultdict(list)
    for x in hashes.collect():
        order[x["source"]].append((x["size"], x["h"], x["doc_id"] if x["doc_id"] is not None else -1))
    for number, source in enumerate(sorted(order, key=lambda s: (s is None, s))):
        start = spark.range(1).select(F.xxhash64(F.lit(mixing.SEED + 1), F.lit(number).cast(
            dict(mixing.source_targets(df.select("source", F.length("lang").alias("size")), Workspace(spark, "t")).dtypes)["source_key"])).alias("h")).first()["h"]
        u = ((start % (1 << 64)) >> 11) / (1 << 53)
        first = got[source][0]
        e = first["target"] / first["source_size"] if first["source_size"] else 0.0
        want = [(d if d >= 0 else None, z, math.floor(e * (k + 1) + u) - math.floor(e * k + u)) for k, (z, _, d) in enumerate(sorted(order[source]))]
        assert some((x["doc_id"], x["size"], x["copies"]) for x in got[source]) == some(want)
        assert abs(sum(x["taken"] for x in got[source]) - first["target"]) <= max(x["size"] for x in got[source])


def test_sharding(spark):
    rows = document_rows()
    df = with_clashes(documents(spark))
    got = sharding.sharded(df, Workspace(spark, "t"), carry=("lang",)).collect()
    assert some((r["doc_id"], r["size"], r["text_crc32"], r["lang"]) for r in got) == some(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "xx") for d, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.sharded(df.repartition(3), Workspace(spark, "t"), carry=("lang",)).collect()
    assert some(got) == some(again)
    assert sharding.sharded(documents(spark, []), Workspace(spark, "t")).count() == 0


def test_matrix_has_the_sums_and_the_spread_of_a_shuffle():
    rows = [500, 1, 0, 1499, 700]
    seen = np.array([sharding.matrix(rows, 4, seed) for seed in range(300)])
    assert (seen.sum(2) == rows).all() and (seen.sum(1) == 675).all()
    mean, var = seen[:, 0, 0].mean(), seen[:, 0, 0].var()
    want = 500 * (1 / 4) * (3 / 4) * (2700 - 500) / 2699
    assert abs(mean - 125) < 4 and 0.6 * want < var < 1.5 * want
    big = sharding.hypergeometric(np.random.default_rng(1), 10**11, 15 * 10**11, 10**8)
    assert abs(big - 10**8 / 16) < 6 * (10**8 * 15 / 256) ** 0.5


def test_substring_dedup(spark):
    rows = document_rows()
    got = debruijn.without_repeats(with_clashes(documents(spark)), Workspace(spark, "t"), texts=True)
    assert some(tuple(r)[:4] for r in got.collect()) == some(brute.without_repeats([r[:2] for r in rows]))
    assert debruijn.without_repeats(documents(spark, []), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_of_shuffled_passages(spark, seed):
    """Texts put together from few passages, cut anywhere: many branches, rings and repeats inside a text."""
    r = random.Random(seed)
    parts = [[f"p{k}w{i}" for i in range(r.randint(5, 40))] for k in range(12)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(parts)
            a = r.randrange(len(p))
            w += p[a:a + r.randint(1, 40)] if r.random() < 0.5 else p
        rows.append((d, " ".join(w), "s"))
    got = debruijn.without_repeats(documents(spark, rows), Workspace(spark, "t")).collect()
    assert some(got) == some(brute.without_repeats([x[:2] for x in rows]))


def test_paths_join_pieces_at_plain_nodes(spark):
    rows = [(1, 10, 20, 3), (2, 20, 30, 2), (3, 30, 40, 1), (4, 40, 50, 1), (5, 40, 60, 1), (6, 70, 80, 1), (7, 80, 70, 1)]
    got = debruijn.paths(spark.createDataFrame(rows, "piece long, first long, last long, n int"), Workspace(spark, "t")).collect()
    path = {r["piece"]: (r["path"], r["place"]) for r in got}
    assert [path[i] for i in (1, 2, 3, 4, 5)] == [(1, 0), (1, 3), (1, 5), (4, 0), (5, 0)]


ITEMS = [(0, "A train leaves Paris at 9 with 120 people. It meets Anna after 35 km near the old bridge and stops for 9 minutes."),
         (1, brute.prose(500, 30)), (2, "What is the capital of Peru now"), (3, None), (4, ""), (5, "12 13 14")]


def leaked(spark, rows, bound=templates.BROADCAST_WINDOWS):
    items = with_clashes(spark.createDataFrame(ITEMS, "item_id long, text string"))
    got = templates.leaks(with_clashes(documents(spark, rows)), items, Workspace(spark, "t"), bound).collect()
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["item_windows"], r["reparameterised"]) for r in got}


def test_decontamination(spark):
    same = ITEMS[0][1]
    other = same.replace("120", "77").replace("Paris", "Rome").replace("Anna", "Bob").replace("9", "4").replace("km", "miles")
    broken = same.replace("with 120", "with 120").replace("for 9 minutes", "for 8 minutes")
    rows = [(1, brute.prose(1, 60) + " " + same + " " + brute.prose(2, 60), "s"), (2, brute.prose(3, 50) + ".\n" + other, "s"),
            (3, brute.prose(4, 80), "s"), (4, None, "s"), (5, "", "s"), (6, ITEMS[1][1].upper(), "s"),
            (7, "So: what is the capital of Peru, now", "s"), (8, broken, "s"), (None, same, "s"), (1, brute.prose(1, 60) + " " + same + " " + brute.prose(2, 60), "s"),
            (9, "20 21 22 23 24 25", "s"), (10, brute.prose(9, 5000) + " " + same, "s")]
    got = leaked(spark, rows)
    assert set(got) == {(1, 0), (2, 0), (6, 1), (7, 2), (None, 0), (10, 0), (8, 0)}
    assert got[(1, 0)][0] >= got[(1, 0)][1] - 1 and not got[(1, 0)][2]  # "A" follows a word, not a full stop
    assert got[(2, 0)] == (got[(2, 0)][1], got[(2, 0)][1], True)
    assert leaked(spark, rows, 0) == got
    assert leaked(spark, []) == {}


def test_one_contradiction_costs_only_the_windows_that_hold_it(spark):
    same = ITEMS[0][1]
    broken = same.replace("for 9 minutes", "for 8 minutes")
    other = broken.replace("120", "77").replace("Anna", "Bob").replace("at 9", "at 4")
    got = leaked(spark, [(1, broken, "s"), (2, other, "s"), (3, "At 3 " + brute.prose(1, 30), "s")])
    n = got[(1, 0)][1]
    assert set(got) == {(1, 0), (2, 0)} and all(x == (n, n, True) for x in got.values())
    # both occurrences in one window: that window is lost, the verbatim rest stays
    items = spark.createDataFrame([(0, "we take 9 of the red ones and 9 of the blue ones home then we sing to all of our good friends")], "item_id long, text string")
    docs = documents(spark, [(1, "we take 9 of the red ones and 8 of the blue ones home then we sing to all of our good friends", "s")])
    (row,) = templates.leaks(docs, items, Workspace(spark, "t")).collect()
    assert 8 <= row["n_windows"] < row["item_windows"]


def found_items(spark, items, texts, bound=templates.BROADCAST_WINDOWS):
    rows = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, [(d, t, "s") for d, t in enumerate(texts)])
    return {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in templates.leaks(docs, rows, Workspace(spark, "t"), bound).collect()}


def test_items_with_few_literals_are_found_verbatim(spark):
    items = ["What is 12 + 7 * 3 - 5?", "12 13 14", "Find 7 more", "5 km, 3 miles and 200 g"]
    around = [f"{brute.prose(d, 20)} so {item} {brute.prose(50 + d, 20)}" for d, item in enumerate(items)]
    texts = around + ["What is 11 + 8 * 3 - 5?", "12 13 15", "Find 8 more", "5 km, 4 miles and 200 g"]
    assert found_items(spark, items, texts) == {(d, d): False for d in range(4)} == found_items(spark, items, texts, 0)


def test_names_at_the_start_of_sentences_and_of_several_words(spark):
    items = ["Alice has 5 apples. Bob gives her 3 more. Carol takes 2 of them. How many are left?",
             "How far is it from Boston to Paris by train?", "Sum over twenty of the red ones and two of the rest",
             "Anna Smith and the green dog are here now"]
    other = ["Dora has 6 apples. Evan gives her 4 more. Fred takes 2 of them. How many are left?",
             "How far is it from New York to Rome by train?", "Sum over twenty five of the red ones and three of the rest",
             "as we said anna smith and the green dog are here now"]
    assert found_items(spark, items, other) == {(0, 0): True, (1, 1): True, (2, 2): True, (3, 3): False}
    again = [f"{brute.prose(d, 20)} so {item} {brute.prose(50 + d, 20)}" for d, item in enumerate(items)]
    again += [x.lower() for x in again]
    assert found_items(spark, items, again) == {(d, d % 4): False for d in range(8)} == found_items(spark, items, again, 0)


def test_token_counts(spark):
    counter = tokens.Counter(tokens.vocabulary(tokens.VOCABULARY))
    rows = document_rows() + [(80, "mail a.b@c.de now\nkey 0123456789abcdef0123456789abcdef\nsame line\nsame line\n\n\n10.0.0.1  x", "s")]
    got = tokens.counted(with_clashes(documents(spark, rows)), texts=True).collect()
    assert some((r["doc_id"], r["n_tokens"]) for r in got) == some((d, len(counter.encode(t or ""))) for d, t, _ in rows)
    for r in got:
        assert r["n_tokens_edited"] == len(counter.encode(r["edited"])) and r["n_chars_edited"] == len(r["edited"])
        assert r["n_edits"] or r["n_tokens_edited"] == r["n_tokens"]
    mail = next(r for r in got if r["doc_id"] == 80)
    assert mail["edited"] == "mail <masked> now\nkey <masked>\nsame line\n\n\n<masked>  x" and mail["n_reencoded"] < mail["n_pretokens"]
    assert tokens.counted(documents(spark, [])).count() == 0


def test_edits_equal_a_new_count():
    r, counter = random.Random(1), tokens.Counter(tokens.vocabulary(tokens.VOCABULARY))
    signs = ["a", "b", "é", " ", "  ", "\n", " \n", "'", "'s", "'ll", "12", "3", ".", "!!", "\t", "x y", "日本"]
    for turn in range(3000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 900 if turn % 20 == 0 else 40)))
        tree = tokens.build(text, counter)
        for _ in range(3):
            a = r.randint(0, len(text))
            b = r.randint(a, min(len(text), a + r.choice([0, 1, 3, 30])))
            new = "".join(r.choice(signs) for _ in range(r.choice([0, 1, 2, 8])))
            want = text[:a] + new + text[b:]
            text, _ = tokens.edit(tree, text, a, b, new, counter)
            pieces = tokens.CUT.findall(want)
            assert text == want and [n for block in tree.blocks for n in block[0]] == list(map(len, pieces))
            assert tree.total.tolist() == [len(want), len(pieces), len(counter.encode(want))]


def test_an_edit_encodes_little_again():
    counter = tokens.Counter(tokens.vocabulary(tokens.VOCABULARY))
    text = brute.prose(4, 20000)
    tree = tokens.build(text, counter)
    _, again = tokens.edit(tree, text, 5000, 5010, "new words", counter)
    assert again < 12


def test_edits_without_punctuation_stay_local():
    """10,000 edits of a text of nothing but words and spaces: a few pre-tokens each, in time linear in the text."""
    counter = tokens.Counter(tokens.vocabulary(tokens.VOCABULARY))
    seconds = []
    for n in (10_000, 40_000):
        text = " ".join(f"word{chr(97 + i % 26)}" for i in range(2 * n))
        edits = [(m.start(), m.end(), "other") for m in list(re.finditer("wordc", text))[::-1]]
        edits = (edits + [(i, i, "") for i in range(edits[-1][0] - 1, 0, -1)])[:n]
        tree = tokens.build(text, counter)
        began = time.process_time()
        got, again = tokens.edit_all(tree, text, edits, counter)
        seconds.append(time.process_time() - began)
        want = text.replace("wordc", "other")
        assert got == want and tree.total.tolist() == [len(want), len(tokens.CUT.findall(want)), len(counter.encode(want))]
        assert again <= 4 * len(edits)
    many = [(i, i + 1, "x") for i in range(0, 120_000, 12)][::-1]
    text = brute.prose(3, 30_000).replace(".", "").replace("\n", " ")[:120_001]
    tree = tokens.build(text, counter)
    worst = 0
    for start, end, new in many:
        text, again = tokens.edit(tree, text, start, end, new, counter)
        worst = max(worst, again)
    assert len(many) == 10_000 and worst <= 12
    assert tree.total.tolist() == [len(text), len(tokens.CUT.findall(text)), len(counter.encode(text))]
    assert seconds[1] < 8 * seconds[0] + 1


def test_repeated_lines_cost_what_they_hold():
    counter = tokens.Counter(tokens.vocabulary(tokens.VOCABULARY))
    line = " ".join(f"w{i}" for i in range(9))
    for n in (99, 799, 5000):
        text = "\n".join([line] * n)
        tree = tokens.build(text, counter)
        got, again = tokens.edit_all(tree, text, tokens.cleaning_edits(text), counter)
        assert got == line and again <= 6 * n
        assert tree.total[tokens.TOKENS] == len(counter.encode(line))


def test_all_edits_equal_a_new_count():
    r, counter = random.Random(7), tokens.Counter(tokens.vocabulary(tokens.VOCABULARY))
    signs = ["a", "é", " ", "  ", "\n", " \n", "'", "'s", "'l", "l", "r", "e", "12", "!!", "\t", "x y", "日本", " " * 40, "b" * 70]
    for _ in range(1500):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 60)))
        cuts = sorted(r.randint(0, len(text)) for _ in range(2 * r.randint(0, 5)))
        edits = [(a, b, "".join(r.choice(signs) for _ in range(r.choice([0, 1, 3])))) for a, b in zip(cuts[::2], cuts[1::2])][::-1]
        want = text
        for a, b, new in edits:
            want = want[:a] + new + want[b:]
        tree = tokens.build(text, counter)
        got, _ = tokens.edit_all(tree, text, edits, counter)
        assert got == want and [n for block in tree.blocks for n in block[0]] == list(map(len, tokens.CUT.findall(want)))
        assert tree.total.tolist() == [len(want), len(tokens.CUT.findall(want)), len(counter.encode(want))]
