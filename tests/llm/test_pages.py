"""HTML extraction, WARC and chat formatting."""

import base64
import gzip
import hashlib
import io
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codesift.llm import extract, rotation, warc
from codesift.llm.queries import QUERIES
from codesift.llm.boosting import fit
from codesift.llm.dom import Page
from codesift.llm.store import Workspace

from . import brute
from .frames import with_clashes

import numpy as np


def article(seed, lead=""):
    blocks = [brute.prose(seed * 100 + i, 8 + 5 * (i % 5)).replace("\n", " ") for i in range(9)]
    inner = f"<h1>{blocks[0]}</h1><p><b>" + "<p>".join(x + " &amp; more&nbsp;\n text" for x in blocks[1:])
    html = (f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/x'>x</a></li>"
            f"<li><a href=/y>y</a></ul></nav><!-- ad --><div class=ad>Buy it.</div><article>{lead}{inner}</article><footer>&copy; someone</footer>")
    return html, "\n\n".join([blocks[0]] + [" ".join((x + " & more text").split()) for x in blocks[1:]])


@pytest.fixture(scope="module")
def model():
    return extract.train([article(i)[0] for i in range(60)])


def test_extraction(spark, model):
    rows = [(i, f"u{i}", article(200 + i)[0]) for i in range(8)]
    rows += [(20, "u", None), (21, None, ""), (None, "u", "  "), (22, "u", "<nav><a href=x>menu</a></nav>"), (0, "u0", article(200)[0]),
             (23, "u", "<div>" * 3000 + "deep" + "</div>" * 10), (24, "u", "<![weird]><article><p>" + "text of it " * 40)]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = extract.main_texts(df, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = got.collect()
    assert len(texts) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in texts)
    by = {r["page_id"]: r["text"] for r in texts if r["page_id"] is not None}
    assert all(by[i] == article(200 + i)[1] for i in range(8))
    assert by[20] == by[21] == by[22] == ""
    assert extract.main_texts(df.limit(0), model).count() == 0


def test_extraction_on_held_out_dresses(model):
    r = random.Random(9)
    texts = [article(300 + i)[1].split("\n\n") for i in range(60)]
    other = [b for t in texts for b in t[:5]]
    hit = found = asked = 0
    for t in texts:
        marked = extract.dressed(r, t[:r.randint(2, 9)], other)
        page, told = Page(re.sub(r' data-keep-[01]=""', "", marked)), extract.Marked(marked)
        a = Counter(told.text([bool(x) for x in told.label]).split())
        b = Counter(page.text(extract.decode(page, model.logit(extract.features(page)))).split())
        hit += sum((a & b).values())
        found += sum(b.values())
        asked += sum(a.values())
    assert hit / found > 0.85 and hit / asked > 0.85


def other_page(r, blocks, junk):
    """A page of another make than those the model is trained on: other names, nesting and habits of markup."""
    def w(low, high):
        return " ".join(r.choice(junk).split()[:r.randint(low, high)])

    paragraphs = [f"<p>{b}" + r.choice(["</p>", ""]) for b in blocks[1:]]
    main = f"<h1 class=entry-title>{blocks[0]}</h1><div class=byline>{w(2, 4)}</div><div class='entry__text'>{''.join(paragraphs)}</div>"
    main = r.choice(["<article class=hentry>{}</article>", "<main id=maincontent><div>{}</div></main>", "<div class='postBody'>{}</div>",
                     "<section><article itemprop=articleBody>{}</article></section>"]).format(main)
    links = "".join(f"<li><a href=/{i}>{w(1, 3)}</a>" for i in range(r.randint(3, 12)))
    nav = r.choice([f"<nav id=primary><ul>{links}</ul></nav>", f"<div class=mainMenu><ul>{links}</ul></div>"])
    side = f"<aside class=rightCol><h3>{w(1, 3)}</h3><ul>{links}</ul></aside>"
    cookie = f"<div id=cookieBar><p>{w(8, 25)}<button>ok</button></div>"
    advert = f"<div class='ad-slot leaderboard'><span>{w(2, 9)}</span></div>"
    comments = f"<section id=comments><h2>{w(1, 2)}</h2>" + "".join(
        f"<div class=comment><b>{w(1, 2)}</b><p>{w(5, 40)}</div>" for _ in range(r.randint(1, 5))) + "</section>"
    foot = f"<footer class=site-footer><p>{w(3, 12)}</footer>"
    form = f"<form action=/s><label>{w(1, 3)}</label><input name=q></form>"
    parts = [x for x in (cookie, nav, form, advert) if r.random() < 0.7] + [main] + [x for x in (advert, side, comments, foot) if r.random() < 0.7]
    head = r.choice(["<!doctype html><html><head><meta charset=utf-8><title>t</title></head><body>", "<html><head><title>t</title><body>", "<title>t</title>"])
    return head + "\n".join(parts)


def share_found(pages, model):
    """Words of the articles found, and words found that are the articles'."""
    hit = found = asked = 0
    for html, blocks in pages:
        page = Page(html)
        a = Counter(" ".join(blocks).split())
        b = Counter(page.text(extract.decode(page, model.logit(extract.features(page)))).split())
        hit += sum((a & b).values())
        found += sum(b.values())
        asked += sum(a.values())
    return hit / asked, hit / found


def test_extraction_from_pages_of_another_make(model):
    r = random.Random(11)
    texts = [article(400 + i)[1].replace("&", "and").split("\n\n") for i in range(80)]
    junk = [b for t in texts for b in t[:4]]
    cut = [t[:r.randint(3, 9)] for t in texts]
    recall, precision = share_found([(other_page(r, t, junk), t) for t in cut], model)
    assert recall >= 0.9 and precision >= 0.9, (recall, precision)


def text_of(html, model):
    page = Page(html)
    return page.text(extract.decode(page, model.logit(extract.features(page))))


def test_a_head_without_end_tag_hides_nothing(model):
    html, want = article(500)
    for head in ("<head><title>t</title><style>p{}</style>", "<head><meta charset=utf-8>", "<head>", ""):
        changed = re.sub("<head>.*?</head>", head, html)
        assert text_of(changed, model) == want
    assert text_of(html.replace("</head><body>", ""), model) == want


def test_text_outside_any_element(model):
    blocks = article(501)[1].split("\n\n")[1:5]
    plain = [b.replace("&", "and") for b in blocks]
    for html in ("<br><br>".join(plain), " ".join(plain), "<html><body>" + "<br>".join(plain) + "</body></html>",
                 "<html><body></body></html>" + " ".join(plain), "<b>" + plain[0] + "</b> " + " ".join(plain[1:])):
        assert text_of(html, model).split() == " ".join(plain).split()
    page = Page("one <b>two</b> three<p>four</p>five<div>six</div>")
    assert page.text([True] * len(page.tag)) == "one two three\n\nfour\n\nfive\n\nsix"


def test_no_contradictions(model):
    r = random.Random(4)
    page = Page(extract.dressed(r, ["x y z"] * 6, ["some other words"] * 5))
    logit = np.array([r.uniform(-5, 5) for _ in page.tag])
    shown = extract.decode(page, logit)
    gain = np.clip(logit, -4, 4)
    # brute force over the tree: the best total of a choice closed upwards
    best = gain.copy()
    best[0] = 0
    for i in range(len(best) - 1, 0, -1):
        best[page.parent[i]] += max(0, best[i])
    kept = [True] + [False] * (len(best) - 1)
    for i in range(1, len(best)):
        kept[i] = kept[page.parent[i]] and best[i] > 0
    assert all(kept[i] for i, s in enumerate(shown) if s)


def test_boosting_learns_and_is_repeatable():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    a, b = fit(x[:3000], y[:3000], np.ones(3000), columns=0.6), fit(x[:3000], y[:3000], np.ones(3000), columns=0.6)
    assert ((a.logit(x[3000:]) > 0) == y[3000:]).mean() > 0.97 and (a.logit(x) == b.logit(x)).all()


PAGES = [(3, "http://x/3", "same"), (1, "http://x/1", "same"), (2, "u\r\nInjected: 1 é \"q\"", "other é"), (4, None, None), (5, "u5", ""),
         (None, "n", "same"), (None, "m", "only without id"), (6, "u6", "long " * 200_000), (7, "u7", "a\r\n\r\nb\x00c"), (1, "http://x/1", "same")]


def test_warc_round_trip(spark):
    df = with_clashes(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3))
    work = Workspace(spark, "t")
    archives = warc.write(df, f"{work.root}/warc", work)
    assert archives.agg(F.sum("records")).first()[0] == len(PAGES)
    got = warc.read(spark, archives, payloads=True).collect()
    first = {}
    for p, _, h in PAGES:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, u, h in PAGES:
        data = (h or "").encode()
        again = (h or "") in first and first[h or ""] != p
        want.append((p, u, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response",
                     first[h or ""] if again else None, True, None if again else bytearray(data)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    empty = warc.write(df.limit(0), f"{work.root}/none", work)
    assert warc.read(spark, empty).count() == 0


def test_warc_of_a_third_of_small_payloads(spark):
    work = Workspace(spark, "t")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.read(spark, warc.write(df, f"{work.root}/w", work, least_bytes=5)).filter("record_type = 'revisit'").count()
    assert got == 0


def test_each_record_is_a_gzip_member_and_damage_is_found():
    block = b"payload bytes " * 1000
    one = warc.page_record(1, "u", block, hashlib.sha1(block).digest(), None, False)
    two = warc.page_record(2, "u", block, hashlib.sha1(block).digest(), 1, True)
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\nWARC-Type: response")
    read = list(warc.records(io.BytesIO(one + two), payloads=True))
    assert [r["fields"]["WARC-Type"] for r in read] == ["response", "revisit"] and read[0]["bytes"] == block
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(one[:len(one) // 2])))
    wrong = gzip.compress(gzip.decompress(one).replace(b"Content-Length: ", b"Content-Length: 1", 1))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(wrong)))
    changed = gzip.compress(gzip.decompress(one)[:-10] + b"X" + gzip.decompress(one)[-9:])
    r = next(warc.records(io.BytesIO(changed)))
    assert r["block"] != r["fields"]["WARC-Block-Digest"]


TURNS = [(1, 0, "system", "be kind"), (1, 1, "user", "hello <|im_end|> there"), (1, 2, "assistant", "hi"), (1, 3, "anna", "me too\né"), (1, 4, "user", None),
         (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "assistant", ""), (3, 0, "system", "alone"), (None, 0, "user", "lost"), (None, 0, "user", "lost"),
         (4, None, "bob", "when"), (5, 1023, "user", "x"), (5, 1024, "assistant", "y"), (6, 0, None, "who"), (6, 1, "a\nb", "z")]


def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")


def test_rotation_renders_each_perspective(spark):
    got = {(r["conv_id"], r["segment"], r["perspective"]): r for r in rotation.rotated(with_clashes(turns(spark))).collect() if r["conv_id"]}
    assert set(got) == {(1, 0, "user"), (1, 0, "assistant"), (1, 0, "anna"), (2, 0, "user"), (2, 0, "assistant"), (4, None, "bob"), (5, 0, "user"),
                        (5, 1, "assistant"), (6, 0, "unnamed"), (6, 0, "a b")}
    r = got[(1, 0, "anna")]
    assert r["rendered"] == ("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=user\nhello < |im_end|> there<|im_end|>\n"
                             "<|im_start|>user name=assistant\nhi<|im_end|>\n<|im_start|>assistant\nme too\né<|im_end|>\n<|im_start|>user name=user\n<|im_end|>\n")
    assert [r["rendered"][s["start"]:s["end"]] for s in r["spans"]] == ["me too\né<|im_end|>"]
    user = got[(1, 0, "user")]
    assert [user["rendered"][s["start"]:s["end"]] for s in user["spans"]] == ["hello < |im_end|> there<|im_end|>", "<|im_end|>"]
    assert got[(2, 0, "user")]["n_turns"] == 2
    alone = [r for r in rotation.rotated(turns(spark)).collect() if r["conv_id"] is None]
    assert len(alone) == 2 and rotation.rotated(turns(spark).limit(0)).count() == 0


def test_rotation_against_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    placed = [t for t in TURNS if t[0] is not None and t[1] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", placed)
    df = rotation.digests(rotation.rotated_dialogues(turns(spark).filter("conv_id is not null and turn is not null")))
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(rotation.ORACLE).fetchall())


def test_every_speaker_has_the_whole_dialogue(spark, tmp_path):
    """Segments put together are the dialogue for all its speakers, also those silent in a segment."""
    rows = [t for t in TURNS if t[0] is not None and t[1] is not None]
    rows += [(7, 0, "system", "rules")] + [(7, i, "user" if i < 20 else "bob é", f"w{i} " * (i % 4)) for i in range(1, 40)]
    rows += [(7, i, "system", f"note {i}") for i in range(40, 60)] + [(8, 3, "user", f"same {i}") for i in range(25)] + [(8, 3, "anna", "x")]
    rows += [(9, 0, "user", "first"), (9, 5000, "anna", "last")]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema)
    want = {}
    for conv in {r[0] for r in rows}:
        said = sorted({(t, (r or "unnamed").replace("\n", " "), (x or "").replace("<|", "< |")) for c, t, r, x in rows if c == conv})
        for who in {r for _, r, _ in said} - {"system"}:
            text, spans = "", []
            for _, r, x in said:
                text += "<|im_start|>" + ("assistant" if r == who else r if r == "system" else "user name=" + r) + "\n"
                spans += [(len(text), len(text + x + "<|im_end|>"))] if r == who else []
                text += x + "<|im_end|>\n"
            want[conv, who] = (len(said), text, spans)
    for size in (7, 1024):
        parts = {}
        for r in sorted(rotation.rotated_dialogues(with_clashes(df), size).collect(), key=lambda r: r["segment"]):
            n, text, spans = parts.get((r["conv_id"], r["perspective"]), (0, "", []))
            assert r["n_turns"] <= size
            parts[r["conv_id"], r["perspective"]] = (n + r["n_turns"], text + r["rendered"], spans + [(s["start"], s["end"]) for s in r["spans"]])
        assert parts == want
    lost = rotation.rotated_dialogues(turns(spark)).filter("segment is null").collect()
    assert sorted((r["conv_id"] or 0, r["perspective"]) for r in lost) == [(0, "user"), (0, "user"), (4, "bob")]
    # the registered query: a speaker of the first 1,024 turn numbers has the later ones too
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["perspective"]): r["n_turns"] for r in QUERIES["op7_perspective_rotation"](spark, str(tmp_path)).collect()}
    assert got[5, "user"] == got[5, "assistant"] == got[9, "user"] == 2


def test_whole_dialogues_against_duckdb(spark, tmp_path):
    """Longer than a segment, numbered with gaps, with rows that have no place: the query's SQL holds for all of it."""
    duckdb = pytest.importorskip("duckdb")
    said = [(1, 3 * i, ["anna", "ben", "system", "cleo"][i % 4], f"word {i} <|x|>") for i in range(2500)]
    said += [(2, 5_000_000, "anna", "late"), (2, 1, "system", None), (3, 0, "system", "only"), (None, 1, "ben", "lost"), (None, 1, "ben", "lost"),
             (4, None, None, "nowhere"), (5, None, "system", "nowhere"), (1, 0, "anna", "word 0 <|x|>")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")

    def ordered(rows):
        return sorted((tuple(r) for r in rows), key=lambda r: tuple(str(x) for x in r))
    got = QUERIES["op7_perspective_rotation"](spark, str(tmp_path)).collect()
    assert ordered(got) == ordered(con.execute(rotation.ORACLE).fetchall())
    assert sum(r["conv_id"] == 1 for r in got) == 9 and sum(r["segment"] is None for r in got) == 3
