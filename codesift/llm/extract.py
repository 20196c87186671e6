"""Main text of HTML pages: boosted trees over DOM-node features and one decision for the whole tree.

The model is trained on a bounded sample of the pages themselves.  Their articles are dressed anew with menus,
notices, sidebars, adverts, forms and comments in many spellings, so the right label of every node is known.
"""

from __future__ import annotations

import html as escaping
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shipped
from .boosting import Boosted, fit
from .dom import BLOCK, Page

shipped(__name__)

# production parameters
SAMPLE_PAGES = 300  # pages the model is trained on, at most
DRESSED = 5  # times each of them is dressed anew
SEED = 4
PAGES_AT_ONCE = 256

# fixed values: words in class, id and role attributes, by what they tell
TOKENS = {
    "content": "article content post entry story body main text blog prose paragraph richtext".split(),
    "menu": "nav menu navbar navigation navigations breadcrumb breadcrumbs pagination pager tabs skip toc links".split(),
    "head": "header masthead topbar logo branding hero tagline".split(),
    "foot": "footer copyright colophon legal imprint bottom".split(),
    "side": "sidebar side aside rail widget widgets related recommended popular trending complementary more teaser teasers".split(),
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe signup paywall privacy hidden toast".split(),
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner commercial dfp".split(),
    "form": "form search login register contact captcha poll feedback".split(),
    "comment": "comment comments commentlist disqus reply replies respond discussion thread reviews".split(),
    "share": "share sharing social follow tools toolbar meta tags author byline print".split(),
}
KIND = {token: i for i, tokens in enumerate(TOKENS.values()) for token in tokens}
TAGS = ["article", "main", "nav", "header", "footer", "aside", "form", "p", "heading", "list", "li", "a", "table", "div", "section", "inline", "other"]
TAG = {t: TAGS.index(g) for g, names in {
    "article": "article", "main": "main", "nav": "nav menu", "header": "header hgroup", "footer": "footer", "aside": "aside dialog", "form": "form fieldset label legend",
    "p": "p blockquote pre", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl", "li": "li dt dd", "a": "a",
    "table": "table tbody thead tr td th", "div": "div", "section": "section figure figcaption",
    "inline": "b i em strong span u s small code sub sup mark q cite abbr time font"}.items() for t in names.split()}
WIDTH = 2 * len(TAGS) + 2 * len(TOKENS) + 15


def features(page: Page) -> np.ndarray:
    """A row per node: what it is, what its ancestors are, and the size and density of its subtree and siblings."""
    n = len(page.tag)
    parent = np.array(page.parent)
    tag = np.array([TAG.get(t, len(TAGS) - 1) for t in page.tag])
    own = np.zeros((n, len(TOKENS)), np.float32)
    for i, names in enumerate(page.names):
        for token in names:
            if token in KIND:
                own[i, KIND[token]] = 1
    size = np.zeros(n)
    for node, data in page.pieces:
        if data:
            size[node] += len(data) - data.count(" ") * 0.5 if not data.isspace() else 0
    direct = size.copy()
    is_a, is_p, is_li = tag == TAGS.index("a"), tag == TAGS.index("p"), tag == TAGS.index("li")
    linked, total = np.zeros(n), direct.copy()
    links, paragraphs, items, nodes = is_a.astype(float), is_p.astype(float), is_li.astype(float), np.ones(n)
    for i in range(n - 1, 0, -1):  # children before parents
        p = page.parent[i]
        total[p] += total[i]
        linked[p] += total[i] if is_a[i] else linked[i]
        links[p] += links[i]
        paragraphs[p] += paragraphs[i]
        items[p] += items[i]
        nodes[p] += nodes[i]
    linked[is_a] = total[is_a]
    depth, above, under = np.zeros(n), np.zeros((n, len(TOKENS)), np.float32), np.zeros((n, len(TAGS)), np.float32)
    kids, order = np.zeros(n), np.zeros(n)
    for i in range(1, n):  # parents before children
        p = page.parent[i]
        depth[i] = depth[p] + 1
        above[i] = np.maximum(above[p], own[p])
        under[i] = under[p]
        under[i, tag[p]] = 1
        order[i] = kids[p]
        kids[p] += 1
    up = np.maximum(parent, 0)
    whole = max(1.0, total[0])
    one = np.zeros((n, len(TAGS)), np.float32)
    one[np.arange(n), tag] = 1
    mean_sibling = (total[up] - direct[up]) / np.maximum(1, kids[up])
    rest = np.stack([
        depth, np.log1p(total), np.log1p(direct), linked / np.maximum(1, total), np.log1p(links), np.log1p(paragraphs), np.log1p(items),
        np.log1p(nodes), total / nodes, total / whole, total / np.maximum(1, total[up]), order / np.maximum(1, kids[up]), np.log1p(kids[up]),
        total / np.maximum(1, mean_sibling), np.log1p(kids)], axis=1)
    return np.concatenate([one, under, own, above, rest], axis=1).astype(np.float32)


def decode(page: Page, logit: np.ndarray) -> list[bool]:
    """Which nodes show their own text: the best choice in which nobody is kept below a dropped ancestor.

    Keeping a node gains its (bounded) logit; a node is kept when that and the gains of the children worth keeping
    are positive together.  A kept node that is itself unlikely is a mere wrapper: its own words are not shown.
    """
    gain = np.clip(logit, -4, 4)
    gain[0] = 0
    value = gain.tolist()
    for i in range(len(value) - 1, 0, -1):
        if value[i] > 0:
            value[page.parent[i]] += value[i]
    kept = [True] * len(value)
    for i in range(1, len(value)):
        kept[i] = kept[page.parent[i]] and value[i] > 0
    inline = [t not in BLOCK for t in page.tag]
    shown = [False] * len(value)
    for i in range(1, len(value)):
        # words in bold or a link belong to the block they stand in
        shown[i] = kept[i] and (gain[i] > 0 or inline[i] and shown[page.parent[i]])
    return shown


# ---- training pages ----------------------------------------------------------------
KEEP, DROP = "data-keep-1", "data-keep-0"


def _tagged(r: random.Random, keep: bool, tag: str, kind: str | None, inner: str) -> str:
    names = ""
    if kind and r.random() < 0.85:
        token = r.choice(TOKENS[kind])
        spelling = r.choice(["{}", "{}-box", "site-{}", "{}-wrap", "js-{} block", "{} clearfix", "c-{}__inner", "l{}"[:0] + "{}"])
        names = f' {r.choice(["class", "class", "id"])}="{spelling.format(token)}"'
    elif r.random() < 0.3:
        names = f' class="{r.choice(["row", "col-8", "inner", "wrap", "container", "x1", "box"])}"'
    return f'<{tag}{names} {KEEP if keep else DROP}="">{inner}</{tag}>'


def dressed(r: random.Random, paragraphs: list[str], other: list[str]) -> str:
    """A page around an article, every element marked with its label."""
    def words(low: int, high: int) -> str:
        w = r.choice(other).split() or ["x"]
        return " ".join(w[:r.randint(low, high)])

    def link(keep: bool, low: int = 1, high: int = 4) -> str:
        return f'<a href="/" {KEEP if keep else DROP}="">{words(low, high)}</a>'

    def no(tag: str, kind: str | None, inner: str) -> str:
        return _tagged(r, False, tag, kind, inner)

    def menu() -> str:
        items = "".join(no("li", None, link(False)) for _ in range(r.randint(2, 9)))
        tag = r.choice(["nav", "nav", "div", "ul"])
        return no(tag, "menu", items if tag == "ul" else no("ul", None, items))

    def texts(low: int, high: int) -> str:
        return "".join(no(r.choice(["p", "p", "div", "span"]), None, words(3, 40)) for _ in range(r.randint(low, high)))

    def head() -> str:
        return no(r.choice(["header", "header", "div"]), "head", no(r.choice(["h1", "div", "a", "p"]), None, words(1, 5)) + (menu() if r.random() < 0.5 else "") + (texts(1, 1) if r.random() < 0.4 else ""))

    def advert() -> str:
        return no(r.choice(["div", "div", "aside", "section", "ins"]), "advert", words(2, 25) if r.random() < 0.5 else texts(1, 3))

    def notice() -> str:
        return no(r.choice(["div", "section", "aside", "dialog"]), "notice", texts(1, 2) + (link(False) if r.random() < 0.5 else ""))

    def side() -> str:
        parts = [no(r.choice(["h2", "h3", "div"]), None, words(1, 4)), no("ul", None, "".join(no("li", None, link(False, 3, 10)) for _ in range(r.randint(2, 8))))]
        if r.random() < 0.5:
            parts.append(texts(1, 3))
        return no(r.choice(["aside", "aside", "div", "section"]), "side", "".join(parts))

    def form() -> str:
        return no(r.choice(["form", "form", "div"]), "form", no("label", None, words(1, 4)) + (texts(1, 1) if r.random() < 0.5 else ""))

    def share() -> str:
        return no("div", "share", "".join(link(False, 1, 2) for _ in range(r.randint(2, 5))))

    def comments() -> str:
        one = "".join(no(r.choice(["div", "li", "article"]), "comment" if r.random() < 0.7 else None,
                         no(r.choice(["span", "b", "h4", "cite"]), None, words(1, 3)) + texts(1, 3)) for _ in range(r.randint(1, 8)))
        return no(r.choice(["div", "section", "section", "ol"]), "comment", no(r.choice(["h2", "h3"]), None, words(1, 3)) + one)

    def foot() -> str:
        return no(r.choice(["footer", "footer", "div"]), "foot", (words(3, 15) if r.random() < 0.5 else texts(1, 2)) + (menu() if r.random() < 0.4 else ""))

    def yes(tag: str, inner: str) -> str:
        return f'<{tag} {KEEP}="">{inner}</{tag}>'

    def inline(p: str) -> str:
        """Some words of a paragraph in bold or in a link."""
        if r.random() > 0.2:
            return p
        w = p.split()
        i = r.randrange(len(w)) if w else 0
        return " ".join(w[:i] + [yes(r.choice(["b", "em", "span", "a", "strong"]), " ".join(w[i:i + r.randint(1, 6)]))] + w[i + 6:])

    def cut(p: str) -> str:
        """Paragraphs of any length: as they are, or some of their words."""
        w = p.split()
        return p if r.random() < 0.5 else " ".join(w[:r.randint(1, 30)])

    body = []
    for i, p in enumerate(paragraphs):
        p = inline(escaping.escape(cut(p)))
        kind = r.choice(["h1", "h1", "h2"]) if i == 0 else r.choices(
            ["p", "heading", "list", "blockquote", "div", "table", "pre", "figure"], [66, 10, 9, 4, 4, 4, 1, 2])[0]
        few = [escaping.escape(words(1, 12)) for _ in range(r.randint(1, 6))]
        if kind == "list":
            p = yes(r.choice(["ul", "ol"]), "".join(yes("li", x) for x in [p, *few]))
        elif kind == "table":
            p = yes("table", "".join(yes("tr", "".join(yes("td", x) for x in (y, *few[:2]))) for y in [p, *few[2:]]))
        elif kind == "figure":
            p = yes("figure", yes("figcaption", p))
        elif kind == "heading":
            p = yes(r.choice(["h2", "h3", "h4"]), " ".join(p.split()[:8]) if "<" not in p else p)
        else:
            p = yes(kind, p)
        body.append(p)
        if r.random() < 0.06:
            body.append(r.choice([advert, share, form, notice, side])())
    if r.random() < 0.3:
        body[0] = yes("header", body[0])
    if r.random() < 0.15:
        body.append(r.choice([comments, form, share, side])())
    article = _tagged(r, True, *r.choice([("article", None), ("article", "content"), ("article", None), ("main", "content"), ("main", None), ("div", "content"),
                                          ("div", "content"), ("div", None), ("section", "content")]), "".join(body))
    loose = r.random()
    if loose < 0.08:  # blocks that stand in the page itself
        article = "".join(body)
    elif loose < 0.14:  # not even blocks: words and breaks
        article = "<br><br>\n".join(inline(escaping.escape(p)) for p in paragraphs)
    for _ in range(0 if loose < 0.14 else r.choice([0, 0, 1, 1, 2, 3])):
        extra = r.choice([side, share, comments, advert])() if r.random() < 0.4 else ""
        article = _tagged(r, True, r.choice(["div", "div", "main", "section"]), r.choice([None, "content"]), article + extra)
    before = [f() for f in (notice, head, menu, advert, form, side) if r.random() < 0.5]
    after = [f() for f in (comments, side, advert, share, form, notice) if r.random() < 0.4] + ([foot()] if r.random() < 0.8 else [])
    r.shuffle(before)
    inner = "".join(before) + article + "".join(after)
    title = r.choice(["<head><title>x</title></head>", "<head><title>x</title></head>", "<head><title>x</title>", "<title>x</title>", ""])
    if r.random() < 0.1:  # html and body tags may be left out
        return title + inner
    return f'<html {KEEP}="">{title}<body {KEEP}="">{inner}{r.choice(["</body></html>", "</body></html>", ""])}'


class Marked(Page):
    """A page whose elements carry their label."""

    def __init__(self, html: str):
        self.label = [1]
        super().__init__(html)

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, [a for a in attrs if a[0] not in (KEEP, DROP)])
        # a paragraph made for a loose inline element is what that element is
        self.label += [int(any(a[0] == KEEP for a in attrs))] * (len(self.tag) - len(self.label))

    def handle_data(self, data):
        super().handle_data(data)
        self.label += [self.label[self.parent[-1]]] * (len(self.tag) - len(self.label))  # loose text is the article's


def known(page: Page) -> np.ndarray | None:
    """Labels of a page that has exactly one article element: it, what it holds and what holds it."""
    found = [i for i, t in enumerate(page.tag) if t == "article"]
    if len(found) != 1:
        return None
    label = np.zeros(len(page.tag))
    for i in range(found[0], len(page.tag)):
        label[i] = i == found[0] or label[page.parent[i]]
    i = found[0]
    while i >= 0:
        label[i] = 1
        i = page.parent[i]
    return label


def train(htmls: list[str], seed: int = SEED) -> Boosted:
    """Model from a sample of pages."""
    r, rows, labels, weights = random.Random(seed), [], [], []
    articles = []
    for html in htmls:
        page = Page(html)
        label = known(page)
        if label is None:
            continue
        rows.append(features(page))
        labels.append(label)
        blocks = page.text([bool(x) for x in label]).split("\n\n")
        if blocks and blocks[0]:
            articles.append(blocks)
    plain = len(rows)
    articles = articles or [["A text that stands for a page."] * 5]
    other = [b for a in articles for b in a[:6]]
    for blocks in articles:
        for _ in range(DRESSED):
            start = r.randrange(len(blocks))
            page = Marked(dressed(r, blocks[start:start + r.randint(1, 14)], other))
            rows.append(features(page))
            labels.append(np.array(page.label, float))
    for x in rows:
        weights.append(np.full(len(x), 1 / np.sqrt(len(x))))
    for i in range(plain):  # pages as they are look all alike
        weights[i] *= 0.5
    weight = np.concatenate(weights)
    return fit(np.concatenate(rows), np.concatenate(labels), weight / weight.mean())


def sampled(pages: DataFrame, most: int = SAMPLE_PAGES) -> list[str]:
    """A bounded sample that does not depend on the order of the rows: the pages with the smallest hashes.

    The bound of the hashes is found first, from ids and URLs alone, so tasks send no more pages than that.
    """
    rows = pages.filter("html is not null").withColumn("h", F.xxhash64(F.lit(SEED), "page_id", "url"))
    bound = rows.select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if bound is None:
        return []
    few = rows.filter(F.col("h") <= bound).select("html", "h")
    return [x["html"] for x in few.orderBy("h", F.length("html"), "html").limit(most).collect()]


def main_texts(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars.

    Null and empty pages have an empty text; nothing is cut from long ones.  Ids and URLs, null or repeated, are
    carried through; other columns are not read.  Without a model one is trained on the pages first.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or train(sampled(pages)))  # a fixed number of trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for batch in batches:
            for begin in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(begin, PAGES_AT_ONCE)
                parsed = [Page(x or "") for x in part.column("html").to_pylist()]
                rows = [features(p) for p in parsed]
                logit = np.split(trees.logit(np.concatenate(rows)), np.cumsum([len(x) for x in rows])[:-1])
                texts = [p.text(decode(p, s)) for p, s in zip(parsed, logit)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
