"""HTML pages as trees of nodes, tolerant of whatever a page holds."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

from . import shipped

shipped(__name__)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements that never show text of the article
UNSEEN = frozenset("script style noscript template head title iframe object svg canvas audio video select option button textarea "
                   "datalist".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul "
                  "caption".split())
#: an element that begins ends an open one of these, unless one of the others lies between
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: what may stand in a head; anything else ends it, whether or not an end tag does
IN_HEAD = frozenset("html head title base basefont bgsound link meta style script noscript noframes template".split())
#: elements whose own words, loose between blocks, make a block of their own
OUTER = frozenset("#root html body".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Page(HTMLParser):
    """Nodes of a page in the order they begin; a parent has a smaller number than its children.

    ``pieces`` holds (node, text) in page order, with text None where a block begins or ends.  A head ends at the
    first thing that cannot be in one.  Text and inline elements that stand in no block but the page itself, with or without
    html and body tags, get a paragraph of their own, so they are judged like any other.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.names, self.pieces = [-1], ["#root"], [[]], []
        self.stack, self.open, self.unseen = [0], Counter(), 0
        try:
            self.feed(html)
            self.close()
        except AssertionError:  # a declaration the parser does not know
            self.__init__(html.replace("<![", "&lt;!["))

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not needed."""
        return j

    def _pop(self) -> None:
        tag = self.tag[self.stack.pop()]
        self.open[tag] -= 1
        self.unseen -= tag in UNSEEN
        if tag in BLOCK:
            self.pieces.append((self.stack[-1], None))

    def _end(self, ended: set[str], walls: set[str]) -> None:
        if not any(self.open[t] for t in ended):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag in walls:
                return
            if tag in ended:
                while len(self.stack) > depth:
                    self._pop()
                if not any(self.open[t] for t in ended):
                    return
                # a row ends its cell and itself
                return self._end(ended, walls)

    def _leave_head(self) -> None:
        """End an open head, unless something in it is still open and hides what follows."""
        if self.open["head"] and self.tag[self.stack[-1]] == "head":
            self._pop()

    def _enter(self, tag: str, names: list[str]) -> None:
        self.parent.append(self.stack[-1])
        self.tag.append(tag)
        self.names.append(names)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] += 1
        self.unseen += tag in UNSEEN
        if tag in BLOCK:
            self.pieces.append((self.stack[-1], None))

    def _loose(self) -> None:
        """Words are about to stand directly in the page: they make a paragraph."""
        if not self.unseen and self.tag[self.stack[-1]] in OUTER:
            self._enter("p", [])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self._leave_head()
        if tag not in BLOCK and tag not in VOID and tag not in UNSEEN and tag not in IN_HEAD:
            self._loose()
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in BLOCK:
            self._end({"p"}, {"table", "td", "th", "button", "blockquote", "div", "section", "article", "main", "aside", "body"})
        if tag == "br":
            self.pieces.append((self.stack[-1], "\n"))
        if tag in VOID:
            if tag == "hr":
                self.pieces.append((self.stack[-1], None))
            return
        names = []
        for key, value in attrs:
            if key in ("class", "id", "role", "aria-label", "itemprop") and value:
                names += [t.lower() for t in _TOKEN.findall(value)]
            elif key == "hidden" or (key == "style" and value and "none" in value.replace(" ", "").partition("display:")[2][:5]):
                names.append("hidden")
        self._enter(tag, names)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        while self.tag[self.stack[-1]] != tag:
            self._pop()
        self._pop()

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self._leave_head()
            self._loose()
        if not self.unseen:
            self.pieces.append((self.stack[-1], data))

    def text(self, shown: list[bool]) -> str:
        """The text of the nodes shown: blocks in page order, white space inside a block as one space."""
        blocks, now = [], []
        for node, data in self.pieces:
            if data is None:
                if now:
                    blocks.append(" ".join("".join(now).split()))
                    now = []
            elif shown[node]:
                now.append(data)
        if now:
            blocks.append(" ".join("".join(now).split()))
        return "\n\n".join(b for b in blocks if b)
