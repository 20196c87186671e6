"""Edit-aware token counts: after an edit only the region it touches is encoded again.

A text is cut into pre-tokens, each with its number of tokens.  Blocks of pre-tokens are the leaves of a tree of
sums over characters, pre-tokens and tokens.  An edit walks down the tree to the pre-tokens it touches, cuts
again from the pre-token before it until an old boundary is met, and corrects the sums above the changed leaves.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import shipped

shipped(__name__)

# production parameters
VOCABULARY_SETTING = "codesift.vocabulary"  # a session may name another vocabulary file
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 64
CACHED = 1 << 17
# fixed value: the pattern that belongs to the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CHARS, PIECES, TOKENS = range(3)


def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a byte-level vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Counter(dict):
    """Number of tokens of a pre-token, remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken
        self.encode = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[piece] = n = len(self.encode(piece))
        return n


CUT = regex.compile(PATTERN)


class Tree:
    """Segment tree of a text: blocks of pre-token lengths and token counts, and the sums above them."""

    def __init__(self, lengths: Sequence[int], counts: Sequence[int]):
        n = len(lengths)
        self.blocks = [(list(lengths[i:i + BLOCK]), list(counts[i:i + BLOCK])) for i in range(0, n, BLOCK)] or [([], [])]
        self.leaves = 1 << (len(self.blocks) - 1).bit_length()
        self.sums = np.zeros((2 * self.leaves, 3), np.int64)
        leaf = self.sums[self.leaves:]
        if n:
            at = np.arange(0, n, BLOCK)
            leaf[:len(at), CHARS] = np.add.reduceat(np.asarray(lengths, np.int64), at)
            leaf[:len(at), TOKENS] = np.add.reduceat(np.asarray(counts, np.int64), at)
            leaf[:len(at), PIECES] = np.minimum(BLOCK, n - at)
        low = self.leaves
        while low > 1:
            self.sums[low // 2:low] = self.sums[low:2 * low:2] + self.sums[low + 1:2 * low:2]
            low //= 2

    @property
    def total(self) -> np.ndarray:
        return self.sums[1]

    def find(self, char: int) -> tuple[int, int, int]:
        """Block, position in it, and first character of the pre-token that holds a character; the end if none does."""
        node, before = 1, 0
        if char >= self.sums[1, CHARS]:
            return len(self.blocks) - 1, len(self.blocks[-1][0]), int(self.sums[1, CHARS])
        while node < self.leaves:
            node *= 2
            if char >= before + self.sums[node, CHARS]:
                before += int(self.sums[node, CHARS])
                node += 1
        block = node - self.leaves
        for i, n in enumerate(self.blocks[block][0]):
            if char < before + n:
                return block, i, before
            before += n
        raise AssertionError("sums disagree with the blocks")

    def replace(self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        """Put other pre-tokens in place of those from first to before last; sums above changed blocks follow."""
        (a, i), (b, j) = first, last
        tail = [x[j:] for x in self.blocks[b]]
        head = [x[:i] for x in self.blocks[a]]
        for k in range(a + 1, b):
            self.blocks[k] = ([], [])
        if a == b:
            self.blocks[a] = (head[0] + lengths + tail[0], head[1] + counts + tail[1])
        else:
            self.blocks[a] = (head[0] + lengths, head[1] + counts)
            self.blocks[b] = (tail[0], tail[1])
        touched = set()
        for k in range(a, b + 1):
            self.sums[self.leaves + k] = sum(self.blocks[k][0]), len(self.blocks[k][0]), sum(self.blocks[k][1])
            touched.add((self.leaves + k) // 2)
        while touched - {0}:
            for node in touched:
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
            touched = {node // 2 for node in touched if node > 1}


def build(text: str, count: Counter) -> Tree:
    pieces = CUT.findall(text)
    return Tree(list(map(len, pieces)), list(map(count.__getitem__, pieces)))


AHEAD = 32  # characters behind an edit that are looked at first; twice as many as long as cutting is not in step


def recut(tree: Tree, read: Callable[[int, int], str], start: int, end: int, new: str, count: Counter) -> int:
    """Put ``new`` in place of the characters from start to end; returns how many pre-tokens were encoded again.

    ``read(a, b)`` gives characters of the text as it is.  Whether a pre-token ends where it does depends on two
    characters behind its last one at most, those of a longer run of white space belong to it.  So cutting begins again with
    the pre-token that holds the second character before the edit, and as cutting looks ahead only, it is back in step
    at the first boundary behind the edit that was one before.
    """
    total, shift = int(tree.total[CHARS]), len(new) - (end - start)
    block, i, char = tree.find(max(0, start - 2))
    head = read(char, start)
    ahead = AHEAD
    while True:
        whole = end + ahead >= total
        window = head + new + read(end, min(total, end + ahead))
        b, j, old = tree.find(end)
        if j < len(tree.blocks[b][0]) and old < end:
            old += tree.blocks[b][0][j]
            j += 1
        lengths: list[int] = []
        counts: list[int] = []
        at, in_step = char, False
        for m in CUT.finditer(window):
            while old + shift < at and b < len(tree.blocks):
                if j < len(tree.blocks[b][0]):
                    old += tree.blocks[b][0][j]
                    j += 1
                else:
                    b, j = b + 1, 0
            in_step = at == old + shift and at >= start + len(new)
            if in_step or (m.end() + 1 >= len(window) and not whole):
                break
            lengths.append(m.end() - m.start())
            counts.append(count[m.group()])
            at = char + m.end()
        if in_step:
            break
        if whole:
            b, j = len(tree.blocks) - 1, len(tree.blocks[-1][0])
            break
        ahead *= 2
    if b == len(tree.blocks):
        b, j = b - 1, len(tree.blocks[-1][0])
    tree.replace((block, i), (b, j), lengths, counts)
    return len(lengths)


def edit(tree: Tree, text: str, start: int, end: int, new: str, count: Counter) -> tuple[str, int]:
    """Replace text[start:end]; returns the new text and how many pre-tokens were encoded again."""
    again = recut(tree, lambda a, b: text[a:b], start, end, new, count)
    return text[:start] + new + text[end:], again


def edit_all(tree: Tree, text: str, edits: list[tuple[int, int, str]], count: Counter) -> tuple[str, int]:
    """All edits of a text, last one first and without overlap, in time linear in the text and the edits.

    What lies behind the edit at hand is a stack of pieces, so no edit copies the text.
    """
    begin, pieces, again = len(text), [], 0  # text[:begin] is as it was; pieces follow it, the nearest last

    def read(a: int, b: int) -> str:
        if b <= begin:
            return text[a:b]
        out, missing = [text[a:begin]], b - max(a, begin)
        skip = max(0, a - begin)
        for piece in reversed(pieces):
            if missing <= 0:
                break
            if skip >= len(piece):
                skip -= len(piece)
                continue
            out.append(piece[skip:skip + missing])
            missing -= len(out[-1])
            skip = 0
        return "".join(out)

    for start, end, new in edits:
        if end > begin:
            raise ValueError("edits must come last one first, without overlap")
        again += recut(tree, read, start, end, new, count)
        pieces += [text[end:begin], new]
        begin = start
    return text[:begin] + "".join(reversed(pieces)), again


# ---- edits that a cleaning step makes ------------------------------------------------
SECRETS = re.compile(r"[\w.+-]{1,64}@[\w-]{1,64}(?:\.[\w-]{1,64}){1,8}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[0-9a-f]{32,64}\b|\b\d{9,}\b")
MASK = "<masked>"


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits of a text, last one first: addresses, keys and long numbers are masked, repeated lines removed."""
    edits, seen, at = [], set(), 0
    for line in text.split("\n"):
        end = at + len(line)
        if line in seen and line and not line.isspace():
            edits.append((at - 1, end, ""))  # with the line end before it
        else:
            seen.add(line)
            if "@" in line or any(map(str.isdigit, line)):
                edits += [(at + m.start(), at + m.end(), MASK) for m in SECRETS.finditer(line)]
        at = end + 1
    return edits[::-1]


COLUMNS = ("n_chars", "n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_chars_edited", "n_pretokens_edited", "n_tokens_edited")


def counted(docs: DataFrame, path: str | None = None, edits: Callable[[str], list] = cleaning_edits, texts: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, counts before and after the edits, and how many pre-tokens were encoded for them.

    ``edits`` gives (start, end, replacement) in code points of the text, last one first, without overlap.  With
    ``texts`` the edited text is returned too.  Null and empty texts have no tokens; repeated rows are counted
    each; a null doc_id is carried through; other columns are not read.  The vocabulary, a table of fixed size,
    is read by the driver from ``path``, or from where the session's setting codesift.vocabulary says, and sent to every
    task once.  Texts of any length take time linear in their length and their edits.
    """
    path = path or docs.sparkSession.conf.get(VOCABULARY_SETTING, VOCABULARY)
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    names = ["doc_id", *COLUMNS, *(["edited"] if texts else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(ranks.value)
        for batch in batches:
            rows, edited = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                tree = build(text, count)
                before = tree.total.tolist()
                todo = edits(text)
                text, again = edit_all(tree, text, todo, count)
                rows.append((*before, len(todo), again, *tree.total.tolist()))
                edited.append(text)
            columns = list(zip(*rows)) or [[] for _ in COLUMNS]
            out = [batch.column("doc_id").cast(pa.int64()), *[pa.array(c, pa.int64()) for c in columns]]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(edited, pa.string())] if texts else []), names=names)

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + (", edited string" if texts else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
