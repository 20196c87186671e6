"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    """rows of (doc_id, text) -> (doc_id, set size, smallest id) per row."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[top(i)] = top(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[top(i)].append(d)
    return [(d, len(sets[i]), min(ids[top(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def repeats(w, least):
    """Words covered by substrings of at least ``least`` words that occur twice, and the longest repeat."""
    cover, longest = set(), 0
    for i in range(len(w)):
        for j in range(i):
            n = 0
            while i + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            longest = max(longest, n)
            if n >= least:
                cover |= set(range(i, i + n)) | set(range(j, j + n))
    return len(cover), longest


def quality(text, least=8):
    w = words(text)
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    grams = defaultdict(list)
    for i in range(len(w) - 2):
        grams[tuple(w[i:i + 3])].append(i)
    three = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    cover, longest = repeats(w, least)
    failed = len(w) < 50 or 100 * len(three) > 50 * len(w)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": lines, "n_repeat_words": len(three), "n_covered": cover, "longest_repeat": longest, "base_failed": failed,
            "kept": not (failed or 100 * cover > 50 * len(w) or longest > 50)}


def without_repeats(rows, k=13):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            g = tuple(w[i:i + k])
            if d is not None:
                first[g] = min(first.get(g, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i:i + k])] < d:
                gone |= set(range(i, i + k))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def prose(seed, n):
    """n words of a made-up language with line ends and full stops."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = "".join(r.choice(["an", "be", "ti", "or", "é", "shu", "ka", "lo"]) for _ in range(r.randint(1, 4)))
        out.append(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w)
    return "".join(w + ("\n" if r.random() < 0.05 else " ") for w in out).strip()


def edited(text, seed, share):
    """The text with some words replaced."""
    r, w = random.Random(seed), text.split(" ")
    for i in range(len(w)):
        if r.random() < share:
            w[i] = f"x{r.randint(0, 10**6)}"
    return " ".join(w)
