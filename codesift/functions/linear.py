"""Presence tests whose cost is linear in the text.

``a.*b`` on a line full of ``a`` scans the rest of the line once for each of them.  For a presence test the first
``a`` is enough: if any ``a`` has a ``b`` behind it, the first one has.  The forms below therefore begin at the
beginning of a stretch (a line, the text, or what lies between two closing braces), take the first ``a`` there for
good (an atomic group), and look for ``b`` from it.  Likewise ``a[^)]*b`` needs the first ``a`` between two closing
brackets only.  They find something exactly where the fixed values of the
catalogue do, but a match begins elsewhere, so they serve for tests and never for captures or positions.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .dialect import alternatives

#: white space that ends no line, and what ends one
_BLANK = r"[\t\x0b\f \u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\ufeff]"
_LINE_END = r"[\n\r\u2028\u2029]"
_TOKEN = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|.", re.S)
_CAPTURED = re.compile(r"(?<!\\)\((\[\^[^\]]+\][*+])\)")
_SPACES = re.compile(r"\\s[*+]")
_ANYWHERE = re.compile(r"((?:(?!\[\\s\\S\]).)+)\[\\s\\S\]\*\?(\w+)", re.S)
_IN_A_STRETCH = re.compile(r"(.+?)\[\^\}\]\*(\\\.\w+\\s\*\\\(\\s\*)\(\?:([\w|]+)\|(\\\{)\[\^\}\]\*(\w+)\)", re.S)


@lru_cache(maxsize=None)
def linear(pattern: str) -> str:
    """An equivalent presence test; patterns of another form are returned as they are."""
    return "|".join(_one(p) for p in alternatives(pattern))


def _tokens(pattern: str) -> list[str]:
    return _TOKEN.findall(pattern)


def _plain(part: str, banned: str = "") -> bool:
    """Whether a part has only words, white space, escaped signs, sets of signs and groups of these, and never
    matches the banned sign or, white space aside, the end of a line."""
    for t in _tokens(part):
        if t in (".", "^", "$", "{", "}") or t.startswith("[^") or t in (r"\S", r"\W", r"\D", r"\b", r"\B"):
            return False
        if banned and t.lstrip("\\") == banned and (t.startswith("\\") or t not in "()|*+?"):
            return False
        if banned and t.startswith("[") and banned in t:
            return False
    depth = 0
    for t in _tokens(part):
        depth += {"(": 1, ")": -1}.get(t, 0)
    return depth == 0


def _cut(pattern: str, at: str) -> list[str]:
    """Parts of a pattern between its top-level pieces ``at``, such as ``.*``."""
    parts, depth, now, tokens = [], 0, "", _tokens(pattern)
    i = 0
    while i < len(tokens):
        if depth == 0 and "".join(tokens[i:i + 2]) == at:
            parts.append(now)
            now, i = "", i + 2
            continue
        depth += {"(": 1, ")": -1}.get(tokens[i], 0)
        now += tokens[i]
        i += 1
    return parts + [now]


def _along_a_line(p: str) -> str | None:
    """``a.*b`` with plain parts: the first ``a`` of a line, the first ``b`` behind it, and so on.

    An ``a`` that holds the end of a line in its white space is the first thing on the line it ends on; such ones are
    looked for apart.
    """
    parts = _cut(p, ".*")
    if len(parts) < 2 or not all(parts) or not all(_plain(x) for x in parts[:-1]):
        return None
    for a, b in zip(parts, parts[1:]):  # what is taken for good must not take what follows
        if a[-1] in "*+?" and (not _SPACES.fullmatch(a[-3:]) or b.startswith("\\s")):
            return None
    spaces = [list(_SPACES.finditer(x)) for x in parts]
    if len(parts) > 2 and any(spaces[:-1]) or any("\\s" in _SPACES.sub("", x) for x in parts[:-1]):
        return None
    on_line = [_SPACES.sub(lambda m: (_BLANK + m[0][-1]).replace("\\", "\\"), x) for x in parts[:-1]]
    forms = ["^^" + "".join(f"(?>.*?{x})" for x in on_line) + f".*?{parts[-1]}"]
    first = parts[0]
    for m in spaces[0]:
        before = _SPACES.sub(lambda b: _BLANK + b[0][-1], first[:m.start()])
        forms.append(f"{before}{_BLANK}*{_LINE_END}\\s*{first[m.end():]}.*{parts[1]}")
    return "|".join(forms)


def _up_to_a_sign(p: str) -> str | None:
    """``a[^)]*b`` with a plain ``a`` that holds no ``)``: the first ``a`` after the sign before it."""
    tokens, depth = _tokens(p), 0
    for i, t in enumerate(tokens):
        if depth == 0 and re.fullmatch(r"\[\^\\?[^\]\\sSwWdD]\]", t) and tokens[i + 1:i + 2] in (["*"], ["+"]):
            break
        depth += {"(": 1, ")": -1}.get(t, 0)
    else:
        return None
    sign, head, rest = t[2:-1].lstrip("\\"), "".join(tokens[:i]), "".join(tokens[i + 2:])
    if not head or not rest or head[-1] in "*+?" or not _plain(head, sign):
        return None
    first = rf"(?<!{t})(?>{t}*?{head}){t}{tokens[i + 1]}"
    closed, _, word = rest.partition(r"[\s\S]*?")
    if word and closed.startswith("\\" + sign) and re.fullmatch(r"\w+", word) and _plain(closed[2:].replace(r"\{", "x")):
        return rf"^(?>[\s\S]*?{first}{closed})[\s\S]*?{word}"
    return first + rest


def _one(p: str) -> str:
    p = _CAPTURED.sub(r"\1", p)  # a presence test needs no captures
    if m := _IN_A_STRETCH.fullmatch(p):
        first = rf"(?:^|\}})(?>[^}}]*?{m[1]})"
        return rf"{first}[^}}]*?{m[2]}(?:{m[3]})|{first}(?>[^}}]*?{m[2]}{m[4]})[^}}]*?{m[5]}"
    if form := _along_a_line(p) or _up_to_a_sign(p):
        return form
    if m := _ANYWHERE.fullmatch(p):
        return rf"^(?>[\s\S]*?{m[1]})[\s\S]*?{m[2]}"
    return p
