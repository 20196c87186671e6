"""Regular expressions that mean the same in Spark (java.util.regex) and DuckDB (RE2).

Rule patterns are written in ECMAScript form.  ``portable`` widens the few
tokens whose meaning differs between engines: white space includes the Unicode
spaces, a dot stops at every ECMAScript line terminator, and ``$`` is the end
of the text and nothing else.
"""

from __future__ import annotations

import re
from functools import lru_cache

SPACE = (
    r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)
NOT_LINE_END = r"[^\n\r\x{2028}\x{2029}]"
LINE_START = r"(?:^|[\n\r\x{2028}\x{2029}])"
ANY = r"[\s\S]"  # a plain class in both engines, no group to loop over

_TOKEN = re.compile(r"\[\\s\\S\]|\[(?:\\.|[^\]\\])*\]|\\.|\.|\$|\^\^", re.S)


@lru_cache(maxsize=None)
def portable(pattern: str, ignore_case: bool = False) -> str:
    """Translate an ECMAScript pattern; ``^^`` stands for a multiline ``^``."""

    def swap(m: re.Match) -> str:
        token = m.group(0)
        return {
            r"[\s\S]": ANY,
            r"\s": SPACE,
            r"\/": "/",
            ".": NOT_LINE_END,
            "$": r"\z",
            "^^": LINE_START,
        }.get(token, token)

    body = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", _TOKEN.sub(swap, pattern))
    return f"(?i){body}" if ignore_case else body


def alternatives(pattern: str) -> list[str]:
    """Parts of a pattern between its top-level bars."""
    parts, depth, current = [], 0, ""
    for token in re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]|.", pattern, re.S):
        if token == "|" and depth == 0:
            parts.append(current)
            current = ""
            continue
        depth += {"(": 1, ")": -1}.get(token, 0)
        current += token
    return parts + [current]


def is_literal(pattern: str) -> str | None:
    """The plain text a pattern stands for, when it has no operators at all."""
    plain = re.sub(r"\\([^\w\s])", "", pattern)
    if re.fullmatch(r"[\w =<>-]*", plain):
        return re.sub(r"\\([^\w\s])", r"\1", pattern)
    return None


@lru_cache(maxsize=None)
def required_literals(pattern: str) -> list[set[str]]:
    """Literal sets that every match needs: one member of each set must occur.

    Used as cheap ``contains`` guards in front of a regular expression.
    """
    try:
        from re import _parser as parser
    except ImportError:  # interpreters before 3.11
        import sre_parse as parser  # type: ignore
    try:
        tree = parser.parse(pattern.replace("^^", "^"))
    except re.error:
        return []
    usable = [s for s in _needed(list(tree))
              if len(s) <= 8 and all(len(x) > 1 or not (x.isalnum() or x.isspace()) for x in s)]
    # the most telling sets first, three at most
    return sorted(usable, key=lambda s: -min(map(len, s)))[:3]


def _needed(items) -> list[set[str]]:
    found: list[set[str]] = []
    run = ""
    for op, arg in items + [(None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        if run:
            found.append({run})
            run = ""
        if name == "SUBPATTERN":
            found += _needed(list(arg[-1]))
        elif name == "BRANCH":
            parts = [_needed(list(b)) for b in arg[1]]
            if all(parts):
                found.append(set().union(*[max(p, key=lambda s: min(map(len, s))) for p in parts]))
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            found += _needed(list(arg[2]))
    return found
