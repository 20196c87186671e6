"""All matches of a pattern in a text, with the line each one starts on.

A one-character mark is put in front of every match.  Counting the marks per
line gives the line numbers and splitting at them gives the text that follows
a match, so no offsets are needed and the work stays linear in the text.
All functions take and return SQL expression text; patterns are portable ones.
"""

from __future__ import annotations

from .expr import let, quoted

MARK = "\x01"
OTHER = "\x02"


def clean(text: str) -> str:
    """The text without the mark character."""
    return f"translate({text}, '{MARK}', '{OTHER}')"


def mark_matches(subject: str, pattern: str) -> str:
    return f"regexp_replace({subject}, {quoted(pattern)}, '{MARK}$0')"


def match_lines(marked: str) -> str:
    """Line number of each match, in order."""
    return (f"flatten(transform(split({marked}, '\\n', -1), (s, i) -> "
            f"array_repeat(i + 1, length(s) - length(replace(s, '{MARK}', '')))))")


def text_after(marked: str, width: int) -> str:
    """For each match, the text from its start, ``width`` characters at most."""
    pieces = f"transform(split({marked}, '{MARK}', -1), s -> substring(s, 1, {width}))"
    return let(pieces, "p", (
        f"transform(slice(p, 2, greatest(size(p) - 1, 0)), (q, k) -> "
        f"substring(array_join(slice(p, k + 2, {width}), ''), 1, {width}))"))


def groups(subject: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({subject}, {quoted(pattern)}, {group})"


def line_of_first(text: str, pattern: str) -> str:
    """Line number of the first match (the text must match)."""
    before = f"substring({text}, 1, regexp_instr({text}, {quoted(pattern)}) - 1)"
    return let(before, "b", "1 + length(b) - length(replace(b, '\\n', ''))")
