"""Small helpers that write Spark SQL expression text.

The scan has thousands of expression nodes.  Handing them over as SQL text
builds the plan in one call per rule instead of one call per node.
"""

from __future__ import annotations

from collections.abc import Iterable

from .dialect import alternatives, is_literal, portable, required_literals
from .linear import linear


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def all_of(conditions: Iterable[str]) -> str:
    conditions = [c for c in conditions if c]
    return "(" + " AND ".join(conditions) + ")" if conditions else "true"


def any_of(conditions: Iterable[str]) -> str:
    return "(" + " OR ".join(conditions) + ")"


def let(value: str, name: str, body: str) -> str:
    """Bind ``value`` to ``name`` once inside ``body``.

    The finishing function of an aggregate hands its argument over as it is; a
    ``transform`` of a one-element array would deep-copy the result.
    """
    return f"aggregate(array(0), {value}, (a_, b_) -> a_, {name} -> {body})"


def rlike(text: str, pattern: str, ignore_case: bool = False) -> str:
    return f"{text} RLIKE {quoted(portable(linear(pattern), ignore_case))}"


def literal_needs(text: str, lower: str | None, pattern: str, fold: bool) -> list[str]:
    """``contains`` conditions that hold whenever the pattern matches."""
    needs = []
    where, change = (lower, str.lower) if fold or "(?i:" in pattern else (text, str)
    if where is None:
        return needs
    for options in required_literals(pattern):
        needs.append(any_of(f"contains({where}, {quoted(x)})" for x in sorted({change(o) for o in options})))
    return needs


def matches(text: str, lower: str | None, pattern: str, fold: bool, guards: bool = True) -> str:
    """Pattern test; each alternative runs only behind the literals it needs.

    ``lower`` is the text in lower case, when there is one.
    """
    if not guards:
        return rlike(text, pattern, fold)
    parts, plain = [], []
    rest: dict[tuple[str, ...], list[str]] = {}
    for alternative in alternatives(pattern):
        word = is_literal(alternative)
        if word and (not fold or lower):
            where = lower if fold else text
            plain.append(f"contains({where}, {quoted(word.lower() if fold else word)})")
        else:
            needs = tuple(literal_needs(text, lower, alternative, fold))
            rest.setdefault(needs, []).append(alternative)
    for needs, patterns in rest.items():
        parts.append(all_of([*needs, rlike(text, "|".join(patterns), fold)]))
    return any_of(plain + parts)
