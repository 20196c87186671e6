"""Ordered folds over the lines of one file, as SQL expression text.

Spark copies the state of an ``aggregate`` at every step.  The folds therefore
keep a small state, write their results as text, and go over the lines in
blocks: the long text is touched once per block and not once per line.
"""

from __future__ import annotations

from ..rules.auth import SCOPE_CLOSES, SCOPE_OPENS, STATE_NAME
from ..rules.pattern import LOOP_CALL, LOOP_HEAD
from .dialect import portable
from .expr import let, matches, quoted, rlike

BLOCK = 1024
ROW = "struct<n:int,s:string>"


def in_blocks(items: str, zero: str, step: str) -> str:
    """Texts of all items, comma separated, as an array of strings.

    ``step`` gives struct(s: state, t: text) for item x from a.s and a.t; the
    text of an item ends with a comma or is empty.
    """
    inner = f"aggregate(slice(items, at, {BLOCK}), named_struct('s', o.s, 't', ''), (a, x) -> {step})"
    outer = let(inner, "i", "named_struct('s', i.s, 't', concat(o.t, i.t))")
    starts = f"sequence(1, greatest(size(items), 1), {BLOCK})"
    text = f"aggregate({starts}, named_struct('s', {zero}, 't', ''), (o, at) -> {outer}, o -> o.t)"
    return let(items, "items", f"filter(split({text}, ','), p -> p <> '')")


def structure(rows: str) -> str:
    """What the loop fold needs of each line: is it a loop line, net braces."""
    braces = "length(replace(r.s, '}', '')) - length(replace(r.s, '{', ''))"
    loop = f"contains(r.s, '(') AND ({rlike('r.s', LOOP_HEAD)} OR {matches('r.s', None, LOOP_CALL, False)})"
    return f"transform({rows}, r -> named_struct('loop', {loop}, 'net', {braces}))"


# brace counts of the open loops after line x, from those before it
_AFTER = "if(x.loop, concat(a.s, array(x.net)), if(size(a.s) = 0, a.s, " + let(
    "concat(slice(a.s, 1, size(a.s) - 1), array(element_at(a.s, -1) + x.net))", "t", let(
        "cast(array_position(reverse(transform(t, b -> b > 0)), true) as int)", "e",
        "if(e = 0, slice(t, 1, 0), slice(t, 1, size(t) - e + 1))")) + "))"


def _depths(rows: str) -> str:
    step = let(_AFTER, "st", "named_struct('s', st, 't', concat(a.t, cast(size(st) as string), ','))")
    return in_blocks(structure(rows), "cast(array() as array<int>)", step)


def loop_depths(rows: str) -> str:
    """Number of open loops after each line."""
    return f"transform({_depths(rows)}, d -> cast(d as int))"


def rows_in_loops(rows: str) -> str:
    """The rows that lie inside at least one loop, loop heads included."""
    return let(_depths(rows), "ds", f"filter({rows}, r -> get(ds, r.n - 1) <> '0')")


def spaced_out(numbers: str, gap: int) -> str:
    """Ascending numbers, leaving out each one closer than ``gap`` to the last kept one."""
    step = (f"if(a.s is null OR x - a.s >= {gap}, named_struct('s', x, 't', concat(a.t, cast(x as string), ',')), a)")
    return f"transform({in_blocks(numbers, 'cast(null as int)', step)}, d -> cast(d as int))"


def scope_change(line: str) -> str:
    opens = f"if(contains({line}, '{{') OR contains({line}, '('), regexp_count({line}, {quoted(portable(SCOPE_OPENS))}), 0)"
    closes = f"if(contains({line}, '}}') AND {rlike(line, SCOPE_CLOSES)}, 1, 0)"
    return f"{opens} - {closes}"


def offsets(rows: str) -> str:
    """Number of characters before each line."""
    step = ("named_struct('s', a.s + length(x.s) + 1, 't', concat(a.t, cast(a.s as string), ','))")
    return f"transform({in_blocks(rows, '0', step)}, d -> cast(d as int))"


def function_depths(rows: str) -> str:
    """Number of open functions after each line, never below none."""
    step = let(f"greatest(0, a.s + {scope_change('x.s')})", "d", "named_struct('s', d, 't', concat(a.t, cast(d as string), ','))")
    return f"transform({in_blocks(rows, '0', step)}, d -> cast(d as int))"


def global_state(rows: str) -> str:
    """Login variables declared outside every function: names and first line."""
    name = quoted(portable(STATE_NAME, ignore_case=True))
    start = ("named_struct('depth', 0, 'names', cast(array() as array<string>), 'line', cast(null as int))")
    step = let(f"greatest(0, a.depth + {scope_change('r.s')})", "d", (
        f"if(d = 0 AND r.s RLIKE {name}, "
        f"named_struct('depth', d, 'names', concat(a.names, array(regexp_extract(r.s, {name}, 1))), "
        f"'line', coalesce(a.line, r.n)), "
        f"named_struct('depth', d, 'names', a.names, 'line', a.line))"))
    return f"aggregate({rows}, {start}, (a, r) -> {step})"
