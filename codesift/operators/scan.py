"""One pass over a table of files that applies the whole rule catalogue.

Every rule becomes a column over the text of its own row: the scan has no
shuffle, no join and no Python worker, and a file is read once whatever the
number of rules.  A regular expression runs only where a plain ``contains``
on the text has already found the literals that it needs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions import folds, matches as M, text as T
from ..functions.dialect import portable
from ..functions.expr import all_of, any_of, let, literal_needs, matches, quoted, rlike
from ..rules import BY_KEY, CATALOGUE, Rule, Test
from ..rules import asynchronous as ay, auth as au, java as jv, lint as lt, pattern as pt, semantic as sm

HITS = "array<struct<seq:int,line:int,detail:string>>"
NO_HITS = f"cast(array() as {HITS})"
NONE_ORDERED = ("cast(array() as array<struct<stage:int,k1:int,k2:int,k3:int,key:string,line:int,detail:string>>)")
LAST = 2**31 - 1
TEXT, LOWER = "content", "_lower"
TRIM = rf"^{T.SPACE}+|{T.SPACE}+\z"

GATES = {
    "_async": ((f"{ay.ASYNC_TOKENS}|{ay.REACT_TOKENS}", False),),
    "_auth": ((au.AUTH_TOKENS, True),),
}


def hit(seq: str, line: str, detail: str = "null") -> str:
    return (f"named_struct('seq', cast({seq} as int), 'line', cast({line} as int), "
            f"'detail', cast({detail} as string))")


def as_hits(rows: str) -> str:
    return f"transform({rows}, r -> {hit('r.n', 'r.n')})"


def once(line: str, detail: str = "null") -> str:
    """A single finding, or none when the line is null."""
    return let(line, "at", f"if(at is not null, array({hit('1', 'at', detail)}), {NO_HITS})")


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, {quoted(TRIM)}, '')"


def frame(n: str, first: int, last: int) -> str:
    """Joined text of the lines n+first .. n+last."""
    start = f"greatest({n} + {first}, 1)"
    return f"array_join(slice(_lines, {start}, greatest({n} + {last} - {start} + 1, 0)), '\\n')"


def head(n: str, width: int) -> str:
    """The ``width`` characters of the text in front of position n-1."""
    return f"substring({TEXT}, greatest({n} - 1 - {width}, 0) + 1, least({n} - 1, {width}))"


class Scanner:
    """Writes the SQL expression of each rule over prepared files."""

    def __init__(self, guards: bool = True):
        self.guards = guards

    # ---- tests -----------------------------------------------------------
    def on_text(self, t: Test) -> str:
        found = matches(TEXT, LOWER, t.pattern, t.fold, self.guards)
        return found if t.present else f"NOT {found}"

    def on_piece(self, piece: str, t: Test) -> str:
        """A test on a line or a stretch of lines, inside a lambda."""
        found = "(" + matches(piece, None, t.pattern, t.fold, self.guards) + ")"
        return found if t.present else f"NOT {found}"

    def line_passes(self, rule: Rule) -> str:
        conditions = [self.on_piece("r.s", t) for t in rule.line]
        for first, last, tests in rule.frames:
            conditions.append(let(frame("r.n", first, last), "f", all_of(self.on_piece("f", t) for t in tests)))
        if rule.head:
            width, t = rule.head
            conditions.append(self.on_piece(head("r.n", width), t))
        return all_of(conditions)

    def passing(self, rule: Rule, more: str = "") -> str:
        rows = "_loop_rows" if rule.in_loop else "_rows"
        return f"filter({rows}, r -> {all_of([self.line_passes(rule), more])})"

    # ---- rules -----------------------------------------------------------
    def gate(self, rule: Rule) -> str:
        """Condition on the file: language, literals of the line tests, file tests, detector gate."""
        detector, conditions = rule.detector, []
        if detector == "JV":
            conditions.append("language = 'java'")
        elif detector == "PY":
            conditions.append("language = 'python'")
        elif detector == "LT":
            conditions.append("language IN ('javascript', 'typescript')")
        elif detector == "AY":
            conditions.append("_async")
        elif detector == "AU":
            conditions.append("_auth")
        elif rule.key in ("SM-14", "SM-15", "SM-16"):
            conditions.append("_rate")
        if self.guards:
            conditions += [n for t in rule.line if t.present for n in literal_needs(TEXT, LOWER, t.pattern, t.fold)]
        conditions += [self.on_text(t) for t in rule.file]
        return all_of(conditions)

    def hits(self, rule: Rule) -> str:
        if rule.custom:
            found = getattr(self, "_" + rule.key.replace("-", "").lower())(rule)
        elif rule.line:
            found = as_hits(self.passing(rule))
        else:
            found = once(self.place(rule))
        return f"if({self.gate(rule)}, {found}, {NO_HITS})"

    def place(self, rule: Rule) -> str:
        """Line a per-file finding points to."""
        if rule.at_match:
            return M.line_of_first(TEXT, portable(rule.at_match))
        if rule.at is None:
            return "1"
        default = "cast(null as int)" if rule.at_default is None else str(rule.at_default)
        return f"coalesce(get(filter(_rows, r -> {self.on_piece('r.s', rule.at)}), 0).n, {default})"

    # rules that need more than presence tests; named after their key
    def _pt15(self, rule: Rule) -> str:
        numbers = f"transform({self.passing(rule)}, r -> r.n)"
        return f"transform({folds.spaced_out(numbers, pt.VALIDATION_GAP)}, n -> {hit('n', 'n')})"

    def _jv03(self, rule: Rule) -> str:
        name = f"regexp_extract(r.s, {quoted(portable(jv.DIGEST_NAME, True))}, 1)"
        return f"transform({self.passing(rule)}, r -> {hit('r.n', 'r.n', name)})"

    def _jv06(self, rule: Rule) -> str:
        # all calls of close once per file: a resource is released by one on its line or a later one
        opened, call, text = quoted(portable(jv.RESOURCE)), portable(jv.CLOSED), M.clean(TEXT)
        calls = (f"array_distinct(zip_with({M.groups(text, call, 1)}, {M.match_lines(M.mark_matches(text, call))}, "
                 "(v, l) -> named_struct('v', v, 'l', l)))")
        released = f"exists(calls, c -> c.l >= r.n AND endswith(c.v, regexp_extract(r.s, {opened}, 1)))"
        w = jv.FINALLY_WINDOW
        rest = f"array_join(transform(slice(_lines, r.n, {w}), s -> substring(s, 1, {w})), '\\n')"
        never = f"NOT {released} AND NOT ({rlike(f'substring({rest}, 1, {w})', jv.FINALLY)})"
        what = trimmed(f"substring_index(regexp_extract(r.s, {opened}, 0), '=', 1)")
        return let(calls, "calls", f"transform({self.passing(rule, never)}, r -> {hit('r.n', 'r.n', what)})")

    def _jv07(self, rule: Rule) -> str:
        bare = any_of([rlike("r.s", jv.EMPTY_CATCH), f"{trimmed(frame('r.n', 1, 1))} = '}}'"])
        return as_hits(self.passing(rule, bare))

    def _ay06(self, rule: Rule) -> str:
        name = f"regexp_extract(r.s, {quoted(portable(ay.PROMISE_ASSIGNED))}, 1)"
        ahead = f"slice(_rows, r.n + 1, {ay.OVERWRITE_SPAN})"
        awaited = f"regexp_like(x.s, concat({quoted(portable(ay.AWAITED))}, v))"
        again = f"regexp_like(x.s, concat(v, {quoted(portable(ay.PROMISE_SOURCE))}))"
        first = let(f"get(filter({ahead}, x -> {awaited} OR {again}), 0)", "x",
                    hit("r.n", f"if({awaited}, null, x.n)", "v"))
        return f"filter(transform({self.passing(rule)}, r -> {let(name, 'v', first)}), h -> h.line is not null)"

    def per_match(self, subject: str, pattern: str, extras: list[str], bad: str, detail: str = "null") -> str:
        """Findings for the matches where ``bad`` holds; x0, x1.. are the values of one match."""
        fields = ", ".join(f"'x{i}', get(g{i}, k)" for i in range(len(extras)))
        numbered = (f"transform({M.match_lines(M.mark_matches(subject, pattern))}, (l, k) -> "
                    f"named_struct('k', k + 1, 'l', l, {fields}))")
        found = f"transform(filter({numbered}, m -> {bad}), m -> {hit('m.k', 'm.l', detail)})"
        for i, extra in enumerate(extras):
            found = let(extra, f"g{i}", found)
        return found

    def _sm01(self, rule: Rule) -> str:
        p, text = portable(sm.LISTENER), M.clean(TEXT)
        after = M.text_after(M.mark_matches(text, p), sm.LISTENER_WINDOW)
        return self.per_match(text, p, [M.groups(text, p, 1), after],
                              f"NOT ({rlike('m.x1', sm.LISTENER_GUARD)})", "m.x0")

    def _sm04(self, rule: Rule) -> str:
        after = f"regexp_extract({TEXT}, {quoted(portable(sm.AFTER_AWAIT))}, 1)"
        return once(f"if({rlike(after, sm.QUEUE_CHECK)}, null, {self.place(rule)})")

    def _sm10(self, rule: Rule) -> str:
        p, text = portable(sm.CATCH_BODY), M.clean(TEXT)
        kept = (r"concat(m.x0, '\\.message|', m.x0, '\\.stack|', "
                + quoted(portable(r"JSON\.stringify\s*\(\s*")) + ", m.x0)")
        return self.per_match(text, p, [M.groups(text, p, 1), M.groups(text, p, 2)],
                              f"NOT regexp_like(m.x1, {kept})", "m.x0")

    def _sm11(self, rule: Rule) -> str:
        names = f"array_distinct(regexp_extract_all({TEXT}, {quoted(portable(sm.STATE_FIELD))}, 1))"
        return once("1", let(names, "v", "concat(size(v), ' fields (', array_join(slice(v, 1, 3), ', '), ')')"))

    def _sm12(self, rule: Rule) -> str:
        return once("1", f"regexp_count({TEXT}, {quoted(portable(sm.NESTED_ARROWS))})")

    def _sm20(self, rule: Rule) -> str:
        names = f"array_distinct(regexp_extract_all({TEXT}, {quoted(portable(sm.MODULE_NAME))}, 1))"
        changed = (f"concat(v, {quoted(portable(r'\s*\.\s*\w+\s*=|'))}, v, {quoted(portable(r'\s*\['))})")
        return once(f"if(exists({names}, v -> regexp_like({TEXT}, {changed})), 1, null)")

    def _au01(self, rule: Rule) -> str:
        p, text = portable(au.CATCH_BLOCK), M.clean(TEXT)
        bad = f"{rlike('m.x0', au.BODY_CLEARS)} AND NOT ({rlike('m.x0', au.BODY_ITERATES)})"
        return self.per_match(text, p, [M.groups(text, p, 1)], bad)

    def _au02(self, rule: Rule) -> str:
        # A closing brace whose stretch since the previous one holds an opening
        # brace becomes OTHER; nested blocks are then a plain character run.
        subject = (f"regexp_replace(translate({TEXT}, '{M.MARK}{M.OTHER}', '  '), "
                   f"{quoted(BRACE_MARK)}, '$1{M.OTHER}')")
        p = portable(branch_pattern())
        bad = all_of([rlike("m.x0", au.IF_RESOLVES), rlike("m.x1", au.ELSE_CLEARS),
                      f"NOT ({rlike('m.x1', au.ELSE_NOTIFIES)})"])
        return self.per_match(subject, p, [M.groups(subject, p, 1), M.groups(subject, p, 2)], bad)

    # rules about one refresh flag: v is its name
    def flag_rule(self, condition: str) -> str:
        flag = quoted(portable(au.REFRESH_FLAG, True))
        line = M.line_of_first(TEXT, portable(au.REFRESH_FLAG, True))
        return let(f"regexp_extract({TEXT}, {flag}, 1)", "v", once(f"if({condition}, {line}, null)", "v"))

    @staticmethod
    def flag_count(value: str) -> str:
        return f"regexp_count({TEXT}, concat('(?i)', v, {quoted(portable(r'\s*=\s*' + value))}))"

    def _au05(self, rule: Rule) -> str:
        check_and_set = (f"concat({quoted('(?i)' + portable(r'if\s*\(\s*!?'))}, v, "
                         f"{quoted(portable(r'\s*\)[^{]*\{[^}]*'))}, v, {quoted(portable(r'\s*=\s*true'))})")
        return self.flag_rule(f"regexp_like({TEXT}, {check_and_set})")

    def _au06(self, rule: Rule) -> str:
        return self.flag_rule(f"{self.flag_count('true')} > {self.flag_count('false')}")

    def _au07(self, rule: Rule) -> str:
        return self.flag_rule(f"{self.flag_count('true')} > 0 AND NOT ({rlike(TEXT, au.FINALLY_FALSE)})")

    def _au10(self, rule: Rule) -> str:
        return let(folds.global_state("_rows"), "g", once("g.line", "array_join(g.names, ', ')"))

    def _lt07(self, rule: Rule) -> str:
        # words and declared names carry their line; a name is unused when no neighbour in sorted order is the same word
        def at(values: str) -> str:
            return f"transform({values}, v -> concat(v, '\\u0001', r.n))"

        word = any_of(f"contains(r.s, '{w}')" for w in ("const", "let", "var"))
        declared = f"flatten(transform(filter(_rows, r -> {word}), r -> {at(f'regexp_extract_all(r.s, {quoted(portable(lt.DECLARED))}, 1)')}))"
        words = f"array_sort(flatten(transform(_rows, r -> {at(f'regexp_extract_all(r.s, {quoted(lt.WORD)}, 0)')})))"
        name = "substring_index({}, '\\u0001', 1)".format
        again = f"zip_with(w, slice(w, 2, size(w)), (a, b) -> coalesce({name('a')} = {name('b')}, false))"
        once_only = let(words, "w", let(again, "q", "filter(w, (x, i) -> NOT get(q, i) AND NOT coalesce(get(q, i - 1), false))"))
        hits = (f"transform(array_intersect(d, {once_only}), x -> "
                + hit("1", "substring_index(x, '\\u0001', -1)", name("x")) + ")")
        return let(declared, "d", f"if(size(d) = 0, {NO_HITS}, {hits})")


# a stretch from an opening brace to the next closing one
BRACE_MARK = r"(\{[^}]*)\}"


def branch_pattern() -> str:
    """if block, else block, over text whose nested closing braces are OTHER."""
    o = r"\u0002"
    return (au.IF_HEAD + rf"([^}}{o}]*|[^{{}}{o}]*\{{[^}}]*?)[}}{o}]" + au.ELSE_HEAD + rf"([^}}{o}]*)[}}{o}]")


# ---- the scan ---------------------------------------------------------------
def gate_columns(guards: bool = True) -> dict[str, str]:
    """Detector gates, evaluated once per file."""
    gates = {name: any_of(matches(TEXT, LOWER, p, fold, guards) for p, fold in tests) for name, tests in GATES.items()}
    gates["_rate"] = any_of([
        matches(TEXT, LOWER, sm.LIMITER, True, guards),
        all_of([f"contains({TEXT}, 'limit')", matches(TEXT, LOWER, sm.LIMITER_CONTEXT, True, guards)])])
    return gates


def prepare(files: DataFrame, in_loop: bool = True, guards: bool = True) -> DataFrame:
    """Language, gates, numbered lines and the lines inside loops, next to the text."""
    base = files.select(
        "*", T.detect_language(F.col("file_name"), F.col("content")).alias("language"),
        F.lower("content").alias(LOWER), T.split_lines(F.col("content")).alias("_lines"))
    columns = ["*", "size(_lines) AS n_lines",
               "transform(_lines, (s, i) -> named_struct('n', i + 1, 's', s)) AS _rows"]
    columns += [f"{sql} AS {name}" for name, sql in gate_columns(guards).items()]
    base = base.selectExpr(*columns)
    if in_loop:
        may_loop = matches(TEXT, LOWER, r"for\s*\(|while\s*\(|" + pt.LOOP_CALL, False, guards)
        base = base.selectExpr("*", f"if({may_loop}, {folds.rows_in_loops('_rows')}, "
                                    f"cast(array() as array<{folds.ROW}>)) AS _loop_rows")
    return base


def scan(files: DataFrame, keys: Iterable[str] | None = None, guards: bool = True,
         extra: Iterable[Rule] = ()) -> DataFrame:
    """files(file_id, file_name, content, ...) plus language, n_lines and hits.

    ``hits`` is an array of narrow structs in emission order; texts and
    weights stay in the catalogue.  ``keys`` limits the rules and so the work;
    ``extra`` are rules of the user, reported after the built-in ones.
    """
    rules = [BY_KEY[k] for k in keys] if keys is not None else list(CATALOGUE)
    rules += list(extra)
    scanner = Scanner(guards)
    prepared = prepare(files, any(r.in_loop for r in rules), guards)
    per_rule = ", ".join(f"transform({scanner.hits(r)}, h -> {_ordered(r)})" for r in rules)
    # Inside a lambda the rules are left out of code generation and of the
    # search for common subexpressions, which cost more than they save here.
    hits = let("true", "go", f"array_sort(concat({per_rule}))") if rules else NONE_ORDERED
    return prepared.selectExpr(*[f"`{c}`" for c in files.columns], "language", "n_lines", f"{hits} AS hits")


def _ordered(rule: Rule) -> str:
    """Key of a hit: by line then rule for line detectors, else by rule then sequence."""
    if rule.stage in (1, 2, 6, 7):
        first, second = ("h.line" if rule.line else str(LAST)), str(rule.number)
    else:
        first, second = str(rule.number), "h.seq"
    return (f"named_struct('stage', {rule.stage}, 'k1', {first}, 'k2', {second}, 'k3', h.seq, "
            f"'key', '{rule.key}', 'line', h.line, 'detail', h.detail)")


def findings(scanned: DataFrame, *carry: str) -> DataFrame:
    """One row per finding, narrow.

    The outer form keeps the optimizer from testing ``size(hits)`` in a filter
    below the explode, which would evaluate the whole scan a second time.
    """
    keep = carry or ("file_id",)
    return scanned.select(*keep, F.posexplode_outer("hits").alias("position", "h")).filter("h is not null").select(
        *keep, "position", F.col("h.key").alias("key"), F.col("h.line").alias("line"), F.col("h.detail").alias("detail"))
