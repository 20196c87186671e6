"""DuckDB SQL for every rule: file_id, line, detail."""

from __future__ import annotations

from ..functions.dialect import portable
from ..operators.scan import BRACE_MARK, TRIM, branch_pattern
from ..rules import BY_KEY, CATALOGUE, Rule, Test
from ..rules import asynchronous as ay, auth as au, java as jv, lint as lt, pattern as pt, semantic as sm
from .oracle_views import CODE_FILES, LANGS, LINES, lit

NONE = "CAST(NULL AS VARCHAR)"


def re_(text: str, pattern: str, fold: bool = False) -> str:
    return f"regexp_matches({text}, {lit(portable(pattern, fold))})"


def test(text: str, t: Test) -> str:
    found = re_(text, t.pattern, t.fold)
    return found if t.present else f"NOT {found}"


def conj(conditions) -> str:
    conditions = [c for c in conditions if c]
    return " AND ".join(conditions) if conditions else "true"


def gate(rule: Rule) -> str:
    text, d = "f.content", rule.detector
    if d == "JV":
        return "f.language = 'java'"
    if d == "PY":
        return "f.language = 'python'"
    if d == "LT":
        return "f.language IN ('javascript', 'typescript')"
    if d == "AY":
        return re_(text, f"{ay.ASYNC_TOKENS}|{ay.REACT_TOKENS}")
    if d == "AU":
        return re_(text, au.AUTH_TOKENS, True)
    if rule.key in ("SM-14", "SM-15", "SM-16"):
        return (f"({re_(text, sm.LIMITER, True)} OR ({re_(text, 'limit')} AND "
                f"{re_(text, sm.LIMITER_CONTEXT, True)}))")
    return ""


def frame(first: int, last: int) -> str:
    return (f"array_to_string(list_slice(f.ls, greatest(l.n + {first}, 1), least(l.n + {last}, len(f.ls))), chr(10))")


def head(width: int) -> str:
    return f"substring(f.content, greatest(l.n - 1 - {width}, 0) + 1, least(l.n - 1, {width}))"


def line_condition(rule: Rule) -> str:
    conditions = [gate(rule)] + [test("l.s", t) for t in rule.line] + [test("f.content", t) for t in rule.file]
    for first, last, tests in rule.frames:
        # an empty frame at the end of the file is the empty text
        conditions += [test(f"coalesce({frame(first, last)}, '')", t) for t in tests]
    if rule.head:
        conditions.append(test(head(rule.head[0]), rule.head[1]))
    return conj(conditions)


LOOPS = f"""marked AS (
  SELECT file_id, n, s, {re_('s', pt.LOOP_HEAD)} OR {re_('s', pt.LOOP_CALL)} AS is_loop,
         CAST(len(replace(s, chr(125), '')) - len(replace(s, chr(123), '')) AS INT) AS net FROM lines),
busy AS (SELECT * FROM marked WHERE file_id IN (SELECT file_id FROM marked WHERE is_loop)),
walk AS (
  SELECT DISTINCT file_id, CAST(0 AS BIGINT) AS n, CAST([] AS INT[]) AS st FROM busy
  UNION ALL
  SELECT b.file_id, b.n, CASE WHEN b.is_loop THEN list_append(w.st, b.net) WHEN len(w.st) = 0 THEN w.st ELSE
    list_transform([list_append(list_slice(w.st, 1, len(w.st) - 1), w.st[-1] + b.net)], lambda t:
      list_slice(t, 1, coalesce(len(t) + 1 - nullif(list_position(list_reverse(list_transform(t, lambda x: x > 0)), true), 0), 0)))[1]
    END
  FROM walk w JOIN busy b ON b.file_id = w.file_id AND b.n = w.n + 1),
depths AS (SELECT file_id, n, len(st) AS depth FROM walk WHERE n > 0)"""


def base(*more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([SHARED, *more]) + "\n"


SHARED = ",\n".join([CODE_FILES, LANGS, LINES])


def inside(sql: str) -> str:
    """A rule statement for use below a statement that already has the shared views."""
    return sql.replace(SHARED + ",\n", "", 1).replace(f"WITH {SHARED}\n", "", 1)


def rule_sql(key: str) -> str:
    rule = BY_KEY[key]
    custom = _CUSTOM.get(key)
    if custom:
        return custom(rule)
    if rule.line:
        loop = " JOIN depths d ON d.file_id = l.file_id AND d.n = l.n AND d.depth > 0" if rule.in_loop else ""
        return (base(*([LOOPS] if rule.in_loop else []), recursive=rule.in_loop)
                + f"SELECT l.file_id, CAST(l.n AS INT) AS line, {NONE} AS detail FROM lines l JOIN langs f "
                  f"ON f.file_id = l.file_id{loop} WHERE {line_condition(rule)}")
    return per_file(rule)


def place(rule: Rule) -> str:
    if rule.at_match:
        before = f"string_split_regex(f.content, {lit(portable(rule.at_match))})[1]"
        return f"len({before}) - len(replace({before}, chr(10), '')) + 1"
    if rule.at is None:
        return "1"
    default = "NULL" if rule.at_default is None else str(rule.at_default)
    return f"coalesce((SELECT min(l.n) FROM lines l WHERE l.file_id = f.file_id AND {test('l.s', rule.at)}), {default})"


def per_file(rule: Rule, detail: str = NONE, more: str = "", line: str | None = None) -> str:
    where = conj([gate(rule), *[test("f.content", t) for t in rule.file], more])
    return (base() + f"SELECT file_id, line, detail FROM (SELECT f.file_id, CAST({line or place(rule)} AS INT) AS line, "
            f"{detail} AS detail FROM langs f WHERE {where}) WHERE line IS NOT NULL")


def _detail_line(detail: str, more: str = ""):
    def sql(rule: Rule) -> str:
        return (base() + f"SELECT l.file_id, CAST(l.n AS INT) AS line, {detail} AS detail FROM lines l "
                f"JOIN langs f ON f.file_id = l.file_id WHERE {conj([line_condition(rule), more])}")
    return sql


def _pt15(rule: Rule) -> str:
    return base(
        f"cand AS (SELECT l.file_id, l.n, row_number() OVER (PARTITION BY l.file_id ORDER BY l.n) AS k FROM lines l "
        f"JOIN langs f ON f.file_id = l.file_id WHERE {line_condition(rule)})",
        f"pick AS (SELECT file_id, k, n, n AS last, true AS keep FROM cand WHERE k = 1 UNION ALL "
        f"SELECT c.file_id, c.k, c.n, CASE WHEN c.n - p.last >= {pt.VALIDATION_GAP} THEN c.n ELSE p.last END, "
        f"c.n - p.last >= {pt.VALIDATION_GAP} FROM pick p JOIN cand c ON c.file_id = p.file_id AND c.k = p.k + 1)",
        recursive=True) + f"SELECT file_id, CAST(n AS INT) AS line, {NONE} AS detail FROM pick WHERE keep"


def _ay06(rule: Rule) -> str:
    awaited = f"regexp_matches(x.s, {lit(portable(ay.AWAITED))} || c.v)"
    again = f"regexp_matches(x.s, c.v || {lit(portable(ay.PROMISE_SOURCE))})"
    return base(
        f"cand AS (SELECT l.file_id, l.n, regexp_extract(l.s, {lit(portable(ay.PROMISE_ASSIGNED))}, 1) AS v "
        f"FROM lines l JOIN langs f ON f.file_id = l.file_id WHERE {line_condition(rule)})",
        f"ahead AS (SELECT c.file_id, c.n, c.v, x.n AS hit_n, {awaited} AS awaited FROM cand c JOIN lines x "
        f"ON x.file_id = c.file_id AND x.n BETWEEN c.n + 1 AND c.n + {ay.OVERWRITE_SPAN} WHERE {awaited} OR {again} "
        f"QUALIFY row_number() OVER (PARTITION BY c.file_id, c.n ORDER BY x.n) = 1)",
    ) + "SELECT file_id, CAST(hit_n AS INT) AS line, v AS detail FROM ahead WHERE NOT awaited"


def per_match(rule: Rule, subject: str, pattern: str, bad: str, detail: str = NONE) -> str:
    p = lit(portable(pattern))
    where = conj([gate(rule), *[test("f.content", t) for t in rule.file]])
    before = "array_to_string(list_slice(segs, 1, k), '')"
    return base(
        f"subjects AS (SELECT f.file_id, {subject} AS t FROM langs f WHERE {where})",
        f"cut AS (SELECT file_id, t, string_split(regexp_replace(t, {p}, chr(1) || '\\0', 'g'), chr(1)) AS segs FROM subjects)",
        f"found AS (SELECT file_id, k, len({before}) - len(replace({before}, chr(10), '')) + 1 AS line, "
        f"regexp_extract_all(t, {p}, 1)[k] AS x0, regexp_extract_all(t, {p}, {2 if '2' in bad else 1})[k] AS x1, "
        f"array_to_string(list_slice(segs, k + 1, len(segs)), '') AS after "
        f"FROM (SELECT *, unnest(range(1, len(segs))) AS k FROM cut))",
    ) + f"SELECT file_id, CAST(line AS INT) AS line, {detail} AS detail FROM found WHERE {bad.replace('#2', '')}"


CLEAN = "replace(f.content, chr(1), chr(2))"
_sm10_kept = ("regexp_matches(x1, x0 || '\\.message|' || x0 || '\\.stack|' || "
              f"{lit(portable(chr(74) + 'SON' + r'\.stringify\s*\(\s*'))} || x0)")
_flag = f"regexp_extract(f.content, {lit(portable(au.REFRESH_FLAG, True))}, 1)"
_flag_before = f"string_split_regex(f.content, {lit(portable(au.REFRESH_FLAG, True))})[1]"
_flag_line = f"len({_flag_before}) - len(replace({_flag_before}, chr(10), '')) + 1"


def _flag_count(value: str) -> str:
    return f"len(regexp_extract_all(f.content, '(?i)' || {_flag} || {lit(portable(r'\s*=\s*' + value))}))"


def _names(pattern: str) -> str:
    """Distinct captured names in order of appearance."""
    every = f"regexp_extract_all(f.content, {lit(portable(pattern))}, 1)"
    return f"list_filter({every}, lambda x, i: list_position({every}, x) = i)"


def _au10(rule: Rule) -> str:
    opens = f"len(regexp_extract_all(l.s, {lit(portable(au.SCOPE_OPENS))}))"
    closes = f"CASE WHEN {re_('l.s', au.SCOPE_CLOSES)} THEN 1 ELSE 0 END"
    where = conj([gate(rule), *[test("f.content", t) for t in rule.file]])
    return base(
        f"running AS (SELECT l.file_id, l.n, l.s, sum({opens} - {closes}) OVER (PARTITION BY l.file_id ORDER BY l.n) AS total "
        f"FROM lines l JOIN langs f ON f.file_id = l.file_id WHERE {where})",
        "deep AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY file_id ORDER BY n)) AS depth FROM running)",
        f"named AS (SELECT file_id, n, regexp_extract(s, {lit(portable(au.STATE_NAME, True))}, 1) AS v FROM deep "
        f"WHERE depth = 0 AND {re_('s', au.STATE_NAME, True)})",
    ) + "SELECT file_id, CAST(min(n) AS INT) AS line, string_agg(v, ', ' ORDER BY n) AS detail FROM named GROUP BY file_id"


def _lt07(rule: Rule) -> str:
    return base(
        f"decl AS (SELECT file_id, n, unnest(regexp_extract_all(s, {lit(portable(lt.DECLARED))}, 1)) AS v FROM lines "
        f"WHERE language IN ('javascript', 'typescript'))",
        f"words AS (SELECT file_id, unnest(regexp_extract_all(content, '{lt.WORD}')) AS v FROM langs)",
        "often AS (SELECT file_id, v FROM words GROUP BY file_id, v HAVING count(*) >= 2)",
    ) + ("SELECT d.file_id, CAST(d.n AS INT) AS line, d.v AS detail FROM decl d "
         "ANTI JOIN often o ON o.file_id = d.file_id AND o.v = d.v")


_resource = lit(portable(jv.RESOURCE))
_rest = "array_to_string(list_slice(f.ls, l.n, len(f.ls)), chr(10))"
_CUSTOM = {
    "PT-15": _pt15,
    "JV-03": _detail_line(f"regexp_extract(l.s, {lit(portable(jv.DIGEST_NAME, True))}, 1)"),
    "JV-06": _detail_line(
        f"regexp_replace(split_part(regexp_extract(l.s, {_resource}, 0), '=', 1), {lit(TRIM)}, '', 'g')",
        f"NOT regexp_matches({_rest}, regexp_extract(l.s, {_resource}, 1) || {lit(portable(r'\.close\s*\('))}) "
        f"AND NOT {re_(f'substring({_rest}, 1, {jv.FINALLY_WINDOW})', jv.FINALLY)}"),
    "JV-07": _detail_line(NONE, f"({re_('l.s', jv.EMPTY_CATCH)} OR "
                                f"regexp_replace(coalesce({frame(1, 1)}, ''), {lit(TRIM)}, '', 'g') = chr(125))"),
    "AY-06": _ay06,
    "SM-01": lambda r: per_match(r, CLEAN, sm.LISTENER, f"NOT {re_(f'substring(after, 1, {sm.LISTENER_WINDOW})', sm.LISTENER_GUARD)}", "x0"),
    "SM-04": lambda r: per_file(r, more=f"NOT {re_(f'regexp_extract(f.content, {lit(portable(sm.AFTER_AWAIT))}, 1)', sm.QUEUE_CHECK)}"),
    "SM-10": lambda r: per_match(r, CLEAN, sm.CATCH_BODY, f"#2NOT {_sm10_kept}", "x0"),
    "SM-11": lambda r: per_file(r, f"len({_names(sm.STATE_FIELD)}) || ' fields (' || "
                                   f"array_to_string(list_slice({_names(sm.STATE_FIELD)}, 1, 3), ', ') || ')'"),
    "SM-12": lambda r: per_file(r, f"CAST(len(regexp_extract_all(f.content, {lit(portable(sm.NESTED_ARROWS))})) AS VARCHAR)"),
    "SM-20": lambda r: per_file(r, more=(
        f"len(list_filter({_names(sm.MODULE_NAME)}, lambda v: regexp_matches(f.content, v || "
        f"{lit(portable(r'\s*\.\s*\w+\s*=|'))} || v || {lit(portable(r'\s*\['))}))) > 0")),
    "AU-01": lambda r: per_match(r, CLEAN, au.CATCH_BLOCK,
                                 f"{re_('x0', au.BODY_CLEARS)} AND NOT {re_('x0', au.BODY_ITERATES)}"),
    "AU-02": lambda r: per_match(
        r, f"regexp_replace(translate(f.content, chr(1) || chr(2), '  '), {lit(BRACE_MARK)}, '\\1' || chr(2), 'g')",
        branch_pattern(), f"#2{re_('x0', au.IF_RESOLVES)} AND {re_('x1', au.ELSE_CLEARS)} AND NOT {re_('x1', au.ELSE_NOTIFIES)}"),
    "AU-05": lambda r: per_file(r, _flag, (
        f"regexp_matches(f.content, {lit('(?i)' + portable(r'if\s*\(\s*!?'))} || {_flag} || "
        f"{lit(portable(r'\s*\)[^{]*\{[^}]*'))} || {_flag} || {lit(portable(r'\s*=\s*true'))})"), _flag_line),
    "AU-06": lambda r: per_file(r, _flag, f"{_flag_count('true')} > {_flag_count('false')}", _flag_line),
    "AU-07": lambda r: per_file(r, _flag, f"{_flag_count('true')} > 0 AND NOT {re_('f.content', au.FINALLY_FALSE)}", _flag_line),
    "AU-10": _au10,
    "LT-07": _lt07,
}


def all_findings_sql() -> str:
    """Every rule in one statement, with the catalogue columns."""
    parts = []
    for r in CATALOGUE:
        sql = inside(rule_sql(r.key))
        category = lit(r.category) if r.category else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT file_id, line, detail, '{r.key}' AS key, {r.stage} AS stage, {r.number} AS number, "
                     f"{lit(r.name)} AS rule, '{r.severity}' AS severity, {category} AS category, '{r.bucket}' AS bucket, "
                     f"CAST({r.penalty} AS DOUBLE) AS penalty, {'true' if r.line else 'false'} AS by_line, "
                     f"{lit(r.message)} AS template, {lit(r.advice)} AS suggestion FROM ({sql})")
    return "\nUNION ALL\n".join(parts)


__all__ = ["rule_sql", "all_findings_sql", "LOOPS", "base", "frame", "head", "re_"]
