"""DuckDB SQL that gives the same rows as each registered query."""

from __future__ import annotations

from ..functions.dialect import portable
from ..functions.text import PROMPT_DEFAULT, PROMPT_LANGUAGE
from ..operators import report as RP, responses as R, reuse as U, score as C
from ..operators.scan import GATES, LAST, TRIM
from ..rules import CATALOGUE
from ..rules import auth as au, pattern as pt, semantic as sm
from .oracle_views import (CODE_FILES, DELIVERIES, DLQ, FILES, JOBS, LANGS, LINES, RESPONSES, REVIEW_JOBS,
                           SUBMISSIONS, language, lit)
from .queries import FRAMES, rule_name
from .rule_oracle import LOOPS, all_findings_sql, base, frame, re_, rule_sql

ALL_FOUND = f"""found AS (
  SELECT *, CASE WHEN stage IN (1, 2, 6) THEN CASE WHEN by_line THEN line ELSE {LAST} END ELSE number END AS k1,
    CASE WHEN stage IN (1, 2, 6) THEN number ELSE line END AS k2
  FROM ({all_findings_sql()})),
issues AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY stage, k1, k2, line, detail) AS position,
  replace(template, '{{}}', coalesce(detail, '')) AS message FROM found)"""


def w(*views: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(views) + "\n"


# ---- review ------------------------------------------------------------------
PER_FILE = """per_file AS (
  SELECT f.file_id, f.language, len(f.ls) AS n_lines,
    count(*) FILTER (i.bucket = 'security') AS n_security, count(*) FILTER (i.bucket = 'performance') AS n_performance,
    count(*) FILTER (i.bucket = 'style') AS n_style, count(i.bucket) AS n_issues,
    greatest(0.0, least(100.0, 100.0 - coalesce(sum(i.penalty), 0.0))) AS score
  FROM langs f LEFT JOIN issues i ON i.file_id = f.file_id GROUP BY ALL)"""
GRADE = "CASE " + " ".join(f"WHEN score >= {least} THEN '{g}'" for g, least in C.GRADES) + f" ELSE '{C.LOWEST_GRADE}' END"
REVIEW = w(CODE_FILES, LANGS, LINES, ALL_FOUND, PER_FILE)


def _report() -> str:
    def section(bucket: str) -> str:
        heading, fallback, severity = RP.SECTIONS[bucket]
        level = " || '   Severity: ' || severity || chr(10)" if severity else ""
        return (f"SELECT file_id, {lit(RP.SINGLE + heading)} || chr(10) || {lit(RP.SINGLE)} || chr(10) || "
                f"string_agg(rn || '. Line ' || line || ': ' || message || chr(10){level} || '   Rule: ' || rule || chr(10) "
                f"|| '   Suggestion: ' || coalesce(suggestion, {lit(fallback)}) || chr(10) || chr(10), '' ORDER BY rn) AS body "
                f"FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY position) AS rn FROM issues "
                f"WHERE bucket = '{bucket}') GROUP BY file_id")

    parts = ",\n".join(f"sec_{b} AS ({section(b)})" for b in RP.SECTIONS)
    bodies = " || ".join(f"coalesce(sec_{b}.body, '')" for b in RP.SECTIONS)
    joins = " ".join(f"LEFT JOIN sec_{b} ON sec_{b}.file_id = p.file_id" for b in RP.SECTIONS)
    n = "chr(10)"
    return (w(CODE_FILES, LANGS, LINES, ALL_FOUND, PER_FILE, parts) + "SELECT p.file_id, " + " || ".join([
        lit(RP.DOUBLE + RP.TITLE.center(59).rstrip()), n, lit(RP.DOUBLE), n, "'FILE: '", "f.file_name", n,
        "'LINES ANALYZED: '", "n_lines", n, "'REVIEW TIME: 0.0s'", n, "'TOTAL ISSUES FOUND: '", "n_issues", n,
        "'PROCESSING TIME: 0ms'", n, n, bodies, lit(RP.SINGLE + "SUMMARY"), n, lit(RP.SINGLE), n,
        "'Security Issues: '", "n_security", n, "'Performance Issues: '", "n_performance", n, "'Style Issues: '",
        "n_style", n, "'AI Suggestions: 0'", n, "'Total Issues: '", "n_issues", n, n, lit(RP.DOUBLE)])
        + f" AS report FROM per_file p JOIN code_files f ON f.file_id = p.file_id {joins}")


# ---- reuse -------------------------------------------------------------------
HASHED = "hashed AS (SELECT *, sha256(content) AS code_hash FROM submissions)"
TTL = f"INTERVAL {U.TTL_SECONDS} SECOND"
LABELS = f"""ordered AS (SELECT job_id, user_id, code_hash, created_at, content,
    row_number() OVER (PARTITION BY code_hash ORDER BY created_at, job_id) AS k FROM hashed),
walk AS (SELECT code_hash, k, job_id, created_at AS last, false AS hit FROM ordered WHERE k = 1
  UNION ALL SELECT o.code_hash, o.k, o.job_id,
    CASE WHEN o.created_at < w.last + {TTL} THEN w.last ELSE o.created_at END, o.created_at < w.last + {TTL}
  FROM walk w JOIN ordered o ON o.code_hash = w.code_hash AND o.k = w.k + 1),
labelled AS (SELECT o.job_id, o.user_id, o.created_at, w.hit, strlen(o.content) AS n_bytes
  FROM walk w JOIN ordered o ON o.job_id = w.job_id)"""
LABELLED = w(FILES, SUBMISSIONS, HASHED, LABELS, recursive=True)
# results live from completion: the completions of all misses of a hash so far are carried along
FLIGHTS = f"""flights AS (SELECT job_id, code_hash, created_at, content,
    CASE WHEN job_id % 17 <> 0 THEN created_at + to_seconds(job_id * 37 % 9001) END AS completed_at,
    row_number() OVER (PARTITION BY code_hash ORDER BY created_at, job_id) AS k FROM hashed),
walk AS (SELECT code_hash, k, job_id, false AS hit, [completed_at] AS done FROM flights WHERE k = 1
  UNION ALL SELECT code_hash, k, job_id, hit, CASE WHEN hit THEN done ELSE list_append(done, completed_at) END FROM (
    SELECT o.code_hash, o.k, o.job_id, o.completed_at, w.done,
      len(list_filter(w.done, lambda c: c <= o.created_at AND o.created_at < c + {TTL})) > 0 AS hit
    FROM walk w JOIN flights o ON o.code_hash = w.code_hash AND o.k = w.k + 1)),
labelled AS (SELECT o.job_id, o.created_at, w.hit, strlen(o.content) AS n_bytes FROM walk w JOIN flights o ON o.job_id = w.job_id)"""
FROM_COMPLETION = w(FILES, SUBMISSIONS, HASHED, FLIGHTS, recursive=True)

# ---- dead letters ------------------------------------------------------------
LETTERS = (DLQ + ", letters AS (SELECT *, 'error ' || CAST(id % 7 AS VARCHAR) AS last_error, "
           "CAST(NULL AS TIMESTAMP) AS last_retry_at, CAST(NULL AS TIMESTAMP) AS resolved_at, "
           "CAST(NULL AS VARCHAR) AS resolution_reason FROM dlq_messages)")
BOTH = w(REVIEW_JOBS, LETTERS)
LIST = ("d.id, d.job_id, d.message_id, d.receive_count, d.last_error, d.moved_to_dlq_at, d.retry_count, "
        "d.last_retry_at, d.resolved, j.file_name, j.status, j.attempts")
JOIN = "FROM letters d LEFT JOIN review_jobs j ON d.job_id = j.id"
FIRST_LETTER = "QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY moved_to_dlq_at, id) = 1"

LOG = ("log AS (SELECT event_id - event_id % 4 AS job_id, event_id, CASE event_type WHEN 'signup' THEN 'queued' "
       "WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'retrying' ELSE 'dlq' END AS status, ts "
       "FROM events)")
LAST_STATE = "QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1"

ROUTED = (w(DELIVERIES, "ranked AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY delivered_at, delivery_id) AS k FROM deliveries)",
            "live AS (SELECT * FROM ranked r WHERE k <= 3 AND NOT EXISTS "
            "(SELECT 1 FROM ranked p WHERE p.message_id = r.message_id AND p.k < r.k AND NOT p.failed))")
          + "SELECT d.delivery_id, d.message_id, CAST(l.k AS INT) AS attempt, CASE WHEN l.k IS NULL THEN 'ignored' "
            "WHEN NOT l.failed THEN 'complete' WHEN l.k >= 3 THEN 'dlq' ELSE 'retrying' END AS status "
            "FROM deliveries d LEFT JOIN live l ON l.delivery_id = d.delivery_id")

SHOWN = "id, status, attempts, last_error, processing_time_ms, dlq_message_id"


def _changed(condition: str, **new: str) -> str:
    """Job rows with new values where a condition holds."""
    columns = ["id", "status", "attempts", "last_error", "processing_time_ms", "dlq_message_id"]
    columns += [c for c in new if c not in columns]
    picked = ", ".join(f"CASE WHEN {condition} THEN {new[c]} ELSE {c} END AS {c}" if c in new else c for c in columns)
    return w(REVIEW_JOBS) + f"SELECT {picked} FROM review_jobs"


# ---- responses ---------------------------------------------------------------
_fence = (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, {lit(TRIM)}, '', 'g'), "
          f"'^(?:```json)?(?:```)?', ''), '```\\z', ''), {lit(TRIM)}, '', 'g')")
TEXTS = RESPONSES + f", texts AS (SELECT *, {_fence} AS clean FROM responses)"
DOCS = TEXTS + f""", docs AS (SELECT response_id, provider, body, json_valid(clean) AS is_json,
  CASE WHEN json_valid(clean) THEN CAST(clean AS JSON) END AS doc FROM texts),
judged AS (SELECT *, CASE WHEN NOT is_json THEN 'not JSON'
  WHEN json_type(doc) NOT IN ('OBJECT', 'ARRAY') THEN {lit(R.NOT_OBJECT)}
  WHEN coalesce(json_type(doc->'suggestions'), '') <> 'ARRAY' THEN {lit(R.NOT_ARRAY)}
  WHEN len(list_filter(CAST(doc->'suggestions' AS JSON[]), lambda x: json_type(x) NOT IN ('OBJECT', 'ARRAY'))) > 0
    THEN 'a suggestion is not an object' END AS reject FROM docs)"""
_checks = " ".join(f"WHEN NOT json_exists(item, '$.{f}') THEN 'Missing required field: {f}'" for f in R.REQUIRED)
ITEMS = DOCS + f""", raw_items AS (SELECT response_id, CAST(unnest(range(len(CAST(doc->'suggestions' AS JSON[])))) AS INT) AS i,
  unnest(CAST(doc->'suggestions' AS JSON[])) AS item FROM judged WHERE reject IS NULL),
items AS (SELECT response_id, i, item, CASE {_checks}
  WHEN NOT (json_type(item->'line') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(item->>'line' AS DOUBLE) >= 1) THEN {lit(R.BAD_LINE)}
  WHEN NOT (item->>'severity' IN ({', '.join(map(lit, R.SEVERITIES))})) THEN 'Invalid severity: ' || (item->>'severity')
  WHEN NOT (item->>'category' IN ({', '.join(map(lit, R.CATEGORIES))})) THEN 'Invalid category: ' || (item->>'category')
  WHEN NOT (json_type(item->'issue') = 'VARCHAR' AND item->>'issue' <> '') THEN {lit(R.BAD_ISSUE)} END AS reason
  FROM raw_items)"""


def _count(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(content, {lit(portable(pattern))})) AS INT)"


def _prompt_language() -> str:
    key = "lower(string_split(file_name, '.')[-1])"
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PROMPT_LANGUAGE.items()) + f" ELSE '{PROMPT_DEFAULT}' END"


def _seconds(ms: str) -> str:
    """One decimal; an exact tie goes up."""
    return f"printf('%.1fs', ({ms}) / 1000.0 + CASE WHEN ({ms}) % 500 = 250 THEN 0.01 ELSE 0 END)"


def _names(pattern: str) -> str:
    every = f"regexp_extract_all(content, {lit(portable(pattern))}, 1)"
    return f"list_filter({every}, lambda x, i: list_position({every}, x) = i)"


def _nl(text: str) -> str:
    return f"CAST(len({text}) - len(replace({text}, chr(10), '')) + 1 AS INT)"


def oracles() -> dict[str, str]:
    code = w(CODE_FILES)
    sub = w(FILES, SUBMISSIONS)
    hashed = w(FILES, SUBMISSIONS, HASHED)
    lang = w(CODE_FILES, LANGS)
    lined = w(CODE_FILES, LANGS, LINES)
    o = {rule_name(r.key): rule_sql(r.key) for r in CATALOGUE}

    # sources and sinks
    o["s01_submissions_source"] = sub + ("SELECT CAST(CASE WHEN job_id % 5 = 0 THEN 1 ELSE user_id END AS INT) AS user_id, file_name, "
                                         "sha256(content) AS code_hash FROM submissions")
    o["s02_job_table"] = w(REVIEW_JOBS) + "SELECT id, status, result, created_at, CAST(created_at AS DATE) AS day FROM review_jobs"
    o["s03_job_stream"] = hashed + ("SELECT CAST(job_id AS VARCHAR) AS \"jobId\", code_hash AS \"codeHash\", file_name AS \"fileName\", "
                                    "CAST(length(content) AS INT) AS n_chars FROM hashed")
    o["s04_dead_letter_stream"] = "SELECT event_id, event_type, ts FROM events WHERE event_type IN ('error', 'click')"
    o["s05_publish"] = hashed + "SELECT CAST(job_id AS VARCHAR) AS \"jobId\", code_hash AS \"codeHash\", file_name AS \"fileName\" FROM hashed"
    o["s06_result_documents"] = REVIEW + (f"SELECT file_id, {GRADE} AS grade, CAST(n_issues AS INT) AS issues_found, "
                                          "CAST(n_lines AS INT) AS lines_analyzed, CAST(n_issues AS INT) AS in_document FROM per_file")
    o["s07_cache_table"] = hashed + "SELECT code_hash, max(created_at) AS cached_at FROM hashed GROUP BY 1"
    o["s08_report_sink"] = f"SELECT file_id, md5(report) AS digest FROM ({_report()})"
    o["s09_dead_letter_sink"] = w(DLQ) + f"SELECT message_id, id FROM dlq_messages {FIRST_LETTER}"

    # projections and filters
    o["p_valid_submissions"] = sub + "SELECT job_id, CASE WHEN job_id % 7 = 0 OR job_id % 11 = 0 THEN 'File content required' END AS reject FROM submissions"
    o["p_status_view"] = w(REVIEW_JOBS) + "SELECT id, status, result, cache_hit, processing_time_ms, created_at, completed_at FROM review_jobs"
    issues_found = "CAST(json_extract_string(result, '$.metrics.issuesFound') AS INT) AS issues_found"
    o["p_hist_view"] = w(REVIEW_JOBS) + f"SELECT id, user_id, file_name, status, cache_hit, processing_time_ms, created_at, {issues_found} FROM review_jobs"
    o["p_done_jobs"] = w(REVIEW_JOBS) + "SELECT id, file_name, result FROM review_jobs WHERE status = 'complete'"
    security = "(SELECT file_id, string_agg(line || ':' || rule, ';' ORDER BY position) AS listed, arg_min(rule, position) AS first_rule FROM issues WHERE bucket = 'security' GROUP BY 1)"
    o["p_hit_result"] = REVIEW + (
        f"SELECT p.file_id, {lit(U.HIT_REVIEW_TIME)} AS \"reviewTime\", 0 AS \"processingTimeMs\", {_seconds('p.file_id % 5000')} AS \"originalReviewTime\", "
        "CAST(p.file_id % 5000 AS INT) AS \"originalProcessingTimeMs\", CAST(n_lines AS INT) AS \"linesAnalyzed\", CAST(n_issues AS INT) AS \"issuesFound\", "
        f"{GRADE} AS \"qualityScore\", coalesce(s.listed, '') AS security FROM per_file p LEFT JOIN {security} s ON s.file_id = p.file_id")
    o["p_res_flag"] = w(DLQ) + "SELECT id, message_id, resolved FROM dlq_messages"
    size = f"len(ls) BETWEEN {R.MIN_LINES} AND {R.MAX_LINES}"
    o["p_ai_eligible"] = lang + f"SELECT file_id, CAST(len(ls) AS INT) AS n_lines FROM langs WHERE {size}"
    severe = "bucket IN ('security', 'performance') AND severity IN ('high', 'critical')"
    o["p_sev_issues"] = w(CODE_FILES, LANGS, LINES, ALL_FOUND) + f"SELECT file_id, rule, line, severity, bucket FROM issues WHERE {severe}"
    pl = _prompt_language()
    o["p_prompt_table"] = lang + (
        f"SELECT file_id, {pl} AS language, CAST(len(ls) AS INT) AS n_lines, md5('Review this ' || {pl} || ' code.' || chr(10) || chr(10) || "
        f"'FILE: ' || file_name || chr(10) || 'LINES: ' || len(ls) || chr(10) || chr(10) || 'CODE:' || chr(10) || '```' || {pl} || chr(10) "
        f"|| content || chr(10) || '```') AS digest FROM langs WHERE {size}")
    for name, ((pattern, fold),) in GATES.items():
        o[f"p_gate{name}"] = code + f"SELECT file_id, {re_('content', pattern, fold)} AS open FROM code_files"
    o["p_gate_rate"] = code + (f"SELECT file_id, {re_('content', sm.LIMITER, True)} OR ({re_('content', 'limit')} AND "
                               f"{re_('content', sm.LIMITER_CONTEXT, True)}) AS open FROM code_files")
    o["p_gate_lang"] = code + f"SELECT file_id, {language()} = 'java' AS java, {language()} = 'python' AS python FROM code_files"

    # joins
    o["j01_dead_letter_list"] = BOTH + f"SELECT {LIST} {JOIN}"
    o["j02_dead_letter_detail"] = BOTH + (f"SELECT {LIST}, d.resolved_at, d.resolution_reason, j.file_name || ' text' AS file_content, "
                                          f"j.last_error AS job_last_error {JOIN}")
    o["j03_cache_lookup"] = hashed + (
        f"SELECT h.job_id, max(c.created_at) AS cached_at FROM hashed h LEFT JOIN hashed c ON c.code_hash = h.code_hash AND c.job_id % 3 = 0 "
        f"AND h.created_at >= c.created_at AND h.created_at < c.created_at + {TTL} GROUP BY h.job_id")
    o["j05_insert_if_absent"] = w(DLQ) + ("SELECT message_id, id FROM dlq_messages WHERE message_id NOT IN "
                                          f"(SELECT message_id FROM dlq_messages WHERE resolved) {FIRST_LETTER}")
    o["j06_update_by_key"] = w(REVIEW_JOBS, DLQ) + (
        "SELECT j.id, coalesce(CASE WHEN d.id IS NOT NULL THEN 'dlq' END, j.status) AS status, coalesce(d.receive_count, j.attempts) AS attempts "
        "FROM review_jobs j LEFT JOIN dlq_messages d ON d.id = j.id")
    o["j07_forward_search"] = rule_sql("AY-06")
    o["j08_rule_catalogue"] = w(CODE_FILES, LANGS, LINES, ALL_FOUND) + "SELECT file_id, line, rule, severity, bucket, penalty, suggestion FROM issues"
    o["j09_files_with_severe_issues"] = w(CODE_FILES, LANGS, LINES, ALL_FOUND) + (
        f"SELECT f.file_id, CAST(len(f.ls) AS INT) AS n_lines, CAST(count(*) AS INT) AS n_severe FROM langs f JOIN issues i ON i.file_id = f.file_id "
        f"WHERE {severe} AND {size} GROUP BY ALL")

    # aggregates
    o["a01_job_rollup"] = w(JOBS) + (
        "SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'processing') AS processing, "
        "count(*) FILTER (status = 'complete') AS completed, count(*) FILTER (status IN ('failed', 'retrying')) AS failed, count(*) AS total, "
        "CAST(floor(coalesce(avg(processing_time_ms) FILTER (status = 'complete' AND processing_time_ms > 0), 0) + 0.5) AS BIGINT) AS avg_time FROM jobs")
    o["t10_dashboard"] = o["a01_job_rollup"]
    letter_stats = "count(*) AS total_messages, count_if(NOT resolved) AS unresolved, count_if(resolved) AS resolved"
    o["a02_dead_letter_stats"] = w(DLQ) + (f"SELECT {letter_stats}, count(DISTINCT job_id) AS unique_jobs, max(moved_to_dlq_at) AS latest_message, "
                                           "round(avg(retry_count), 6) AS avg_retries FROM dlq_messages")
    o["t10_dead_letter_dashboard"] = o["a02_dead_letter_stats"]
    o["a03_cache_stats"] = LABELLED + ("SELECT count_if(hit) AS hits, count_if(NOT hit) AS misses, "
                                       "round(100.0 * count_if(hit) / count(*), 2) AS hit_rate FROM labelled")
    o["a04_issue_counts"] = REVIEW + "SELECT file_id, n_security, n_performance, n_style, n_issues FROM per_file"
    o["a05_quality_score"] = REVIEW + "SELECT file_id, score FROM per_file"
    o["a06_letter_grade"] = REVIEW + f"SELECT file_id, {GRADE} AS grade FROM per_file"
    listed = ", ".join(f"coalesce(string_agg(i.line || ':' || i.rule, ';' ORDER BY position) FILTER (i.bucket = '{b}'), '') AS {b}" for b in C.BUCKETS)
    o["a07_bucket_arrays"] = w(CODE_FILES, LANGS, LINES, ALL_FOUND) + (
        f"SELECT f.file_id, {listed} FROM langs f LEFT JOIN issues i ON i.file_id = f.file_id GROUP BY f.file_id")
    o["a08_lines_analysed"] = lang + "SELECT file_id, CAST(len(ls) AS INT) AS n_lines FROM langs"
    first_three = f"array_to_string(list_slice({_names(sm.STATE_FIELD)}, 1, 3), ', ') AS first_three"
    o["a09_state_variables"] = code + f"SELECT file_id, CAST(len({_names(sm.STATE_FIELD)}) AS INT) AS n, {first_three} FROM code_files"
    o["a10_greedy_ttl"] = LABELLED + "SELECT job_id, hit FROM labelled"
    o["t05_reuse_stream"] = o["a10_greedy_ttl"]
    o["a10_reuse_from_completion"] = FROM_COMPLETION + "SELECT job_id, hit FROM labelled"
    o["t05_reuse_from_completion"] = o["a10_reuse_from_completion"]
    o["a11_match_counts"] = code + (f"SELECT file_id, {_count(sm.NESTED_ARROWS)} AS nested, {_count('=>')} AS arrows, "
                                    f"{_count(r'\w+\s*=\s*true')} AS set_true FROM code_files")
    o["a12_first_matching_line"] = lined + (f"SELECT f.file_id, CAST(coalesce(min(l.n), 0) AS INT) AS line FROM langs f LEFT JOIN lines l ON "
                                            f"l.file_id = f.file_id AND {re_('l.s', r'(?:^|\W)function|=>')} GROUP BY f.file_id")

    # frames and folds
    calls = "FROM lines l JOIN langs f ON f.file_id = l.file_id"
    for name, (first, last) in FRAMES.items():
        text = f"coalesce({frame(first, last)}, '')"
        o[name] = lined + (f"SELECT l.file_id, CAST(l.n AS INT) AS line, CAST(length({text}) AS INT) AS n_chars, md5({text}) AS digest {calls}")
    rest = "array_to_string(list_slice(f.ls, l.n, len(f.ls)), chr(10))"
    o["w03_rest_of_file"] = lined + (f"SELECT l.file_id, CAST(l.n AS INT) AS line, CAST(length({rest}) AS INT) AS n_chars, "
                                     f"md5(substring({rest}, 1, 500)) AS digest {calls}")
    o["w11_loop_depth"] = base(LOOPS, recursive=True) + (
        "SELECT l.file_id, CAST(l.n AS INT) AS line, CAST(coalesce(d.depth, 0) AS INT) AS depth FROM lines l "
        "LEFT JOIN depths d ON d.file_id = l.file_id AND d.n = l.n")
    change = (f"len(regexp_extract_all(s, {lit(portable(au.SCOPE_OPENS))})) - CASE WHEN {re_('s', au.SCOPE_CLOSES)} THEN 1 ELSE 0 END")
    o["w12_function_depth"] = w(CODE_FILES, LANGS, LINES, f"steps AS (SELECT file_id, n, {change} AS d FROM lines)",
                                "walk AS (SELECT file_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS depth FROM langs UNION ALL SELECT s.file_id, s.n, "
                                "greatest(0, w.depth + s.d) FROM walk w JOIN steps s ON s.file_id = w.file_id AND s.n = w.n + 1)",
                                recursive=True) + "SELECT file_id, CAST(n AS INT) AS line, CAST(depth AS INT) AS depth FROM walk WHERE n > 0"
    state = lit(portable(au.STATE_NAME, True))
    o["w12_global_state"] = w(CODE_FILES, LANGS, LINES, f"steps AS (SELECT file_id, n, s, {change} AS d FROM lines)",
                              "walk AS (SELECT file_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS depth, '' AS s FROM langs UNION ALL SELECT s.file_id, s.n, "
                              "greatest(0, w.depth + s.d), s.s FROM walk w JOIN steps s ON s.file_id = w.file_id AND s.n = w.n + 1)",
                              recursive=True) + (
        f"SELECT file_id, CAST(min(n) FILTER (n > 0 AND depth = 0 AND regexp_matches(s, {state})) AS INT) AS line, "
        f"coalesce(string_agg(regexp_extract(s, {state}, 1), ',' ORDER BY n) FILTER (n > 0 AND depth = 0 AND regexp_matches(s, {state})), '') AS names, "
        "CAST(arg_max(depth, n) AS INT) AS depth FROM walk GROUP BY file_id")
    o["w13_gap_suppression"] = w(
        CODE_FILES, LANGS, LINES,
        "cand AS (SELECT file_id, n, row_number() OVER (PARTITION BY file_id ORDER BY n) AS k FROM lines)",
        f"pick AS (SELECT file_id, k, n, n AS last, true AS keep FROM cand WHERE k = 1 UNION ALL SELECT c.file_id, c.k, c.n, "
        f"CASE WHEN c.n - p.last >= {pt.VALIDATION_GAP} THEN c.n ELSE p.last END, c.n - p.last >= {pt.VALIDATION_GAP} "
        f"FROM pick p JOIN cand c ON c.file_id = p.file_id AND c.k = p.k + 1)",
        recursive=True) + "SELECT file_id, CAST(n AS INT) AS line FROM pick WHERE keep"
    o["w14_latest_state"] = w(LOG) + f"SELECT job_id, event_id, status, ts FROM log {LAST_STATE}"

    # order and limits
    o["o01_user_histories"] = w(REVIEW_JOBS) + (
        f"SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS INT) AS position, id, file_name, status, "
        f"cache_hit, processing_time_ms, created_at, {issues_found} FROM review_jobs QUALIFY position <= 50")
    o["o02_dead_letter_page"] = BOTH + (f"SELECT d.id, d.job_id, j.status {JOIN} WHERE NOT d.resolved "
                                        "ORDER BY d.moved_to_dlq_at DESC, d.id LIMIT 50 OFFSET 50")
    o["o03_dead_letter_order"] = BOTH + f"SELECT d.id, d.moved_to_dlq_at, j.status, d.resolved {JOIN} ORDER BY 2 DESC, 1"
    o["o04_first_three_names"] = code + f"SELECT file_id, {first_three} FROM code_files"
    o["o05_emission_order"] = w(CODE_FILES, LANGS, LINES, ALL_FOUND) + "SELECT file_id, CAST(position AS INT) AS position, key, line FROM issues"

    # set operations
    o["u01_all_detectors"] = w(CODE_FILES, LANGS, LINES, ALL_FOUND) + "SELECT file_id, key, line, detail FROM issues"
    o["u02_security_and_performance"] = w(CODE_FILES, LANGS, LINES, ALL_FOUND) + (
        "SELECT f.file_id, CAST(count(i.bucket) AS INT) AS n, coalesce(sum(i.penalty), 0.0) AS penalty FROM langs f LEFT JOIN issues i "
        "ON i.file_id = f.file_id AND i.bucket IN ('security', 'performance') GROUP BY f.file_id")
    words = "regexp_extract_all(content, '\\w+')"
    o["u03_distinct_words"] = code + (f"SELECT file_id, CAST(len({words}) AS INT) AS n_words, CAST(len(list_distinct({words})) AS INT) AS n_distinct FROM code_files")

    # scalar functions
    def each(select: str) -> str:
        return code + f"SELECT file_id, {select} FROM code_files"

    o["f01_sha256"] = each("sha256(content) AS code_hash")
    o["f03_split_lines"] = lined + "SELECT file_id, CAST(n AS INT) AS line_no, s AS line FROM lines"
    o["f04_extension"] = each("lower(regexp_extract(file_name, '[^/](\\.[^./]*)\\z', 1)) AS ext")
    o["f05_language"] = each(f"{language()} AS language")
    o["f06_prompt_language"] = each(f"{pl} AS language")
    o["f07_regex_test"] = each(f"{re_('content', r'(?:^|\W)const\s+\w+\s*=')} AS found")
    o["f08_dynamic_regex"] = each("regexp_matches(content, '\\W' || regexp_extract(content, '^(\\w+)', 1) || '\\W') AS again")
    o["f09_capture_group"] = each(f"regexp_extract(content, {lit(portable(r'(?:const|let|var)\s+(\w+)'))}, 1) AS name")
    o["f10_all_matches"] = each(f"array_to_string(regexp_extract_all(content, {lit(portable(r'(\w+)\s*\('))}, 1), ',') AS calls")
    before = f"string_split_regex(content, {lit(portable(r'=\s*\S'))})[1]"
    o["f11_match_line"] = each(f"CASE WHEN {re_('content', r'=\s*\S')} THEN {_nl(before)} ELSE 0 END AS line")
    segs = f"string_split(regexp_replace(replace(content, chr(1), chr(2)), '\\w+\\(', chr(1) || '\\0', 'g'), chr(1))"
    o["f12_look_ahead"] = code + (f"SELECT file_id, md5(array_to_string(list_transform(range(1, len(segs)), lambda k: "
                                  f"substring(array_to_string(list_slice(segs, k + 1, len(segs)), ''), 1, 200)), '|')) AS digest "
                                  f"FROM (SELECT file_id, {segs} AS segs FROM code_files)")
    o["f13_after_await"] = each(f"regexp_extract(content, {lit(portable(sm.AFTER_AWAIT))}, 1) AS after")
    o["f14_brace_count"] = each("CAST(len(content) - len(replace(content, chr(123), '')) AS INT) AS opens, "
                                "CAST(len(content) - len(replace(content, chr(125), '')) AS INT) AS closes")
    o["f15_text_case"] = each("md5(lower(content)) AS low, upper(file_name) AS up, "
                              f"CAST(length(regexp_replace(content, {lit(TRIM)}, '', 'g')) AS INT) AS trimmed")
    o["f16_parse_int"] = code + (
        "SELECT file_id, CAST(k AS INT) AS k, coalesce(CASE WHEN regexp_full_match(word, '[0-9]+') THEN TRY_CAST(word AS INT) END, 50) AS value FROM (SELECT file_id, "
        "unnest(words) AS word, generate_subscripts(words, 1) - 1 AS k FROM (SELECT file_id, "
        "regexp_extract_all(content, '[0-9A-Za-z]*[0-9][0-9A-Za-z]*') AS words FROM code_files))")
    o["f17_number_format"] = each(f"{_seconds('file_id * 10')} AS seconds, printf('%.2f%%', file_id / 4.0) AS percent")
    o["f18_round_half_up"] = each("CAST(floor(file_id / 2.0 + 0.5) AS BIGINT) AS rounded")
    o["f19_json"] = w(REVIEW_JOBS) + ("SELECT id, json_extract_string(result, '$.fileName') AS \"fileName\", "
                                      "CAST(json_extract_string(result, '$.metrics.issuesFound') AS INT) AS n, result AS again FROM review_jobs WHERE result IS NOT NULL")
    o["f02_random_id"] = w(JOBS) + "SELECT count(*) AS n_jobs, count(*) AS n_distinct, count(*) AS n_version_4 FROM jobs"
    o["f20_report_text"] = _report()
    o["f21_strip_fences"] = w(TEXTS) + "SELECT response_id, clean AS text FROM texts"
    o["f22_array_helpers"] = lang + ("SELECT file_id, CAST(len(list_filter(ls, lambda s: contains(s, '('))) AS INT) AS calls, "
                                     "list_contains(ls, chr(125)) AS closes, array_to_string(list_transform(ls[-2:], lambda s: length(s)), ',') AS tail_lengths FROM langs")
    o["f23_struct_update"] = w(JOBS) + "SELECT id, status, 0 AS attempts, true AS seen FROM jobs"
    o["f24_time"] = w(JOBS) + "SELECT id, created_at + INTERVAL 3600 SECOND AS expires, CAST(created_at AS DATE) AS day FROM jobs"
    o["f25_message_text"] = w(CODE_FILES, LANGS, LINES, ALL_FOUND) + (
        "SELECT file_id, line, message FROM issues WHERE contains(template, '{}')")

    # responses
    o["r01_response_text"] = w(RESPONSES) + "SELECT response_id, body AS text FROM responses"
    o["r02_parse"] = w(DOCS) + "SELECT response_id, is_json FROM judged"
    o["r03_envelope"] = w(DOCS) + "SELECT response_id, reject FROM judged"
    o["r04_suggestion_checks"] = w(ITEMS) + "SELECT response_id, i, reason FROM items"
    fields = ", ".join(f"item->>'{f}' AS {f}" for f in R.REQUIRED[1:])
    o["r05_valid_suggestions"] = w(ITEMS) + f"SELECT response_id, i, CAST(item->>'line' AS DOUBLE) AS line, {fields} FROM items WHERE reason IS NULL"
    o["r05_errors"] = w(ITEMS) + "SELECT response_id, i, 'Suggestion[' || i || ']: ' || reason AS error FROM items WHERE reason IS NOT NULL"

    # streams
    o["t01_review_stream"] = REVIEW + f"SELECT file_id, language, CAST(n_issues AS INT) AS n_issues, score, {GRADE} AS grade FROM per_file"
    o["t02_idempotent_capture"] = w(DLQ) + f"SELECT message_id, id, job_id, receive_count FROM dlq_messages {FIRST_LETTER}"
    o["t03_retry_routing"] = ROUTED
    o["t03_retry_routing_state"] = ROUTED
    o["t03_retry_routing_batch"] = ROUTED
    o["t04_latest_status"] = ("SELECT event_id - event_id % 4 AS job_id, event_type AS status, ts FROM events "
                              "QUALIFY row_number() OVER (PARTITION BY event_id - event_id % 4 ORDER BY ts DESC, event_id DESC) = 1")
    o["t06_possible_hits"] = w(FILES) + (
        f"SELECT job_id, code_hash FROM (SELECT e.event_id AS job_id, sha256(f.content) AS code_hash, e.ts FROM events e JOIN files f "
        f"ON f.file_id = e.event_id % (SELECT count(*) FROM documents)) s WHERE EXISTS (SELECT 1 FROM events c JOIN files g "
        f"ON g.file_id = c.event_id % (SELECT count(*) FROM documents) WHERE c.event_type = 'purchase' AND sha256(g.content) = s.code_hash "
        f"AND s.ts >= c.ts AND s.ts < c.ts + {TTL})")
    o["t07_retention"] = w(DLQ) + ("SELECT moved_to_dlq_at < (SELECT max(moved_to_dlq_at) FROM dlq_messages) - INTERVAL 14 DAY AS expired, "
                                   "count(*) AS n FROM dlq_messages GROUP BY 1")
    o["t02_job_half"] = w(LETTERS) + ("SELECT job_id, message_id, last_error, moved_to_dlq_at FROM letters "
                                      "QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY moved_to_dlq_at DESC, id DESC) = 1")
    old = "moved_to_dlq_at < (SELECT max(moved_to_dlq_at) FROM dlq_messages) - INTERVAL 14 DAY"
    o["t07_retention_stream"] = w(DLQ) + f"SELECT count(*) FILTER (NOT {old}) AS kept, count(*) FILTER ({old}) AS dropped FROM dlq_messages"
    missed = ("late AS (SELECT job_id, event_id, status FROM (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS next FROM log) "
              "WHERE status NOT IN ('complete', 'failed', 'dlq') AND next > ts + INTERVAL 30 SECOND)")
    still_open = ("SELECT job_id, event_id, status, ts FROM (SELECT * FROM log " + LAST_STATE + ") WHERE status NOT IN ('complete', 'failed', 'dlq') "
                  "AND (SELECT max(ts) FROM log) > ts + INTERVAL 30 SECOND")
    o["t08_deadline_stream"] = w(LOG, missed, f"still_open AS ({still_open})") + (
        "SELECT job_id, event_id, status, 'late' AS outcome FROM late UNION ALL SELECT job_id, event_id, status, 'open' AS outcome FROM still_open")
    o["t09_overdue_stream"] = w(LOG, f"still_open AS ({still_open})") + "SELECT job_id, status, ts FROM still_open"
    o["t08_visible_again"] = w(LOG, f"s AS (SELECT job_id, event_id, ts FROM log WHERE status = 'processing' {LAST_STATE})",
                               "e AS (SELECT job_id, max(ts) AS ended_at FROM log WHERE status IN ('complete', 'failed', 'dlq', 'retrying') GROUP BY 1)") + (
        "SELECT s.job_id, s.event_id, s.ts, e.ended_at FROM s LEFT JOIN e ON e.job_id = s.job_id "
        "WHERE e.ended_at IS NULL OR e.ended_at < s.ts OR e.ended_at > s.ts + INTERVAL 30 SECOND")
    o["t09_overdue"] = w(LOG) + ("SELECT job_id, status, ts FROM (SELECT * FROM log " + LAST_STATE + ") WHERE status NOT IN ('complete', 'failed', 'dlq') "
                                 "AND (SELECT max(ts) FROM log) > ts + INTERVAL 30 SECOND")

    # table changes
    o["m01_start"] = _changed("status = 'queued'", status="'processing'", attempts="1")
    o["m02_finish"] = _changed("status = 'dlq'", status="'complete'", attempts="2", last_error="NULL", processing_time_ms="7",
                               dlq_message_id="NULL", result="'{}'", completed_at="created_at")
    o["m03_capture"] = w(REVIEW_JOBS, LETTERS, "last AS (SELECT job_id, message_id, last_error, moved_to_dlq_at FROM letters "
                         "QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY moved_to_dlq_at DESC, id DESC) = 1)") + (
        "SELECT j.id, CASE WHEN l.job_id IS NULL THEN j.status ELSE 'dlq' END AS status, j.attempts, "
        "coalesce(l.last_error, j.last_error) AS last_error, j.processing_time_ms, coalesce(l.message_id, j.dlq_message_id) AS dlq_message_id, "
        "coalesce(l.moved_to_dlq_at, j.dlq_moved_at) AS dlq_moved_at FROM review_jobs j LEFT JOIN last l ON l.job_id = j.id")
    o["m03_dead_letters"] = w(DLQ) + ("SELECT message_id, id, receive_count FROM dlq_messages WHERE NOT resolved AND message_id NOT IN "
                                      f"(SELECT message_id FROM dlq_messages WHERE resolved) {FIRST_LETTER}")
    o["m04_retry"] = w(LETTERS) + ("SELECT id, CAST(retry_count + CASE WHEN resolved THEN 0 ELSE 1 END AS INT) AS retry_count, "
                                   "CASE WHEN NOT resolved THEN moved_to_dlq_at END AS last_retry_at, resolved FROM letters")
    retried = "id IN (SELECT job_id FROM dlq_messages WHERE NOT resolved)"
    o["m04_retried_jobs"] = w(REVIEW_JOBS, DLQ) + (
        f"SELECT id, CASE WHEN {retried} THEN 'retrying' ELSE status END AS status, CASE WHEN {retried} THEN 0 ELSE attempts END AS attempts, "
        f"CASE WHEN {retried} THEN NULL ELSE last_error END AS last_error, processing_time_ms, dlq_message_id FROM review_jobs")
    o["m04_retry_messages"] = w(DLQ) + "SELECT job_id, '{\"jobId\":\"' || CAST(job_id AS VARCHAR) || '\"}' AS value FROM dlq_messages WHERE NOT resolved"
    o["m05_resolve"] = w(LETTERS) + (
        "SELECT id, resolved OR retry_count > 1 AS resolved, CASE WHEN retry_count > 1 THEN moved_to_dlq_at END AS resolved_at, "
        "CASE WHEN retry_count > 1 THEN CASE WHEN id % 2 = 0 THEN 'fixed' ELSE 'Manual resolution' END END AS resolution_reason FROM letters")
    o["m06_hit_insert"] = w(FILES, "code_files AS (SELECT * FROM files)", LANGS, LINES, ALL_FOUND, PER_FILE, SUBMISSIONS, HASHED, LABELS, REVIEW_JOBS, recursive=True) + (
        "SELECT id, user_id, file_name, NULL AS code_hash, status, cache_hit, processing_time_ms, completed_at, "
        "json_extract_string(result, '$.fileName') AS result_file, NULL AS review_time, NULL AS original_ms, NULL AS grade, NULL AS first_security_rule, "
        "CAST(json_extract_string(result, '$.metrics.issuesFound') AS INT) AS issues_found FROM review_jobs UNION ALL "
        "SELECT -1 - h.job_id, h.user_id, h.file_name, h.code_hash, 'complete', true, 0, h.created_at, e.file_name, "
        f"{lit(U.HIT_REVIEW_TIME)}, CAST(e.file_id % 5000 AS VARCHAR), {GRADE}, s.first_rule, CAST(p.n_issues AS INT) FROM labelled l JOIN hashed h ON h.job_id = l.job_id "
        "JOIN (SELECT sha256(content) AS code_hash, max(file_id) AS file_id, arg_max(file_name, file_id) AS file_name FROM files GROUP BY 1) e "
        f"ON e.code_hash = h.code_hash JOIN per_file p ON p.file_id = e.file_id LEFT JOIN {security} s ON s.file_id = e.file_id WHERE l.hit")
    o["m07_mixed_changes"] = w(
        REVIEW_JOBS,
        "log AS (SELECT event_id - event_id % 4 AS id, event_id % 3 AS k, ts, event_id FROM events)",
        "n AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC) = 1)",
        "e AS (SELECT * FROM log WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC) = 1)",
        "f AS (SELECT * FROM log WHERE k = 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC) = 1)") + (
        "SELECT j.id, CASE n.k WHEN 0 THEN 'processing' WHEN 1 THEN 'retrying' WHEN 2 THEN 'complete' ELSE j.status END AS status, "
        "CASE WHEN n.id IS NULL THEN j.attempts ELSE CAST(n.event_id % 5 AS INT) END AS attempts, "
        "CASE WHEN e.id IS NULL THEN j.last_error WHEN e.k = 1 THEN 'e' || e.event_id END AS last_error, "
        "CASE WHEN f.id IS NULL THEN j.processing_time_ms ELSE CAST(f.event_id % 900 AS INT) END AS processing_time_ms, "
        "CASE WHEN f.id IS NULL THEN j.dlq_message_id END AS dlq_message_id, CASE WHEN f.id IS NULL THEN j.result ELSE 'r' || f.event_id END AS result, "
        "CASE WHEN f.id IS NULL THEN j.completed_at ELSE f.ts END AS completed_at "
        "FROM review_jobs j LEFT JOIN n ON n.id = j.id LEFT JOIN e ON e.id = j.id LEFT JOIN f ON f.id = j.id")
    o["m07_committed_changes"] = o["m07_mixed_changes"]
    o["m07_failed_attempt"] = _changed("status = 'processing'", status="'retrying'", attempts="2", last_error="'boom'")

    # user surface and corpus views
    o["x01_review"] = REVIEW + (f"SELECT file_id, language, CAST(n_lines AS INT) AS n_lines, CAST(n_issues AS INT) AS n_issues, score, {GRADE} AS grade FROM per_file")
    o["x02_detector_table"] = w(CODE_FILES, LANGS, LINES, ALL_FOUND) + "SELECT file_id, substring(key, 1, 2) AS detector, key, line FROM issues"
    o["x03_user_rule"] = lined + (f"SELECT file_id, CAST(n AS INT) AS line, 'user/todo-marker' AS rule, 'low' AS severity FROM lines WHERE {re_('s', r'(?:^|\W)[Hh]andle(?:\W|$)')}")
    dim = ", ".join(f"({lit(r.key)}, {lit(r.name)})" for r in CATALOGUE)
    o["c01_rule_frequency"] = w(CODE_FILES, LANGS, LINES, ALL_FOUND, f"dim AS (SELECT * FROM (VALUES {dim}) AS v(key, rule))") + (
        "SELECT d.key, d.rule, count(i.key) AS hits, count(DISTINCT i.file_id) AS files_hit, "
        "round(count(DISTINCT i.file_id) / (SELECT count(*) FROM documents), 6) AS share FROM dim d LEFT JOIN issues i ON i.key = d.key GROUP BY d.key, d.rule")
    o["c02_grades_by_language"] = REVIEW + f"SELECT language, {GRADE} AS grade, count(*) AS files, round(avg(score), 6) AS mean_score FROM per_file GROUP BY 1, 2"
    o["c03_worst_files"] = REVIEW + ("SELECT language, file_id, score, CAST(row_number() OVER (PARTITION BY language ORDER BY score, file_id) AS INT) AS position "
                                     "FROM per_file QUALIFY position <= 10")
    o["c04_reuse_per_day"] = LABELLED + (
        "SELECT CAST(created_at AS DATE) AS day, count(*) AS submissions, count_if(NOT hit) AS analyses, round(100.0 * count_if(hit) / count(*), 2) AS hit_rate, "
        "CAST(sum(CASE WHEN hit THEN n_bytes ELSE 0 END) AS BIGINT) AS bytes_saved FROM labelled GROUP BY 1")
    o["c04_reuse_from_completion"] = FROM_COMPLETION + o["c04_reuse_per_day"].removeprefix(LABELLED)
    # one review per content, shared by all its submissions
    o["j04_review_once_per_hash"] = w(CODE_FILES, SUBMISSIONS.replace("JOIN files f", "JOIN code_files f"), HASHED, LANGS, LINES, ALL_FOUND, PER_FILE,
                                      "firsts AS (SELECT code_hash, file_id, file_name FROM hashed "
                                      "QUALIFY row_number() OVER (PARTITION BY code_hash ORDER BY created_at, job_id) = 1)") + (
        f"SELECT h.job_id, f.file_name AS result_name, p.score, {GRADE} AS grade FROM hashed h JOIN firsts f ON f.code_hash = h.code_hash "
        "JOIN per_file p ON p.file_id = f.file_id")
    return o
