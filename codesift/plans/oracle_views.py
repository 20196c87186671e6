"""DuckDB views of the derived inputs, as common table expressions."""

from __future__ import annotations

from ..functions.dialect import portable
from ..functions.text import DEFAULT_LANGUAGE, JAVA_TEXT, LANGUAGE_BY_EXTENSION, PYTHON_TEXT
from ..sources.derived import PROVIDERS
from ..sources.snippets import ALL, BASIC


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _files(name: str, snippets) -> str:
    rows = ", ".join(f"({i}, {lit(e)}, {lit(b)})" for i, (e, b, _) in enumerate(snippets))
    return (
        f"{name} AS (SELECT d.doc_id AS file_id, 'f' || CAST(d.doc_id AS VARCHAR) || s.ext AS file_name, "
        f"d.text || chr(10) || replace(replace(s.body, '~', chr(10)), '@', chr(39)) AS content "
        f"FROM documents d JOIN (VALUES {rows}) AS s(sid, ext, body) ON d.doc_id % {len(snippets)} = s.sid)")


def language(name: str = "file_name", text: str = "content") -> str:
    ext = f"lower(regexp_extract({name}, '[^/](\\.[^./]*)\\z', 1))"
    whens = " ".join(f"WHEN {lit(e)} THEN {lit(v)}" for e, v in LANGUAGE_BY_EXTENSION.items())
    return (f"CASE {ext} {whens} ELSE CASE WHEN regexp_matches({text}, {lit(portable(JAVA_TEXT))}) THEN 'java' "
            f"WHEN regexp_matches({text}, {lit(portable(PYTHON_TEXT))}) THEN 'python' "
            f"ELSE {lit(DEFAULT_LANGUAGE)} END END")


FILES = _files("files", BASIC)
CODE_FILES = _files("code_files", ALL)
LANGS = (f"langs AS (SELECT file_id, file_name, content, string_split(content, chr(10)) AS ls, "
         f"{language()} AS language FROM code_files)")
LINES = ("lines AS (SELECT file_id, language, unnest(ls) AS s, generate_subscripts(ls, 1) AS n FROM langs)")

SUBMISSIONS = (
    "submissions AS (SELECT e.event_id AS job_id, e.user_id, f.file_id, f.file_name, f.content, e.ts AS created_at "
    "FROM events e CROSS JOIN (SELECT count(*) AS n FROM documents) k JOIN files f ON f.file_id = e.event_id % k.n)")
JOBS = (
    "jobs AS (SELECT event_id AS id, user_id, 'f' || CAST(event_id AS VARCHAR) || '.js' AS file_name, "
    "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'complete' "
    "WHEN 'error' THEN 'retrying' ELSE 'dlq' END AS status, event_id % 3 = 0 AS cache_hit, "
    "CAST(1 + event_id % 3 AS INT) AS attempts, ts AS created_at, "
    "CAST(floor(value * 100) AS INT) AS processing_time_ms FROM events)")
REVIEW_JOBS = (
    JOBS + ", review_jobs AS (SELECT *, CASE WHEN status = 'complete' THEN '{\"fileName\":\"' || file_name || "
    "'\",\"metrics\":{\"issuesFound\":' || CAST(id % 11 AS VARCHAR) || '}}' END AS result, "
    "CASE WHEN status IN ('retrying', 'dlq') THEN 'error ' || CAST(id % 7 AS VARCHAR) END AS last_error, "
    "CASE WHEN status = 'dlq' THEN 'm' || CAST(id % 997 AS VARCHAR) END AS dlq_message_id, "
    "CASE WHEN status = 'dlq' THEN created_at END AS dlq_moved_at, "
    "CASE WHEN status = 'complete' THEN created_at END AS completed_at FROM jobs)")
DLQ = (
    "dlq_messages AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN -1 - event_id "
    "ELSE event_id - event_id % 4 END AS job_id, 'm' || CAST(event_id % 997 AS VARCHAR) AS message_id, "
    "CAST(3 + event_id % 2 AS INT) AS receive_count, ts AS moved_to_dlq_at, CAST(event_id % 4 AS INT) AS retry_count, "
    "event_id % 3 = 0 AS resolved FROM events WHERE event_type IN ('error', 'click'))")
DELIVERIES = (
    "deliveries AS (SELECT event_id AS delivery_id, event_id - event_id % 4 AS job_id, "
    "'m' || CAST(event_id - event_id % 4 AS VARCHAR) AS message_id, event_type IN ('error', 'click', 'view') AS failed, "
    "'error ' || CAST(event_id % 7 AS VARCHAR) AS error, ts AS delivered_at FROM events)")


def _responses() -> str:
    def item(line="1", severity='"high"', category='"logic"', issue='"found"', explanation=',"explanation":"why"'):
        return (f'{{"line":{line},"severity":{severity},"category":{category},"issue":{issue}'
                f'{explanation},"suggestion":"fix"}}')

    def body(*items):
        return '{"suggestions":[' + ",".join(items) + "]}"

    whens = {
        0: body(item(line="#"), item(severity='"low"')), 1: "```json\n" + body(item()) + "\n```",
        2: body(item(), item(explanation="")), 3: body(item(line="0")), 4: body(item(severity='"warning"')),
        5: body(item(category='"perf"')), 6: body(item(issue='""')), 7: "not json",
        8: body(item(explanation=',"explanation":null', line="2.5")), 9: body(item(), '"text"')}
    cases = " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in whens.items())
    providers = " ".join(f"WHEN {i} THEN {lit(p)}" for i, p in enumerate(PROVIDERS))
    return (f"responses AS (SELECT doc_id AS response_id, CASE doc_id % {len(PROVIDERS)} {providers} END AS provider, "
            f"replace(CASE doc_id % 10 {cases} END, '#', CAST(len(string_split(text, chr(10))) AS VARCHAR)) AS body "
            f"FROM documents)")


RESPONSES = _responses()
