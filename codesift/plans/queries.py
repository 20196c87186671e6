"""Registered queries: one entry per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import folds, text as T
from ..functions.expr import quoted
from ..functions.dialect import portable
from ..operators import corpus, deadletters as DL, jobs as J, report, responses as R, reuse as U, score as C
from ..operators import scan as S
from ..operators.tables import insert_if_absent, newest, update_by_key
from ..rules import BY_KEY, CATALOGUE, Rule, has
from ..rules import pattern as pt, semantic as sm
from ..session import scratch, store
from ..sources import derived as D, io
from ..sources.daytable import DayTable
from ..streaming import streams as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return add


def rule_name(key: str) -> str:
    return key.replace("-", "").lower() + "_" + BY_KEY[key].name.replace("/", "_").replace("-", "_")


def _rule_query(key: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return S.findings(S.scan(D.code_files(spark, sf), [key])).select("file_id", "line", "detail")
    return run


for _rule in CATALOGUE:
    QUERIES[rule_name(_rule.key)] = _rule_query(_rule.key)


def reviewed(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_issues(S.scan(D.code_files(spark, sf)))


def hashed(spark: SparkSession, sf: str) -> DataFrame:
    return U.with_hash(D.submissions(spark, sf))


def hashed_once(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Submissions without their texts, written: each file is hashed a single time, no text meets a shuffle."""
    of = U.with_hash(D.files(spark, sf)).select("file_id", "file_name", "code_hash", F.octet_length("content").alias("n_bytes"))
    return store(D.submissions(spark, sf, of).select("job_id", "code_hash", "created_at", *more), "hashed")


def labelled(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return U.label(hashed_once(spark, sf, "user_id", "n_bytes", *more))


def letters(spark: SparkSession, sf: str) -> DataFrame:
    """Dead letters with the columns that the basic view leaves out."""
    body = F.to_json(F.struct(F.col("job_id").cast("string").alias("jobId")))
    null = F.lit(None)
    return D.dlq_messages(spark, sf).select(
        "*", body.alias("message_body"), F.concat(F.lit("error "), (F.col("id") % 7).cast("string")).alias("last_error"),
        null.cast("timestamp_ntz").alias("last_retry_at"), null.cast("timestamp_ntz").alias("resolved_at"),
        null.cast("string").alias("resolution_reason"))


def job_log(spark: SparkSession, sf: str) -> DataFrame:
    """Job events: several events belong to one job."""
    status = F.element_at(F.create_map(*[F.lit(x) for kv in {
        "signup": "queued", "view": "processing", "purchase": "complete", "error": "retrying", "click": "dlq"}.items()
        for x in kv]), F.col("event_type"))
    return D.table(spark, sf, "events").select(
        (F.col("event_id") - F.col("event_id") % 4).alias("job_id"), "event_id", status.alias("status"), "ts")


# ---- sources and sinks -------------------------------------------------------
@query("s01_submissions_source")
def _(spark, sf):
    path = scratch(spark, "submissions")
    sent = D.submissions(spark, sf).withColumn("user_id", F.when(F.col("job_id") % 5 != 0, F.col("user_id")))
    io.write_submissions(sent, path)
    return io.read_submissions(spark, path).select("user_id", "file_name", F.sha2("content", 256).alias("code_hash"))


@query("s02_job_table")
def _(spark, sf):
    path = scratch(spark, "jobs")
    io.append_jobs(D.review_jobs(spark, sf), path)
    return io.read_jobs(spark, path).select("id", "status", "result", "created_at", "day")


def _messages(spark, sf):
    # each file is hashed once, before its submissions
    return D.submissions(spark, sf, U.with_hash(D.files(spark, sf))).select("job_id", "code_hash", "file_name", "content")


@query("s03_job_stream")
def _(spark, sf):
    path = scratch(spark, "queue")
    io.publish(_messages(spark, sf), path)
    read = io.read_messages(spark, path).select(
        "jobId", "codeHash", "fileName", F.length("fileContent").alias("n_chars"))
    return ST.to_table(read, "consumed")


@query("s04_dead_letter_stream")
def _(spark, sf):
    raw = io.stream_table(spark, sf, "events").filter(F.col("event_type").isin("error", "click"))
    return ST.to_table(raw.select("event_id", "event_type", "ts"), "letters")


@query("s05_publish")
def _(spark, sf):
    path = scratch(spark, "published")
    io.publish(_messages(spark, sf), path)
    got = spark.read.text(path)
    return got.select(*[F.get_json_object("value", f"$.{f}").alias(f) for f in ("jobId", "codeHash", "fileName")])


@query("s06_result_documents")
def _(spark, sf):
    path = scratch(spark, "results")
    io.write_results(C.with_result(reviewed(spark, sf)).select("file_id", "result"), path, "file_id")
    return spark.read.parquet(path).select(
        "file_id", "grade", "issues_found", "lines_analyzed",
        T.json_int(F.col("result"), "$.metrics.issuesFound").alias("in_document"))


@query("s07_cache_table")
def _(spark, sf):
    path = scratch(spark, "cache")
    entries = hashed(spark, sf).groupBy("code_hash").agg(F.max("created_at").alias("cached_at"))
    io.write_cache(entries.withColumn("result", F.to_json(F.struct("code_hash"))), path)
    return io.read_cache(spark, path).select("code_hash", "cached_at")


@query("s08_report_sink")
def _(spark, sf):
    path = scratch(spark, "reports")
    io.write_reports(report.reports(C.with_result(reviewed(spark, sf))), path)
    return spark.read.parquet(path).select("file_id", F.md5(F.col("report").cast("binary")).alias("digest"))


@query("s09_dead_letter_sink")
def _(spark, sf):
    raw = io.stream_table(spark, sf, "events").filter(F.col("event_type").isin("error", "click"))
    n = F.col("event_id")
    incoming = raw.select(n.alias("id"), F.concat(F.lit("m"), (n % 997).cast("string")).alias("message_id"),
                          F.col("ts").alias("moved_to_dlq_at"), "event_type")
    return ST.first_report(incoming).select("message_id", "id")


# ---- projections and filters -------------------------------------------------
@query("p_valid_submissions")
def _(spark, sf):
    n = F.col("job_id")
    sent = D.submissions(spark, sf).withColumn(
        "content", F.when(n % 7 == 0, None).when(n % 11 == 0, "").otherwise(F.col("content")))
    return io.checked(sent).select("job_id", "reject")


@query("p_status_view")
def _(spark, sf):
    return J.status(D.review_jobs(spark, sf))


@query("p_hist_view")
def _(spark, sf):
    return J.history(D.review_jobs(spark, sf))


@query("p_done_jobs")
def _(spark, sf):
    return J.reportable(D.review_jobs(spark, sf)).select("id", "file_name", "result")


@query("p_hit_result")
def _(spark, sf):
    doc = C.with_result(reviewed(spark, sf).withColumn("ms", F.col("file_id") % 5000), processing_ms="ms")
    again = doc.select("file_id", U.hit_result(F.col("result")).alias("r"))
    listed = F.array_join(F.transform("r.security", lambda i: F.concat(i["line"].cast("string"), F.lit(":"), i["rule"])), ";")
    return again.select("file_id", *[F.col(f"r.metrics.{f}").alias(f) for f in (
        "reviewTime", "processingTimeMs", "originalReviewTime", "originalProcessingTimeMs", "linesAnalyzed", "issuesFound")],
        "r.qualityScore", listed.alias("security"))


@query("p_res_flag")
def _(spark, sf):
    both = [DL.by_resolved(D.dlq_messages(spark, sf), flag) for flag in (False, True)]
    return both[0].union(both[1]).select("id", "message_id", "resolved")


@query("p_ai_eligible")
def _(spark, sf):
    return R.eligible(D.code_files(spark, sf)).select("file_id", "n_lines")


@query("p_sev_issues")
def _(spark, sf):
    r = reviewed(spark, sf).select("file_id", F.explode_outer(C.severe(F.col("issues"))).alias("i"))
    return r.filter("i IS NOT NULL").select("file_id", "i.rule", "i.line", "i.severity", "i.bucket")


@query("p_prompt_table")
def _(spark, sf):
    return R.prompts(D.code_files(spark, sf)).select(
        "file_id", "language", "n_lines", F.md5(F.col("prompt").cast("binary")).alias("digest"))


def _gate_query(column: str) -> Query:
    return lambda spark, sf: S.prepare(D.code_files(spark, sf), in_loop=False).select(
        "file_id", F.col(column).alias("open"))


for _name, _column in (("async", "_async"), ("auth", "_auth"), ("rate", "_rate")):
    QUERIES[f"p_gate_{_name}"] = _gate_query(_column)


@query("p_gate_lang")
def _(spark, sf):
    lang = T.detect_language(F.col("file_name"), F.col("content"))
    return D.code_files(spark, sf).select("file_id", (lang == "java").alias("java"), (lang == "python").alias("python"))


# ---- joins -------------------------------------------------------------------
@query("j01_dead_letter_list")
def _(spark, sf):
    both = [DL.listing(letters(spark, sf), D.review_jobs(spark, sf), flag) for flag in (False, True)]
    return both[0].union(both[1]).drop("message_body")


@query("j02_dead_letter_detail")
def _(spark, sf):
    jobs = D.review_jobs(spark, sf).withColumn("file_content", F.concat("file_name", F.lit(" text")))
    return DL.detail(letters(spark, sf), jobs).drop("message_body")


@query("j03_cache_lookup")
def _(spark, sf):
    h = hashed_once(spark, sf)
    cache = h.filter(F.col("job_id") % 3 == 0).select("code_hash", F.col("created_at").alias("cached_at"))
    return U.live_entry(h, cache).select("job_id", "cached_at")


@query("j04_review_once_per_hash")
def _(spark, sf):
    files = D.code_files(spark, sf)
    of = U.with_hash(files).select("file_id", "code_hash")
    h = store(D.submissions(spark, sf, of).select("job_id", "file_id", "code_hash", "created_at"), "hashed")
    first = h.groupBy("code_hash").agg(F.min(F.struct("created_at", "job_id", "file_id")).alias("f")).select("code_hash", "f.file_id")
    # texts of the chosen files only; the hash was computed above
    once = files.join(first, "file_id")
    results = store(C.scored(C.with_issues(S.scan(once))).select(
        "code_hash", F.col("file_name").alias("result_name"), "score", "grade"), "results")
    return h.select("job_id", "code_hash").join(results, "code_hash").select("job_id", "result_name", "score", "grade")


@query("j05_insert_if_absent")
def _(spark, sf):
    d = D.dlq_messages(spark, sf)
    known = d.filter("resolved").select("message_id").distinct()
    return insert_if_absent(known, d, "message_id", ["moved_to_dlq_at", "id"]).select("message_id", "id")


@query("j06_update_by_key")
def _(spark, sf):
    jobs = D.review_jobs(spark, sf)
    changes = D.dlq_messages(spark, sf).select("id", F.lit("dlq").alias("status"), F.col("receive_count").alias("attempts"))
    changes = changes.union(changes.withColumn("attempts", F.col("attempts") - 1))  # delivered twice
    return update_by_key(jobs, changes, "id", ["attempts"]).select("id", "status", "attempts")


QUERIES["j07_forward_search"] = QUERIES[rule_name("AY-06")]


@query("j08_rule_catalogue")
def _(spark, sf):
    found = C.issues_long(S.findings(S.scan(D.code_files(spark, sf))))
    return found.select("file_id", "line", "rule", "severity", "bucket", "penalty", "suggestion")


@query("j09_files_with_severe_issues")
def _(spark, sf):
    # written first: a filter on the count would otherwise run the scan a second time
    r = store(reviewed(spark, sf).select("file_id", "n_lines", F.size(C.severe(F.col("issues"))).alias("n_severe")), "severe")
    return r.filter(F.col("n_lines").between(R.MIN_LINES, R.MAX_LINES)).filter("n_severe > 0")


# ---- aggregates --------------------------------------------------------------
@query("a01_job_rollup")
def _(spark, sf):
    return J.rollup(D.jobs(spark, sf))


@query("a02_dead_letter_stats")
def _(spark, sf):
    return DL.statistics(D.dlq_messages(spark, sf)).withColumn("avg_retries", F.round("avg_retries", 6))


@query("a03_cache_stats")
def _(spark, sf):
    return U.statistics(labelled(spark, sf))


@query("a04_issue_counts")
def _(spark, sf):
    return C.scored(reviewed(spark, sf)).select("file_id", "n_security", "n_performance", "n_style", "n_issues")


@query("a05_quality_score")
def _(spark, sf):
    return C.scored(reviewed(spark, sf)).select("file_id", "score")


@query("a06_letter_grade")
def _(spark, sf):
    return C.scored(reviewed(spark, sf)).select("file_id", "grade")


@query("a07_bucket_arrays")
def _(spark, sf):
    def listed(bucket):
        return F.array_join(F.transform(C.in_bucket(F.col("issues"), bucket), lambda i: F.concat(
            i["line"].cast("string"), F.lit(":"), i["rule"])), ";").alias(bucket)
    return reviewed(spark, sf).select("file_id", *[listed(b) for b in C.BUCKETS])


@query("a08_lines_analysed")
def _(spark, sf):
    return D.code_files(spark, sf).select("file_id", T.line_count(F.col("content")).alias("n_lines"))


@query("a09_state_variables")
def _(spark, sf):
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(portable(sm.STATE_FIELD)), F.lit(1)))
    return D.code_files(spark, sf).select("file_id", names.alias("names")).select(
        "file_id", F.size("names").alias("n"), F.array_join(F.slice("names", 1, 3), ", ").alias("first_three"))


@query("a10_greedy_ttl")
def _(spark, sf):
    return labelled(spark, sf).select("job_id", "hit")


def with_completion(submissions: DataFrame) -> DataFrame:
    """Jobs take up to two and a half hours; every seventeenth never ends."""
    took = F.make_dt_interval(secs=F.col("job_id") * 37 % 9001)
    return submissions.withColumn("completed_at", F.when(F.col("job_id") % 17 != 0, F.col("created_at") + took))


@query("a10_reuse_from_completion")
def _(spark, sf):
    return U.label(with_completion(hashed_once(spark, sf))).select("job_id", "hit")


@query("a11_match_counts")
def _(spark, sf):
    def n(p):
        return F.regexp_count("content", F.lit(portable(p)))
    return D.code_files(spark, sf).select(
        "file_id", n(sm.NESTED_ARROWS).alias("nested"), n(r"=>").alias("arrows"), n(r"\w+\s*=\s*true").alias("set_true"))


@query("a12_first_matching_line")
def _(spark, sf):
    rows = S.prepare(D.code_files(spark, sf), in_loop=False)
    return rows.select("file_id", F.expr(
        f"coalesce(get(filter(_rows, r -> r.s RLIKE {quoted(portable(r'(?:^|\W)function|=>'))}), 0).n, 0)").alias("line"))


# ---- frames and folds ---------------------------------------------------------
# frame of each context rule: first and last line relative to the line itself
FRAMES = {
    "w01_frame_before_10": (-10, -1), "w02_frame_before_5": (-5, 0), "w04_frame_ahead_9": (0, 9),
    "w05_frame_around_5": (-5, 4), "w06_frame_ahead_2": (0, 2), "w07_next_line": (1, 1),
    "w08_frame_around_10": (-10, 9), "w09_frame_ahead_19": (0, 19), "w10_frame_ahead_14": (0, 14),
}


def _frame_query(first: int, last: int) -> Query:
    def run(spark, sf):
        rows = S.prepare(D.code_files(spark, sf), in_loop=False)
        framed = rows.select("file_id", F.explode(F.expr(
            f"transform(_rows, r -> named_struct('line', r.n, 'f', {S.frame('r.n', first, last)}))")).alias("x"))
        return framed.select("file_id", "x.line", F.length("x.f").alias("n_chars"),
                             F.md5(F.col("x.f").cast("binary")).alias("digest"))
    return run


for _name, (_first, _last) in FRAMES.items():
    QUERIES[_name] = _frame_query(_first, _last)


@query("w03_rest_of_file")
def _(spark, sf):
    rows = S.prepare(D.code_files(spark, sf), in_loop=False)
    # the lengths come from one running sum, the window from the next lines: linear in the file
    ahead = "substring(array_join(transform(slice(_lines, r.n, 500), s -> substring(s, 1, 500)), '\\n'), 1, 500)"
    x = rows.selectExpr("file_id", "content", "_rows", "_lines", f"{folds.offsets('_rows')} AS starts").select(
        "file_id", F.explode(F.expr(
            f"transform(_rows, r -> named_struct('line', r.n, 'n_chars', length(content) - get(starts, r.n - 1), 'ahead', {ahead}))")).alias("x"))
    return x.select("file_id", "x.line", "x.n_chars", F.md5(F.col("x.ahead").cast("binary")).alias("digest"))


@query("w11_loop_depth")
def _(spark, sf):
    rows = S.prepare(D.code_files(spark, sf), in_loop=False)
    return rows.select("file_id", F.posexplode(F.expr(folds.loop_depths("_rows"))).alias("p", "depth")).select(
        "file_id", (F.col("p") + 1).alias("line"), "depth")


@query("w12_function_depth")
def _(spark, sf):
    rows = S.prepare(D.code_files(spark, sf), in_loop=False)
    return rows.select("file_id", F.posexplode(F.expr(folds.function_depths("_rows"))).alias("p", "depth")).select(
        "file_id", (F.col("p") + 1).alias("line"), "depth")


@query("w12_global_state")
def _(spark, sf):
    rows = S.prepare(D.code_files(spark, sf), in_loop=False)
    return rows.select("file_id", F.expr(folds.global_state("_rows")).alias("g")).select(
        "file_id", "g.line", F.array_join("g.names", ",").alias("names"), "g.depth")


@query("w13_gap_suppression")
def _(spark, sf):
    rows = S.prepare(D.code_files(spark, sf), in_loop=False)
    return rows.select("file_id", F.explode(F.expr(folds.spaced_out("transform(_rows, r -> r.n)", pt.VALIDATION_GAP))).alias("line"))


@query("w14_latest_state")
def _(spark, sf):
    return J.latest_state(job_log(spark, sf))


# ---- order and limits ----------------------------------------------------------
@query("o01_user_histories")
def _(spark, sf):
    return J.histories(D.review_jobs(spark, sf))


@query("o02_dead_letter_page")
def _(spark, sf):
    first = DL.by_resolved(letters(spark, sf), False).orderBy(F.desc("moved_to_dlq_at"), "id").limit(50)
    last = first.agg(F.min_by(F.struct("moved_to_dlq_at", "id"), F.struct("moved_to_dlq_at", -F.col("id"))).alias("r")).first()["r"]
    return DL.page(letters(spark, sf), D.review_jobs(spark, sf), limit=50, after=tuple(last) if last else None).select(
        "id", "job_id", "status")


@query("o03_dead_letter_order")
def _(spark, sf):
    both = [DL.listing(letters(spark, sf), D.review_jobs(spark, sf), flag) for flag in (False, True)]
    return both[0].union(both[1]).select("id", "moved_to_dlq_at", "status", "resolved").orderBy(F.desc("moved_to_dlq_at"), "id")


@query("o04_first_three_names")
def _(spark, sf):
    return QUERIES["a09_state_variables"](spark, sf).select("file_id", "first_three")


@query("o05_emission_order")
def _(spark, sf):
    found = S.findings(S.scan(D.code_files(spark, sf)))
    return found.select("file_id", (F.col("position") + 1).alias("position"), "key", "line")


# ---- set operations -------------------------------------------------------------
@query("u01_all_detectors")
def _(spark, sf):
    return S.findings(S.scan(D.code_files(spark, sf))).select("file_id", "key", "line", "detail")


@query("u02_security_and_performance")
def _(spark, sf):
    both = F.concat(C.in_bucket(F.col("issues"), "security"), C.in_bucket(F.col("issues"), "performance"))
    return reviewed(spark, sf).select("file_id", F.size(both).alias("n"), F.aggregate(
        both, F.lit(0.0), lambda a, i: a + i["penalty"]).alias("penalty"))


@query("u03_distinct_words")
def _(spark, sf):
    words = F.regexp_extract_all("content", F.lit(r"\w+"), F.lit(0))
    return D.code_files(spark, sf).select("file_id", F.size(words).alias("n_words"),
                                          F.size(F.array_distinct(words)).alias("n_distinct"))


# ---- scalar functions: one query per function, over all files or jobs -------------
def _on_files(*columns) -> Query:
    return lambda spark, sf: D.code_files(spark, sf).select("file_id", *[c() for c in columns])


_text, _name_col = (lambda: F.col("content")), (lambda: F.col("file_name"))
QUERIES["f01_sha256"] = _on_files(lambda: T.content_hash(_text()).alias("code_hash"))
QUERIES["f03_split_lines"] = lambda spark, sf: D.code_files(spark, sf).select(
    "file_id", F.posexplode(T.split_lines(F.col("content"))).alias("p", "line")).select(
    "file_id", (F.col("p") + 1).alias("line_no"), "line")
QUERIES["f04_extension"] = _on_files(lambda: T.file_extension(_name_col()).alias("ext"))
QUERIES["f05_language"] = _on_files(lambda: T.detect_language(_name_col(), _text()).alias("language"))
QUERIES["f06_prompt_language"] = _on_files(lambda: T.prompt_language(_name_col()).alias("language"))
QUERIES["f07_regex_test"] = _on_files(lambda: _text().rlike(portable(r"(?:^|\W)const\s+\w+\s*=")).alias("found"))
QUERIES["f08_dynamic_regex"] = _on_files(lambda: F.regexp_like(_text(), F.concat(
    F.lit(r"\W"), F.regexp_extract("content", r"^(\w+)", 1), F.lit(r"\W"))).alias("again"))
QUERIES["f09_capture_group"] = _on_files(
    lambda: F.regexp_extract("content", portable(r"(?:const|let|var)\s+(\w+)"), 1).alias("name"))
QUERIES["f10_all_matches"] = _on_files(lambda: F.array_join(F.regexp_extract_all(
    "content", F.lit(portable(r"(\w+)\s*\(")), F.lit(1)), ",").alias("calls"))
QUERIES["f11_match_line"] = lambda spark, sf: D.code_files(spark, sf).select("file_id", F.expr(
    f"if(content RLIKE {quoted(portable(r'=\s*\S'))}, {S.M.line_of_first('content', portable(r'=\s*\S'))}, 0)").alias("line"))
QUERIES["f12_look_ahead"] = lambda spark, sf: D.code_files(spark, sf).select("file_id", F.md5(F.array_join(F.expr(
    S.M.text_after(S.M.mark_matches(S.M.clean("content"), portable(r"\w+\(")), 200)), "|").cast("binary")).alias("digest"))
QUERIES["f13_after_await"] = _on_files(lambda: F.regexp_extract("content", portable(sm.AFTER_AWAIT), 1).alias("after"))
QUERIES["f14_brace_count"] = _on_files(lambda: T.count_of(_text(), "{").alias("opens"), lambda: T.count_of(_text(), "}").alias("closes"))
QUERIES["f15_text_case"] = _on_files(
    lambda: F.md5(F.lower(_text()).cast("binary")).alias("low"), lambda: F.upper(_name_col()).alias("up"),
    lambda: F.length(T.trim_all(_text())).alias("trimmed"))
QUERIES["f16_parse_int"] = lambda spark, sf: D.code_files(spark, sf).select("file_id", F.posexplode(F.regexp_extract_all(
    "content", F.lit(r"[0-9A-Za-z]*[0-9][0-9A-Za-z]*"), F.lit(0))).alias("k", "word")).select(
    "file_id", "k", T.parse_int(F.col("word"), 50).alias("value"))
QUERIES["f17_number_format"] = _on_files(
    lambda: T.seconds_text(F.col("file_id") * 10).alias("seconds"), lambda: T.percent_text(F.col("file_id") / 4).alias("percent"))
QUERIES["f18_round_half_up"] = _on_files(lambda: T.round_half_up(F.col("file_id") / 2).alias("rounded"))
QUERIES["f21_strip_fences"] = lambda spark, sf: D.responses(spark, sf).select(
    "response_id", T.strip_fences(F.col("body")).alias("text"))
QUERIES["f22_array_helpers"] = lambda spark, sf: D.code_files(spark, sf).select("file_id", T.split_lines(F.col("content")).alias("l")).select(
    "file_id", F.size(F.filter("l", lambda s: s.contains("("))).alias("calls"), F.exists("l", lambda s: s == "}").alias("closes"),
    F.array_join(F.transform(F.slice("l", -2, 2), F.length), ",").alias("tail_lengths"))
QUERIES["f25_message_text"] = lambda spark, sf: C.issues_long(S.findings(S.scan(
    D.code_files(spark, sf), [r.key for r in CATALOGUE if "{}" in r.message]))).select("file_id", "line", "message")


@query("f02_random_id")
def _(spark, sf):
    ids = D.jobs(spark, sf).select(F.expr("uuid()").alias("u"))
    form = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return ids.agg(F.count(F.lit(1)).alias("n_jobs"), F.count_distinct("u").alias("n_distinct"),
                   F.count_if(F.col("u").rlike(form)).alias("n_version_4"))


@query("f19_json")
def _(spark, sf):
    jobs = D.review_jobs(spark, sf).filter("result IS NOT NULL")
    parsed = F.from_json("result", "fileName string, metrics struct<issuesFound:int>")
    return jobs.select("id", parsed.alias("p")).select(
        "id", "p.fileName", F.col("p.metrics.issuesFound").alias("n"), F.to_json("p").alias("again"))


@query("f20_report_text")
def _(spark, sf):
    r = C.with_result(reviewed(spark, sf))
    return report.reports(r).select("file_id", "report")


@query("f23_struct_update")
def _(spark, sf):
    j = D.jobs(spark, sf).select("id", F.struct("status", "attempts").alias("s"))
    return j.select("id", F.col("s").withField("attempts", F.lit(0)).withField("seen", F.lit(True)).alias("s")).select("id", "s.*")


@query("f24_time")
def _(spark, sf):
    ts = F.col("created_at")
    return D.jobs(spark, sf).select("id", F.timestamp_add("SECOND", F.lit(3600), ts).alias("expires"), F.to_date(ts).alias("day"))


# ---- responses ------------------------------------------------------------------
def _enveloped(spark, sf):
    raw = D.responses(spark, sf)
    return raw.select("response_id", "provider", R.wrap(F.col("provider"), F.col("body")).alias("body"))


def _docs(spark, sf):
    return R.parsed(R.response_text(_enveloped(spark, sf)))


@query("r01_response_text")
def _(spark, sf):
    return R.response_text(_enveloped(spark, sf)).select("response_id", "text")


@query("r02_parse")
def _(spark, sf):
    return _docs(spark, sf).select("response_id", F.col("doc").isNotNull().alias("is_json"))


@query("r03_envelope")
def _(spark, sf):
    return _docs(spark, sf).select("response_id", "reject")


@query("r04_suggestion_checks")
def _(spark, sf):
    return R.items(_docs(spark, sf), "response_id").select("response_id", "i", "reason")


@query("r05_valid_suggestions")
def _(spark, sf):
    return R.valid(R.items(_docs(spark, sf), "response_id"), "response_id")


@query("r05_errors")
def _(spark, sf):
    return R.errors(R.items(_docs(spark, sf), "response_id"), "response_id")


# ---- streams ----------------------------------------------------------------------
def _stream_files(spark, sf):
    # a batch of a stream holds few files: deal their rows out to all cores
    doc = io.stream_table(spark, sf, "documents").select("doc_id", "text")
    return D.with_snippet(doc.repartition(spark.sparkContext.defaultParallelism, "doc_id"), D.ALL)


@query("t01_review_stream")
def _(spark, sf):
    return ST.to_table(ST.review(_stream_files(spark, sf)), "reviews")


def _stream_events(spark, sf):
    return io.stream_table(spark, sf, "events")


@query("t02_idempotent_capture")
def _(spark, sf):
    kept = ST.first_report(D.dlq_of(_stream_events(spark, sf)))
    return kept.select("message_id", "id", "job_id", "receive_count")


@query("t03_retry_routing_state")
def _(spark, sf):
    return ST.route_in_time(D.deliveries_of(_stream_events(spark, sf)))


@query("t03_retry_routing")
def _(spark, sf):
    return ST.route_by_batch(D.deliveries_of(_stream_events(spark, sf)))


@query("t03_retry_routing_batch")
def _(spark, sf):
    return J.route_deliveries(D.deliveries(spark, sf)).select(*J.ROUTED)


@query("t04_latest_status")
def _(spark, sf):
    n = F.col("event_id")
    log = _stream_events(spark, sf).select((n - n % 4).alias("job_id"), "event_id", F.col("event_type").alias("status"), "ts")
    return ST.latest_status(log).select("job_id", "status", "ts")


@query("t05_reuse_stream")
def _(spark, sf):
    n = D.table(spark, sf, "documents").count()
    f = D.files(spark, sf).select("file_id", T.content_hash(F.col("content")).alias("code_hash"))
    e = _stream_events(spark, sf).select(
        F.col("event_id").alias("job_id"), (F.col("event_id") % n).alias("file_id"), F.col("ts").alias("created_at"))
    return ST.reuse_labels(e.join(f, "file_id").select("job_id", "code_hash", "created_at")).select("job_id", "hit")


@query("t05_reuse_from_completion")
def _(spark, sf):
    n = D.table(spark, sf, "documents").count()
    f = D.files(spark, sf).select("file_id", T.content_hash(F.col("content")).alias("code_hash"))
    e = _stream_events(spark, sf).select(
        F.col("event_id").alias("job_id"), (F.col("event_id") % n).alias("file_id"), F.col("ts").alias("created_at"))
    return ST.reuse_from_completion(with_completion(e.join(f, "file_id"))).select("job_id", "hit")


@query("t06_possible_hits")
def _(spark, sf):
    n = D.table(spark, sf, "documents").count()
    f = D.files(spark, sf).select("file_id", T.content_hash(F.col("content")).alias("code_hash"))

    def side(ts):
        e = _stream_events(spark, sf).select(
            F.col("event_id").alias("job_id"), (F.col("event_id") % n).alias("file_id"),
            F.col("ts").cast("timestamp").alias(ts), "event_type")
        return e.join(f, "file_id")
    done = side("completed_at").filter(F.col("event_type") == "purchase").select("code_hash", "completed_at")
    return ST.possible_hits_by_batch(side("created_at"), done)[0].select("job_id", "code_hash")


@query("t02_job_half")
def _(spark, sf):
    raw = _stream_events(spark, sf)
    e = D.dlq_of(raw).withColumn("last_error", F.concat(F.lit("error "), (F.col("id") % 7).cast("string")))
    return ST.dead_jobs(e).select("job_id", "message_id", "last_error", "moved_to_dlq_at")


@query("t07_retention_stream")
def _(spark, sf):
    kept, counts = ST.retention(D.dlq_of(_stream_events(spark, sf)), 14)
    n = kept.agg(F.count(F.lit(1)).alias("kept"))
    return n.crossJoin(counts.agg(F.sum("dropped").alias("dropped")))  # one row each


def _deadline_log(spark, sf):
    status = F.element_at(F.create_map(*[F.lit(x) for kv in {
        "signup": "queued", "view": "processing", "purchase": "complete", "error": "retrying", "click": "dlq"}.items()
        for x in kv]), F.col("event_type"))
    n = F.col("event_id")
    return _stream_events(spark, sf).select((n - n % 4).alias("job_id"), "event_id", status.alias("status"), "ts")


@query("t08_deadline_stream")
def _(spark, sf):
    missed, _ = ST.missed_deadlines(_deadline_log(spark, sf), J.VISIBILITY_SECONDS)
    return missed.select("job_id", "event_id", "status", "outcome")


@query("t09_overdue_stream")
def _(spark, sf):
    # overdue now: not final for longer than the limit
    missed, _ = ST.missed_deadlines(_deadline_log(spark, sf), J.OVERDUE_SECONDS)
    return missed.filter("outcome = 'open'").select("job_id", "status", "ts")


@query("t07_retention")
def _(spark, sf):
    d = DL.retained(D.dlq_messages(spark, sf), "moved_to_dlq_at", 14)
    return d.groupBy("expired").agg(F.count(F.lit(1)).alias("n"))


@query("t08_visible_again")
def _(spark, sf):
    return J.visible_again(job_log(spark, sf))


@query("t09_overdue")
def _(spark, sf):
    return J.stuck(job_log(spark, sf), J.OVERDUE_SECONDS).select("job_id", "status", "ts")


@query("t10_dashboard")
def _(spark, sf):
    return ST.dashboard(D.jobs_of(_stream_events(spark, sf)), J.rollup, "dashboard")


@query("t10_dead_letter_dashboard")
def _(spark, sf):
    return ST.letter_dashboard(D.dlq_of(_stream_events(spark, sf))).withColumn("avg_retries", F.round("avg_retries", 6))


# ---- table changes -------------------------------------------------------------------
def _of_status(spark, sf, status):
    return D.review_jobs(spark, sf).filter(F.col("status") == status)


def _twice(changes: DataFrame) -> DataFrame:
    """Delivery is at least once: every change comes again."""
    return changes.union(changes)


SHOWN = ["id", "status", "attempts", "last_error", "processing_time_ms", "dlq_message_id"]


@query("m01_start")
def _(spark, sf):
    starts = _twice(_of_status(spark, sf, "queued").select("id", F.lit(1).alias("attempts")))
    return J.start(D.review_jobs(spark, sf), starts).select(*SHOWN)


@query("m02_finish")
def _(spark, sf):
    ends = _of_status(spark, sf, "dlq").select("id", F.lit("{}").alias("result"), F.col("created_at").alias("completed_at"),
                                               F.lit(7).alias("processing_time_ms"), F.lit(2).alias("attempts"))
    return J.finish(D.review_jobs(spark, sf), _twice(ends)).select(*SHOWN, "result", "completed_at")


@query("m03_capture")
def _(spark, sf):
    return DL.mark_dead(D.review_jobs(spark, sf), letters(spark, sf)).select(*SHOWN, "dlq_moved_at")


@query("m03_dead_letters")
def _(spark, sf):
    new = letters(spark, sf)
    return DL.capture(new.filter("resolved"), new.filter("NOT resolved")).select("message_id", "id", "receive_count")


def _requests(spark, sf):
    return D.dlq_messages(spark, sf).filter("NOT resolved").select("id", F.col("moved_to_dlq_at").alias("requested_at"))


@query("m04_retry")
def _(spark, sf):
    return DL.retry(letters(spark, sf), _requests(spark, sf)).select("id", "retry_count", "last_retry_at", "resolved")


@query("m04_retried_jobs")
def _(spark, sf):
    return DL.retried_jobs(D.review_jobs(spark, sf), letters(spark, sf), _requests(spark, sf)).select(*SHOWN)


@query("m04_retry_messages")
def _(spark, sf):
    return DL.retry_messages(letters(spark, sf), _requests(spark, sf))


@query("m05_resolve")
def _(spark, sf):
    req = D.dlq_messages(spark, sf).filter(F.col("retry_count") > 1).select(
        "id", F.col("moved_to_dlq_at").alias("resolved_at"), F.when(F.col("id") % 2 == 0, F.lit("fixed")).alias("reason"))
    return DL.resolve(letters(spark, sf), req).select("id", "resolved", "resolved_at", "resolution_reason")


@query("m06_hit_insert")
def _(spark, sf):
    sent = labelled(spark, sf, "file_id", "file_name").filter("hit")
    # the earlier result: the review of one file of each content
    files = newest(U.with_hash(D.files(spark, sf)), "code_hash", ["file_id"])
    found = C.with_result(C.with_issues(S.scan(files)).withColumn("ms", F.col("file_id") % 5000), processing_ms="ms")
    found = found.select("code_hash", "file_id", F.to_json(U.hit_result(F.col("result"))).alias("result"))
    earlier = found.drop("file_id")
    hits = sent.join(earlier, "code_hash").select(
        (-1 - F.col("job_id")).alias("id"), "user_id", "file_name", "code_hash", "result", "created_at")
    return J.insert_hits(D.review_jobs(spark, sf), hits).select(
        "id", "user_id", "file_name", "code_hash", "status", "cache_hit", "processing_time_ms", "completed_at",
        *[F.get_json_object("result", f"$.{f}").alias(n) for f, n in (
            ("fileName", "result_file"), ("metrics.reviewTime", "review_time"), ("metrics.originalProcessingTimeMs", "original_ms"),
            ("qualityScore", "grade"), ("security[0].rule", "first_security_rule"))],
        F.get_json_object("result", "$.metrics.issuesFound").cast("int").alias("issues_found"))


@query("m07_failed_attempt")
def _(spark, sf):
    f = _of_status(spark, sf, "processing").select("id", F.lit(2).alias("attempts"), F.lit("boom").alias("last_error"))
    return J.fail(D.review_jobs(spark, sf), _twice(f)).select(*SHOWN)


def _change_log(spark, sf):
    e = D.table(spark, sf, "events")
    kind = F.element_at(F.array(F.lit("start"), F.lit("fail"), F.lit("finish")), (F.col("event_id") % 3 + 1).cast("int"))
    log = e.select((F.col("event_id") - F.col("event_id") % 4).alias("id"), kind.alias("kind"), F.col("ts").alias("at"),
                   (F.col("event_id") % 5).cast("int").alias("attempts"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("last_error"),
                   F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("result"), (F.col("event_id") % 900).cast("int").alias("processing_time_ms"))
    return _twice(log)


@query("m07_mixed_changes")
def _(spark, sf):
    return J.changed(D.review_jobs(spark, sf), _change_log(spark, sf)).select(*SHOWN, "result", "completed_at")


@query("m07_committed_changes")
def _(spark, sf):
    # the same through a table by day: committed, and the same batch delivered again
    jobs = D.review_jobs(spark, sf)
    jobs_table = DayTable(spark, scratch(spark, "job-table"), jobs.schema, "id")
    jobs_table.append(jobs)
    for batch in (0, 0, 1):
        jobs_table.update(_change_log(spark, sf), J.changed, ("worker", batch))
    return jobs_table.read().select(*SHOWN, "result", "completed_at")


# ---- user surface ----------------------------------------------------------------------
@query("x01_review")
def _(spark, sf):
    return C.scored(reviewed(spark, sf)).select("file_id", "language", "n_lines", "n_issues", "score", "grade")


@query("x02_detector_table")
def _(spark, sf):
    return S.findings(S.scan(D.code_files(spark, sf))).select("file_id", F.substring("key", 1, 2).alias("detector"), "key", "line")


USER_RULE = Rule("XX-01", "user/todo-marker", "low", "style", None, "A marker is left.", "Finish it.", line=(has(r"(?:^|\W)[Hh]andle(?:\W|$)"),))


@query("x03_user_rule")
def _(spark, sf):
    found = S.findings(S.scan(D.code_files(spark, sf), [], extra=[USER_RULE]))
    return C.issues_long(found, [USER_RULE]).select("file_id", "line", "rule", "severity")


# ---- corpus views ------------------------------------------------------------------------
def _scored(spark, sf):
    """Scores of all files, written once: what follows aggregates and ranks them."""
    return store(C.scored(reviewed(spark, sf)).select("file_id", "language", "score", "grade"), "scored")


@query("c01_rule_frequency")
def _(spark, sf):
    files = D.code_files(spark, sf)
    return corpus.rule_frequency(S.findings(S.scan(files)), files.agg(F.count("*").alias("n")))


@query("c02_grades_by_language")
def _(spark, sf):
    return corpus.grades_by_language(_scored(spark, sf))


@query("c03_worst_files")
def _(spark, sf):
    return corpus.worst_files(_scored(spark, sf), "language", 10)


@query("c04_reuse_per_day")
def _(spark, sf):
    return U.per_day(labelled(spark, sf))


@query("c04_reuse_from_completion")
def _(spark, sf):
    return U.per_day(U.label(with_completion(hashed_once(spark, sf, "user_id", "n_bytes"))))


__all__ = ["QUERIES", "rule_name"]
