from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codesift.operators import deadletters as DL, jobs as J
from codesift.operators.tables import insert_if_absent, newest, update_by_key

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns[:1])).collect()]


def test_update_writes_nulls(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, s string, n int")
    c = spark.createDataFrame([(1, None)], "id int, s string")
    assert rows(update_by_key(t, c, "id", ["s"])) == [(1, None, 5), (2, "b", 6)]
    assert rows(update_by_key(t, c, "id", ["s"], keep_null=False)) == [(1, "a", 5), (2, "b", 6)]


def test_insert_if_absent_is_idempotent(spark):
    new = spark.createDataFrame([("m1", 2, at(2)), ("m1", 1, at(1)), ("m2", 3, at(0))], "message_id string, id int, ts timestamp_ntz")
    empty = new.limit(0)
    first = insert_if_absent(empty, new, "message_id", ["ts", "id"])
    assert rows(first.select("message_id", "id")) == [("m1", 1), ("m2", 3)]
    assert insert_if_absent(first, new, "message_id", ["ts", "id"]).count() == 0


def test_newest_of_a_hot_key(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    assert newest(df, "k", ["v"]).filter("k = -1").first().v == 9999


def test_routing_of_deliveries(spark):
    d = [(1, "a", True, 1), (2, "a", True, 2), (3, "a", True, 3), (4, "a", False, 4),
         (5, "b", True, 1), (6, "b", False, 2), (7, "b", True, 3), (8, "c", False, 1)]
    df = spark.createDataFrame([(i, m, f, at(s)) for i, m, f, s in d],
                               "delivery_id long, message_id string, failed boolean, delivered_at timestamp_ntz")
    got = rows(J.route_deliveries(df).select("delivery_id", "attempt", "status"))
    assert got == [(1, 1, "retrying"), (2, 2, "retrying"), (3, 3, "dlq"), (4, None, "ignored"), (5, 1, "retrying"), (6, 2, "complete"),
                   (7, None, "ignored"), (8, 1, "complete")]


def test_repeated_changes_leave_one_row_per_job(spark):
    jobs = spark.createDataFrame([(i, "queued", 0, None, None, None, None, "m") for i in range(4)],
                                 "id int, status string, attempts int, last_error string, result string, completed_at timestamp_ntz, "
                                 "processing_time_ms int, dlq_message_id string")
    starts = spark.createDataFrame([(1, 1), (1, 2), (1, 1)], "id int, attempts int")
    assert rows(J.start(jobs, starts).select("id", "status", "attempts")) == [
        (0, "queued", 0), (1, "processing", 2), (2, "queued", 0), (3, "queued", 0)]
    fails = spark.createDataFrame([(2, 1, "a"), (2, 1, "b")], "id int, attempts int, last_error string")
    assert J.fail(jobs, fails).count() == 4
    ends = spark.createDataFrame([(3, "r1", at(1), 5, 1), (3, "r2", at(2), 6, 1), (3, "r2", at(2), 6, 1)],
                                 "id int, result string, completed_at timestamp_ntz, processing_time_ms int, attempts int")
    assert rows(J.finish(jobs, ends).select("id", "result"))[3] == (3, "r2")
    log = [(1, "start", at(1), 1, None, None, None), (1, "fail", at(2), 1, "boom", None, None), (1, "start", at(3), 2, None, None, None),
           (1, "finish", at(4), 2, None, "r", 9), (2, "fail", at(2), 1, "x", None, None), (2, "start", at(2), 1, None, None, None)]
    log = spark.createDataFrame(log + log, "id int, kind string, at timestamp_ntz, attempts int, last_error string, result string, processing_time_ms int")
    got = rows(J.changed(jobs, log).select("id", "status", "attempts", "last_error", "result", "processing_time_ms", "dlq_message_id"))
    assert got == [(0, "queued", 0, None, None, None, "m"), (1, "complete", 2, None, "r", 9, None),
                   (2, "retrying", 1, "x", None, None, "m"), (3, "queued", 0, None, None, None, "m")]


def test_pages_follow_each_other(spark):
    letters = spark.range(120).select(
        "id", (F.col("id") % 7).alias("job_id"), F.lit("m").alias("message_id"), F.lit(False).alias("resolved"),
        F.timestamp_seconds((F.col("id") % 10).cast("long")).cast("timestamp_ntz").alias("moved_to_dlq_at"))
    jobs = spark.range(7).select("id", F.lit("f").alias("file_name"), F.lit("dlq").alias("status"), F.lit(1).alias("attempts"))
    want = [(r.moved_to_dlq_at, r.id) for r in letters.orderBy(F.desc("moved_to_dlq_at"), "id").collect()]
    got, after = [], None
    while True:
        page = sorted(((r.moved_to_dlq_at, r.id) for r in DL.page(letters, jobs, limit=50, after=after).collect()),
                      key=lambda x: (-x[0].timestamp(), x[1]))
        if not page:
            break
        got += page
        after = page[-1]
    assert got == want


def test_a_life_of_a_message_ends_after_a_day(spark):
    day = 86_400
    d = [(1, "a", True, 0), (2, "a", True, day - 1), (3, "a", True, day), (4, "a", False, 2 * day - 1), (5, "a", True, 2 * day), (6, "b", True, 5 * day)]
    df = spark.createDataFrame([(i, m, f, at(s)) for i, m, f, s in d], "delivery_id long, message_id string, failed boolean, delivered_at timestamp_ntz")
    assert rows(J.route_deliveries(df).select("delivery_id", "attempt", "status")) == [
        (1, 1, "retrying"), (2, 2, "retrying"), (3, 1, "retrying"), (4, 2, "complete"), (5, 1, "retrying"), (6, 1, "retrying")]


def test_history_is_cut_before_the_shuffle(spark):
    jobs = spark.range(2000).select(
        "id", (F.col("id") % 2).alias("user_id"), F.lit("f").alias("file_name"), F.lit("complete").alias("status"), F.lit(False).alias("cache_hit"),
        F.lit(1).alias("processing_time_ms"), F.timestamp_seconds("id").alias("created_at"),
        F.lit('{"metrics":{"issuesFound":4}}').alias("result"))
    h = J.histories(jobs)
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert h.count() == 100 and h.agg(F.min("id")).first()[0] == 1900
    assert rows(J.user_history(jobs, 1, 2).select("id", "issues_found")) == [(1997, 4), (1999, 4)]


def test_dead_letter_life(spark):
    jobs = spark.createDataFrame([(1, "f1", "retrying", 2, "old", None, None), (2, "f2", "complete", 1, None, None, None)],
                                 "id long, file_name string, status string, attempts int, last_error string, dlq_message_id string, dlq_moved_at timestamp_ntz")
    schema = ("id long, job_id long, message_id string, message_body string, receive_count int, last_error string, moved_to_dlq_at timestamp_ntz")
    reports = spark.createDataFrame([(10, 1, "m1", "{}", 0, "first", at(1)), (11, 1, "m1", "{}", 4, "second", at(2)),
                                     (12, 9, "m2", "{}", None, "x", at(3))], schema)
    none = DL.capture(spark.createDataFrame([], schema.replace("id long,", "id long,", 1)), reports.limit(0))
    letters = DL.capture(none, reports)
    assert rows(letters.select("id", "receive_count", "last_error", "resolved")) == [(10, 1, "first", False), (12, 1, "x", False)]
    after = DL.mark_dead(jobs, reports)
    assert rows(after.select("id", "status", "last_error", "dlq_message_id")) == [(1, "dlq", "second", "m1"), (2, "complete", None, None)]
    asked = spark.createDataFrame([(10, at(5))], "id long, requested_at timestamp_ntz")
    assert rows(DL.retry(letters, asked).select("id", "retry_count", "resolved")) == [(10, 1, False), (12, 0, False)]
    assert rows(DL.retried_jobs(after, letters, asked).select("id", "status", "attempts", "last_error")) == [
        (1, "retrying", 0, None), (2, "complete", 1, None)]
    assert rows(DL.retry_messages(letters, asked)) == [(1, "{}")]
    full = letters.select("*", F.lit(None).cast("timestamp_ntz").alias("resolved_at"), F.lit(None).cast("string").alias("resolution_reason"))
    done = DL.resolve(full, spark.createDataFrame([(12, at(6), None)], "id long, resolved_at timestamp_ntz, reason string"))
    assert rows(done.select("id", "resolved", "resolution_reason")) == [(10, False, None), (12, True, "Manual resolution")]
    listed = DL.page(letters, jobs, limit=1)
    assert listed.columns[:2] == ["id", "job_id"] and listed.first().id == 12 and listed.first().status is None


def test_rollup_of_nothing(spark):
    none = spark.createDataFrame([], "status string, processing_time_ms int")
    assert tuple(J.rollup(none).first()) == (0, 0, 0, 0, 0, 0)


def test_overdue_and_visible_again(spark):
    log = spark.createDataFrame([(1, 1, "processing", at(0)), (2, 2, "processing", at(0)), (2, 3, "complete", at(10)),
                                 (3, 4, "processing", at(0)), (3, 5, "retrying", at(50)), (4, 6, "processing", at(100))],
                                "job_id int, event_id int, status string, ts timestamp_ntz")
    assert rows(J.stuck(log, 30).select("job_id")) == [(1,), (3,)]
    assert rows(J.visible_again(log, 30).select("job_id")) == [(1,), (3,), (4,)]
