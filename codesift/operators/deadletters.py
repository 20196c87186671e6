"""Dead-letter table: capture, lists, statistics, retry and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from .tables import insert_if_absent, newest, update_by_key

# fixed values: defaults of the service
PAGE_SIZE = 50
RESOLUTION = "Manual resolution"
LIST_COLUMNS = ["id", "job_id", "message_id", "message_body", "receive_count", "last_error", "moved_to_dlq_at",
                "retry_count", "last_retry_at", "resolved"]
DETAIL_COLUMNS = LIST_COLUMNS + ["resolved_at", "resolution_reason"]
JOB_COLUMNS = ["file_name", "status", "attempts"]


def _joined(letters: DataFrame, jobs: DataFrame, columns: list[str], extra: dict) -> DataFrame:
    j = jobs.select(F.col("id").alias("_job"), *JOB_COLUMNS, *[F.col(c).alias(n) for c, n in extra.items()])
    have = [c for c in columns if c in letters.columns]
    return letters.join(j, F.col("job_id") == F.col("_job"), "left").select(*have, *JOB_COLUMNS, *extra.values())


def listing(letters: DataFrame, jobs: DataFrame, resolved: bool = False) -> DataFrame:
    """Dead letters with the state of their job; the file text is never read."""
    return _joined(by_resolved(letters, resolved), jobs, LIST_COLUMNS, {})


def page(letters: DataFrame, jobs: DataFrame, resolved: bool = False, limit: int = PAGE_SIZE, after: tuple | None = None) -> DataFrame:
    """One page of the list, newest first; only the rows of the page are joined.

    ``after`` is (moved_to_dlq_at, id) of the last row of the page before, so a deep page costs what the first one
    does: no rows are counted off.
    """
    rows = by_resolved(letters, resolved)
    if after is not None:
        at, number = F.lit(after[0]), F.lit(after[1])
        moved = F.col("moved_to_dlq_at")
        rows = rows.filter((moved < at) | ((moved == at) & (F.col("id") > number)))
    return _joined(rows.orderBy(F.desc("moved_to_dlq_at"), "id").limit(limit), jobs, LIST_COLUMNS, {})


def detail(letters: DataFrame, jobs: DataFrame, letter_id=None) -> DataFrame:
    """Dead letters with file text, resolution and the job's own error."""
    picked = letters if letter_id is None else letters.filter(F.col("id") == letter_id)
    return _joined(picked, jobs, DETAIL_COLUMNS, {"file_content": "file_content", "last_error": "job_last_error"})


def by_resolved(letters: DataFrame, resolved: bool) -> DataFrame:
    return letters.filter(F.col("resolved") == F.lit(resolved))


def statistics(letters: DataFrame) -> DataFrame:
    return letters.agg(
        F.count(F.lit(1)).alias("total_messages"), F.count_if(~F.col("resolved")).alias("unresolved"),
        F.count_if("resolved").alias("resolved"), F.count_distinct("job_id").alias("unique_jobs"),
        F.max("moved_to_dlq_at").alias("latest_message"), F.avg("retry_count").alias("avg_retries"))


def capture(letters: DataFrame, incoming: DataFrame) -> DataFrame:
    """New dead letters: one row per message, the first report wins.

    incoming(id, job_id, message_id, message_body, receive_count, last_error, moved_to_dlq_at).
    """
    fresh = insert_if_absent(letters, incoming, "message_id", ["moved_to_dlq_at", "id"])
    return fresh.select(
        "id", "job_id", "message_id", "message_body", T.count_default(F.col("receive_count")).alias("receive_count"),
        "last_error", "moved_to_dlq_at", F.lit(0).alias("retry_count"),
        F.lit(None).cast("timestamp_ntz").alias("last_retry_at"), F.lit(False).alias("resolved"))


def mark_dead(jobs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Job table after the reports: status dlq, the last report of a job wins."""
    last = newest(incoming.select("job_id", "message_id", "last_error", "moved_to_dlq_at", "id"),
                  "job_id", ["moved_to_dlq_at", "id"])
    return update_by_key(jobs, last.select(
        F.col("job_id").alias("id"), F.lit("dlq").alias("status"), F.col("message_id").alias("dlq_message_id"),
        F.col("moved_to_dlq_at").alias("dlq_moved_at"), "last_error"), "id", ["dlq_moved_at"])


def retry(letters: DataFrame, requests: DataFrame) -> DataFrame:
    """Dead letters after retry requests(id, requested_at); they stay unresolved."""
    times = requests.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("_n"), F.max("requested_at").alias("_at"))
    joined = letters.join(times, "id", "left")
    return joined.select(*[
        (F.col("retry_count") + F.coalesce("_n", F.lit(0))).alias(c) if c == "retry_count"
        else F.coalesce("_at", c).alias(c) if c == "last_retry_at" else F.col(c) for c in letters.columns])


def retried_jobs(jobs: DataFrame, letters: DataFrame, requests: DataFrame) -> DataFrame:
    """Job table after retry requests: status retrying, no attempts, no error."""
    ids = letters.join(requests.select("id"), "id", "left_semi").select(F.col("job_id").alias("id")).distinct()
    return update_by_key(jobs, ids.select(
        "id", F.lit("retrying").alias("status"), F.lit(0).alias("attempts"),
        F.lit(None).cast("string").alias("last_error")), "id", ["attempts"])


def retry_messages(letters: DataFrame, requests: DataFrame) -> DataFrame:
    """Messages to publish again, one per request."""
    return requests.join(letters.select("id", "job_id", "message_body"), "id").select(
        "job_id", F.col("message_body").alias("value"))


def resolve(letters: DataFrame, requests: DataFrame) -> DataFrame:
    """Dead letters after resolutions(id, resolved_at, reason); the last one of a letter wins."""
    last = newest(requests, "id", ["resolved_at"])
    reason = F.coalesce(F.col("reason"), F.lit(RESOLUTION))
    return update_by_key(letters, last.select(
        "id", F.lit(True).alias("resolved"), "resolved_at", reason.alias("resolution_reason")), "id", ["resolved_at"])


def retained(rows: DataFrame, ts: str, days: int) -> DataFrame:
    """Marks rows older than the retention period, counted from the newest row."""
    clock = rows.agg(F.max(ts).alias("_now"))  # one row
    return rows.crossJoin(F.broadcast(clock)).withColumn(
        "expired", F.col(ts) < F.col("_now") - F.make_dt_interval(F.lit(days))).drop("_now")
