"""Job table: status, history, roll-up and state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from .asof import micros, nearest
from .reuse import miss_times
from .tables import newest, update_by_key

# fixed values: limits of the service
HISTORY_LIMIT = 50
MAX_RECEIVE = 3
KEEP_DAYS = 1
VISIBILITY_SECONDS = 30
OVERDUE_SECONDS = 30
TERMINAL = ("complete", "failed", "dlq")
STATUS_COLUMNS = ["id", "status", "result", "cache_hit", "processing_time_ms", "created_at", "completed_at"]


def status(jobs: DataFrame, job_id=None) -> DataFrame:
    """Status view of one job, or of all."""
    picked = jobs if job_id is None else jobs.filter(F.col("id") == job_id)
    return picked.select(*STATUS_COLUMNS)


def history(jobs: DataFrame) -> DataFrame:
    """History view with the number of issues taken from the result document."""
    return jobs.select("id", "user_id", "file_name", "status", "cache_hit", "processing_time_ms", "created_at",
                       T.json_int(F.col("result"), "$.metrics.issuesFound").alias("issues_found"))


def user_history(jobs: DataFrame, user_id, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest jobs of one user."""
    mine = history(jobs.filter(F.col("user_id") == user_id)).drop("user_id")
    return mine.orderBy(F.desc("created_at"), "id").limit(limit)


def histories(jobs: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest jobs of every user.

    Spark cuts each user to ``limit`` rows before the shuffle, so a user with
    very many jobs does not fill one task.  The JSON is parsed afterwards.
    """
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id")
    top = jobs.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
    return top.select(
        "user_id", "position", "id", "file_name", "status", "cache_hit", "processing_time_ms", "created_at",
        T.json_int(F.col("result"), "$.metrics.issuesFound").alias("issues_found"))


def reportable(jobs: DataFrame) -> DataFrame:
    """Only complete jobs have a report."""
    return jobs.filter(F.col("status") == "complete")


def rollup(jobs: DataFrame) -> DataFrame:
    """Dashboard counts and the mean processing time of completed jobs."""
    done = (F.col("status") == "complete") & (F.col("processing_time_ms") > 0)
    return jobs.agg(
        *[F.count_if(F.col("status") == s).alias(n) for s, n in
          (("queued", "queued"), ("processing", "processing"), ("complete", "completed"))],
        F.count_if(F.col("status").isin("failed", "retrying")).alias("failed"),
        F.count(F.lit(1)).alias("total"),
        T.round_half_up(F.coalesce(F.avg(F.when(done, F.col("processing_time_ms"))), F.lit(0.0))).alias("avg_time"))


# ---- state changes: each takes the job table and a frame of changes ----------
def start(jobs: DataFrame, starts: DataFrame) -> DataFrame:
    """starts(id, attempts): the jobs are being worked on."""
    return update_by_key(jobs, starts.select("id", F.lit("processing").alias("status"), "attempts"), "id", ["attempts"])


def finish(jobs: DataFrame, ends: DataFrame) -> DataFrame:
    """ends(id, result, completed_at, processing_time_ms, attempts)."""
    return update_by_key(jobs, ends.select(
        "id", F.lit("complete").alias("status"), "result", "completed_at", "processing_time_ms", "attempts",
        F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("string").alias("dlq_message_id")), "id",
        ["completed_at", "attempts"])


def fail(jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """failures(id, attempts, last_error): the queue will deliver the job again."""
    return update_by_key(jobs, failures.select("id", F.lit("retrying").alias("status"), "attempts", "last_error"), "id",
                         ["attempts"])


def changed(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """Job table after a log of starts, failures and ends, delivered at least once and in any order.

    log(id, kind, at, attempts, last_error, result, processing_time_ms) with kind start, fail or finish.  Each
    column is taken from the last entry of a kind that writes it; at one instant a start precedes a failure, a
    failure an end.  One aggregate with map-side combine and one join.
    """
    kinds = F.array(*[F.lit(k) for k in ("start", "fail", "finish")])
    at = F.struct("at", F.array_position(kinds, F.col("kind")).alias("k"), "attempts", "last_error", "result", "processing_time_ms")
    wrote = F.col("kind") != "start"
    last = log.groupBy("id").agg(
        F.max(at).alias("n"), F.max(F.when(wrote, at)).alias("e"), F.max(F.when(F.col("kind") == "finish", at)).alias("f"))
    status = F.element_at(F.array(F.lit("processing"), F.lit("retrying"), F.lit("complete")), F.col("n.k").cast("int"))
    new = {"status": status, "attempts": F.col("n.attempts")}
    out = jobs.join(last, "id", "left")
    error = F.when(F.col("e").isNotNull(), F.when(F.col("e.k") == 2, F.col("e.last_error"))).otherwise(F.col("last_error"))
    done = {"result": F.col("f.result"), "completed_at": F.col("f.at"), "processing_time_ms": F.col("f.processing_time_ms"),
            "dlq_message_id": F.lit(None).cast("string")}
    columns = []
    for c in jobs.columns:
        if c in new:
            columns.append(F.when(F.col("n").isNotNull(), new[c]).otherwise(F.col(c)).alias(c))
        elif c == "last_error":
            columns.append(error.alias(c))
        elif c in done:
            columns.append(F.when(F.col("f").isNotNull(), done[c]).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)


def insert_hits(jobs: DataFrame, hits: DataFrame) -> DataFrame:
    """Append jobs that were answered from an earlier result.

    hits(id, user_id, file_name, code_hash, result, created_at, ...): result is the document of the earlier
    answer, already marked as reused; such a job is complete from the beginning.  A column of the hits that the
    job table lacks is added to it.
    """
    rows = hits.select("*", F.lit("complete").alias("status"), F.lit(True).alias("cache_hit"),
                       F.lit(0).alias("processing_time_ms"), F.col("created_at").alias("completed_at"))
    return jobs.unionByName(rows, allowMissingColumns=True)


def latest_state(log: DataFrame, key: str = "job_id", order=("ts", "event_id")) -> DataFrame:
    """Last state of each job in an event log."""
    return newest(log, key, order)


# ---- deliveries --------------------------------------------------------------
ROUTED = ["delivery_id", "message_id", "attempt", "status"]


def lives(deliveries: DataFrame, keep_days: int = KEEP_DAYS) -> DataFrame:
    """deliveries(message_id, t, ..., and optionally last) plus ``life``: when the life of the message began.

    The queue keeps a message for ``keep_days`` from its first delivery.  A delivery at or after that end begins a
    new life of the id, with a count of its own; that is the same rule as a result that lives from its first
    computation.  ``last`` is the beginning of the life known before these rows.  Messages seen within one life,
    nearly all, need only their first time.
    """
    keep = keep_days * 86_400_000_000
    if "last" not in deliveries.columns:
        deliveries = deliveries.withColumn("last", F.lit(None).cast("long"))
    span = deliveries.groupBy("message_id").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    begin = F.when(F.col("_hi") < F.col("last") + keep, F.col("last")).when(
        (F.col("last").isNull() | (F.col("_lo") >= F.col("last") + keep)) & (F.col("_hi") < F.col("_lo") + keep), F.col("_lo"))
    joined = deliveries.join(span, "message_id").withColumn("life", begin).drop("_lo", "_hi")
    longer = joined.filter("life is null").drop("life")
    times = longer.select(F.col("message_id").alias("code_hash"), "t", "last")
    starts = miss_times(times, keep_days * 86_400).union(times.filter("last is not null").select("code_hash", "last")).distinct()
    starts = starts.select(F.col("code_hash").alias("message_id"), F.col("t").alias("_begin"))
    found = nearest(longer, starts, ["message_id"], "t", "_begin", forward=False)
    # a row from before all known lives belongs to the known one
    found = found.withColumn("life", F.coalesce("matched", "last")).drop("matched")
    return joined.filter("life is not null").unionByName(found)


def route_deliveries(deliveries: DataFrame, max_receive: int = MAX_RECEIVE, keep_days: int = KEEP_DAYS) -> DataFrame:
    """Attempt number and outcome of each delivery of a message.

    A message is closed by its first success or by ``max_receive`` failures; deliveries after that are kept with
    status ``ignored`` and no attempt number.  Only the first few deliveries of a life can be attempts, so Spark
    cuts each message to them before the shuffle.
    """
    timed = deliveries.withColumn("t", micros(F.col("delivered_at")))
    narrow = lives(timed.select("message_id", "delivery_id", "failed", "t"), keep_days)
    first = attempts_of(narrow, max_receive)
    return deliveries.join(first.select("delivery_id", "attempt", "status"), "delivery_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("ignored")))


def attempts_of(narrow: DataFrame, max_receive: int) -> DataFrame:
    """Attempts among deliveries(message_id, life, t, delivery_id, failed, and optionally attempts, closed before)."""
    for name, kind in (("attempts", "int"), ("closed", "boolean")):
        if name not in narrow.columns:
            narrow = narrow.withColumn(name, F.lit(None).cast(kind))
    order = Window.partitionBy("message_id", "life").orderBy("t", "delivery_id")
    first = narrow.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= max_receive)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("answered", F.coalesce(F.max(~F.col("failed")).over(before), F.lit(False)))
    attempt = (F.coalesce("attempts", F.lit(0)) + F.col("k")).cast("int")
    live = first.filter(~F.col("answered") & ~F.coalesce("closed", F.lit(False))).withColumn("attempt", attempt)
    status = F.when(~F.col("failed"), "complete").when(F.col("attempt") >= max_receive, "dlq").otherwise("retrying")
    return live.filter(F.col("attempt") <= max_receive).withColumn("status", status)


def stuck(log: DataFrame, seconds: int, as_of: str | None = None) -> DataFrame:
    """Jobs whose last state is not terminal and older than ``seconds``.

    ``log(job_id, status, ts, event_id)``; the clock is the newest event of the
    log unless ``as_of`` is given.
    """
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else None
    last = latest_state(log)
    if now is None:
        clock = log.agg(F.max("ts").alias("_now"))  # one row
        last, now = last.crossJoin(F.broadcast(clock)), F.col("_now")
    age = F.timestamp_diff("MICROSECOND", F.col("ts"), now) / F.lit(1_000_000.0)
    return last.withColumn("age_seconds", age).filter(
        ~F.col("status").isin(*TERMINAL) & (F.col("age_seconds") > seconds)).drop("_now")


def visible_again(log: DataFrame, seconds: int = VISIBILITY_SECONDS) -> DataFrame:
    """Starts that were not ended within the visibility timeout."""
    starts = log.filter(F.col("status") == "processing").groupBy("job_id").agg(
        F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("s")).select("job_id", "s.event_id", "s.ts")
    ends = log.filter(F.col("status").isin(*TERMINAL, "retrying")).groupBy("job_id").agg(F.max("ts").alias("ended_at"))
    late = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("ended_at")) > seconds * 1_000_000
    return starts.join(ends, "job_id", "left").filter(
        F.col("ended_at").isNull() | (F.col("ended_at") < F.col("ts")) | late).select("job_id", "event_id", "ts", "ended_at")
