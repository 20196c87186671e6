"""Reuse of results by content hash within a fixed time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..session import store
from . import inflight
from .asof import micros, nearest

# fixed values of the cache
TTL_SECONDS = 3600
HIT_REVIEW_TIME = "<0.1s"
UNKNOWN_REVIEW_TIME = "N/A"


def with_hash(submissions: DataFrame) -> DataFrame:
    """Adds the content hash; the name and language of a file are not part of it."""
    return submissions.withColumn("code_hash", T.content_hash(F.col("content")))


def first_submissions(hashed: DataFrame) -> DataFrame:
    """First submission of each content: code_hash, job_id.  Narrow rows only."""
    return hashed.select("code_hash", "created_at", "job_id").groupBy("code_hash").agg(
        F.min(F.struct("created_at", "job_id")).alias("f")).select("code_hash", F.col("f.job_id").alias("job_id"))


def live_entry(submissions: DataFrame, cache: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """For each submission the newest cache entry of its hash that is still alive.

    submissions(code_hash, created_at, ...), cache(code_hash, cached_at): adds
    ``cached_at`` (null on a miss).  An entry lives for ``ttl`` seconds; if the
    newest one before a submission is dead, all older ones are.
    """
    probes = submissions.withColumn("_p", micros(F.col("created_at")))
    points = cache.select("code_hash", micros(F.col("cached_at")).alias("_c")).distinct()
    found = nearest(probes, points, ["code_hash"], "_p", "_c", forward=False)
    alive = F.col("_p") < F.col("matched") + ttl * 1_000_000
    return found.withColumn("cached_at", F.when(alive, F.timestamp_micros("matched").cast("timestamp_ntz"))).drop(
        "_p", "matched")


def _fold(times: Column, ttl: int, last: Column) -> Column:
    """Miss times out of ascending times: each one at least ``ttl`` after the last miss."""
    start = F.struct(last.alias("last"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(times, start, lambda a, t: F.when(
        a["last"].isNull() | (t >= a["last"] + ttl * 1_000_000),
        F.struct(t.alias("last"), F.concat(a["out"], F.array(t)).alias("out"))).otherwise(a), lambda a: a["out"])


def miss_times(times: DataFrame, ttl: int = TTL_SECONDS, hot_rows: int = 10_000) -> DataFrame:
    """times(code_hash, t): the times at which the greedy cache misses.

    The window starts at a miss and hits do not extend it, so whether a time
    is a miss depends on the last miss.  Hashes with up to ``hot_rows`` distinct
    times are folded in one array; larger ones are followed by doubling.
    An optional column ``last`` holds the last miss before the batch.
    """
    if "last" not in times.columns:
        times = times.withColumn("last", F.lit(None).cast("long"))
    times = times.distinct()
    sizes = times.groupBy("code_hash").agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.filter(F.col("n") > hot_rows).select("code_hash")
    cold = times.join(hot, "code_hash", "left_anti").groupBy("code_hash").agg(
        F.array_sort(F.collect_list("t")).alias("ts"), F.max("last").alias("last"))
    folded = cold.select("code_hash", F.explode(_fold(F.col("ts"), ttl, F.col("last"))).alias("t"))
    if hot.isEmpty():
        return folded
    return folded.unionByName(_chain(times.join(hot, "code_hash", "left_semi"), ttl))


def _chain(times: DataFrame, ttl: int) -> DataFrame:
    """Miss times of very frequent hashes by pointer doubling.

    Every time points to the first time at least ``ttl`` later.  A round marks
    what the marked times point to and then doubles the length of the pointers,
    so n misses need log2(n) rounds.  All joins are on (hash, time).
    """
    wait = ttl * 1_000_000
    nodes = store(times.select("code_hash", "t", "last"), "times")
    points = nodes.select("code_hash", "t")
    begin = nodes.groupBy("code_hash").agg(F.min("t").alias("lo"), F.max("last").alias("last")).select(
        "code_hash", F.greatest("lo", F.col("last") + wait).alias("_p"))
    marked = store(nearest(begin, points, ["code_hash"], "_p", "t", forward=True)
                   .filter("matched is not null").select("code_hash", F.col("matched").alias("t")), "marked")
    probes = points.withColumn("_p", F.col("t") + wait)
    jump = store(nearest(probes, points, ["code_hash"], "_p", "t", forward=True)
                 .filter("matched is not null").select("code_hash", "t", F.col("matched").alias("to")), "jump")
    while True:
        reached = store(marked.join(jump, ["code_hash", "t"]).select("code_hash", F.col("to").alias("t"))
                        .join(marked, ["code_hash", "t"], "left_anti"), "reached")
        if reached.isEmpty():
            return marked
        marked = store(marked.unionByName(reached), "marked")
        there = jump.select("code_hash", F.col("t").alias("to"), F.col("to").alias("beyond"))
        jump = store(jump.join(there, ["code_hash", "to"]).select("code_hash", "t", F.col("beyond").alias("to")), "jump")


def label(submissions: DataFrame, ttl: int = TTL_SECONDS, hot_rows: int = 10_000) -> DataFrame:
    """Adds ``hit``: answered from an earlier result or analysed anew.

    submissions(job_id, code_hash, created_at, ...).  At one instant the lowest
    job number comes first.  With a column ``completed_at`` a result lives from
    its completion and several misses may be in flight (``inflight``); without
    it, from the submission.
    """
    if "completed_at" in submissions.columns:
        return inflight.label(submissions, ttl, min(hot_rows, inflight.FOLDED_JOBS))
    narrow = submissions.select("code_hash", micros(F.col("created_at")).alias("t"), "job_id")
    # written once: the texts are hashed a single time for all later steps
    instants = store(narrow.groupBy("code_hash", "t").agg(F.min("job_id").alias("job_id")), "instants")
    misses = miss_times(instants.select("code_hash", "t"), ttl, hot_rows)
    missed = instants.join(misses, ["code_hash", "t"], "left_semi").select("job_id", F.lit(True).alias("_miss"))
    return submissions.join(missed, "job_id", "left").withColumn("hit", F.col("_miss").isNull()).drop("_miss")


def statistics(labelled: DataFrame) -> DataFrame:
    """Hits, misses and the hit rate in percent."""
    hits, total = F.count_if("hit"), F.count(F.lit(1))
    return labelled.agg(
        hits.alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
        F.when(total == 0, F.lit(0.0)).otherwise(F.round(hits / total * 100, 2)).alias("hit_rate"))


def per_day(labelled: DataFrame) -> DataFrame:
    """Reuse report per day: labelled(job_id, created_at, hit, n_bytes)."""
    hits, total = F.count_if("hit"), F.count(F.lit(1))
    return labelled.groupBy(F.to_date("created_at").alias("day")).agg(
        total.alias("submissions"), F.count_if(~F.col("hit")).alias("analyses"),
        F.round(hits / total * 100, 2).alias("hit_rate"),
        F.sum(F.when(F.col("hit"), F.col("n_bytes")).otherwise(0)).alias("bytes_saved"))


def hit_result(result: Column) -> Column:
    """The result document of a hit: new metrics, the original ones kept beside them."""
    m = result["metrics"]
    changed = result.withField("metrics.reviewTime", F.lit(HIT_REVIEW_TIME)).withField(
        "metrics.processingTimeMs", F.lit(0))
    return changed.withField(
        "metrics.originalReviewTime", F.coalesce(m["reviewTime"], F.lit(UNKNOWN_REVIEW_TIME))).withField(
        "metrics.originalProcessingTimeMs", F.coalesce(m["processingTimeMs"], F.lit(0)))
