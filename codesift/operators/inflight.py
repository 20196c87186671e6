"""Reuse by content hash when a result takes time: its life begins at completion, several misses may be in flight.

A submission is a hit when a miss of its hash before it was completed at or before that moment and less than one time
to live ago.  Until the first of them is completed every submission is a miss with a completion of its own.

Time runs in half microseconds: a submission stands at ``at`` = 2t, a result is there at ``effect`` = 2c.  A job that is
done at once has its effect at 2t + 1, so it is a miss itself and answers what follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import store
from .asof import micros, nearest

KEYS = ["code_hash"]
FOLDED_JOBS = 1_000  # hashes with more jobs are followed by joins; both ways give the same
NEVER = (1 << 63) - 1


def even(effect: Column) -> Column:
    return effect - F.pmod(effect, F.lit(2))


def jobs_of(submissions: DataFrame) -> DataFrame:
    """submissions(job_id, code_hash, created_at, completed_at) -> (job_id, code_hash, at, effect) of what may be a miss.

    A null completion never takes effect, one before its submission counts as done at once.  At one instant the
    lowest job number comes first: what follows a job that is done at once is answered by it, and left out here.
    """
    at, done = 2 * micros(F.col("created_at")), 2 * micros(F.col("completed_at"))
    jobs = submissions.select("job_id", "code_hash", at.alias("at"), F.when(done <= at, at + 1).otherwise(done).alias("effect"))
    jobs = store(jobs, "flights")
    at_once = jobs.filter(F.col("effect") == F.col("at") + 1).groupBy("code_hash", "at").agg(F.min("job_id").alias("_first"))
    return jobs.join(at_once, ["code_hash", "at"], "left").filter(
        F.col("_first").isNull() | (F.col("job_id") <= F.col("_first"))).select("job_id", "code_hash", "at", "effect")


def miss_instants(jobs: DataFrame, known: DataFrame | None, ttl: int, hot_rows: int = FOLDED_JOBS) -> DataFrame:
    """jobs as from ``jobs_of``; known(code_hash, effect): results of earlier misses, there or still to come.

    (code_hash, at) of the instants at which the cache misses.
    """
    if known is None:
        known = jobs.sparkSession.createDataFrame([], "code_hash string, effect long")
    sizes = jobs.select("code_hash").union(known.select("code_hash")).groupBy("code_hash").agg(F.count(F.lit(1)).alias("n"))
    hot = store(sizes.filter(F.col("n") > hot_rows).select("code_hash"), "hot")
    cold = jobs.join(hot, "code_hash", "left_anti").groupBy("code_hash").agg(
        F.array_sort(F.collect_list(F.struct("at", "effect"))).alias("jobs"))
    earlier = known.join(hot, "code_hash", "left_anti").groupBy("code_hash").agg(F.collect_set("effect").alias("known"))
    folded = cold.join(earlier, "code_hash", "left").select("code_hash", F.explode(_fold(F.col("jobs"), F.col("known"), ttl)).alias("at"))
    if hot.isEmpty():
        return folded
    return folded.unionByName(_followed(jobs.join(hot, "code_hash", "left_semi"), known.join(hot, "code_hash", "left_semi"), ttl))


def _fold(jobs: Column, known: Column, ttl: int) -> Column:
    """Instants of the misses, out of (at, effect) in order of time; what is in flight is an array."""
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.coalesce(known, none).alias("flying"), none.alias("out"))

    def landed(a: Column, x: Column) -> Column:
        last = F.greatest(a["last"], F.array_max(F.filter(a["flying"], lambda e: e <= x["at"])))
        return F.struct(last.alias("last"), F.filter(a["flying"], lambda e: e > x["at"]).alias("flying"), a["out"].alias("out"))

    def judged(a: Column, x: Column) -> Column:
        hit = a["last"].isNotNull() & (x["at"] < even(a["last"]) + 2_000_000 * ttl)
        flying = F.when(x["effect"].isNull(), a["flying"]).otherwise(F.concat(a["flying"], F.array(x["effect"])))
        return F.when(hit, a).otherwise(F.struct(
            a["last"].alias("last"), flying.alias("flying"), F.concat(a["out"], F.array(x["at"])).alias("out")))

    return F.aggregate(jobs, start, lambda a, x: F.transform(F.array(landed(a, x)), lambda b: judged(b, x))[0],
                       lambda a: F.array_distinct(a["out"]))


def _followed(jobs: DataFrame, known: DataFrame, ttl: int) -> DataFrame:
    """The same for hashes of any size, by joins on (hash, time).

    A job that takes longer than the time to live can land after the cache is empty again.  Whether it is a miss is
    found first without such results, then with those found, until they stay: a round is right for one time to
    live more than the round before, so this ends, and at once where no job takes so long.
    """
    wait = 2_000_000 * ttl
    jobs = store(jobs, "jobs")
    nodes = store(jobs.groupBy("code_hash", "at").agg(
        F.min("effect").alias("soonest"), F.max(F.when(F.col("effect") <= F.col("at") + wait, F.col("effect"))).alias("top")), "nodes")
    long = store(jobs.filter(F.col("effect") > F.col("at") + wait).select("code_hash", "at", "effect").distinct(), "long")
    # what lands first of all that is submitted at or after an instant, and the next instant: the same in all rounds
    nodes = nearest(nodes, nodes.select("code_hash", "at", "soonest"), KEYS, "at", "at", True, value="soonest").withColumnRenamed(
        "matched", "first").withColumn("_p", F.col("at") + 1)
    nodes = store(nearest(nodes, nodes.select("code_hash", "at"), KEYS, "_p", "at", True).withColumnRenamed(
        "matched", "next").select("code_hash", "at", "top", "first", "next"), "nodes")
    known = store(known.select("code_hash", "effect").distinct(), "known")
    landing = known
    while True:
        missed = store(_missed(nodes, landing, wait), "missed")
        if long.isEmpty():
            return missed
        found = store(long.join(missed, ["code_hash", "at"], "left_semi").select("code_hash", "effect").union(known).distinct(), "landing")
        keys = ["code_hash", "effect"]
        if found.join(landing, keys, "left_anti").isEmpty() and landing.join(found, keys, "left_anti").isEmpty():
            return missed
        landing = found


def _missed(nodes: DataFrame, landing: DataFrame, wait: int) -> DataFrame:
    """(code_hash, at) of the misses, given the results of long jobs and of earlier batches.

    Misses come in stretches.  A stretch that begins at an instant ends where the first result lands; the cache then
    lives on until one time to live after the last result of the stretch, since the jobs of a stretch that are not long
    land within one time to live of each other.  So every instant points to the one that would begin the next stretch, and
    doubling these pointers finds all stretches in log2 of their number of rounds.
    """
    before = nearest(nodes, landing, KEYS, "at", "effect", False).withColumn(
        "free", F.col("matched").isNull() | (F.col("at") >= even(F.col("matched")) + wait)).drop("matched")
    ends = nearest(before, landing, KEYS, "at", "effect", True).withColumn("until", F.least("first", "matched")).drop("matched", "first")
    ends = store(ends, "stretches")
    free = ends.filter("free").select("code_hash", "at")
    stops = _last_result(ends).withColumn("_p", even(F.greatest("until", "top")) + wait)
    jump = store(nearest(stops.select("code_hash", "at", "_p"), free, KEYS, "_p", "at", True).filter("matched IS NOT NULL").select(
        "code_hash", "at", F.col("matched").alias("to")), "jump")
    marked = store(free.groupBy("code_hash").agg(F.min("at").alias("at")), "marked")
    while True:
        reached = store(marked.join(jump, ["code_hash", "at"]).select("code_hash", F.col("to").alias("at")).distinct().join(
            marked, ["code_hash", "at"], "left_anti"), "reached")
        if reached.isEmpty():
            break
        marked = store(marked.unionByName(reached), "marked")
        there = jump.select("code_hash", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump = store(jump.join(there, ["code_hash", "to"]).select("code_hash", "at", F.col("beyond").alias("to")), "jump")
    # stretches that begin later end later: the greatest end of those begun is that of the last one
    begun = marked.join(ends, ["code_hash", "at"]).select("code_hash", "at", F.coalesce("until", F.lit(NEVER)).alias("until"))
    return nearest(ends.select("code_hash", "at"), begun, KEYS, "at", "at", False, value="until").filter(
        F.col("at") < F.col("matched")).select("code_hash", "at")


def _last_result(ends: DataFrame) -> DataFrame:
    """(code_hash, at, until, top): the greatest ``top`` of the instants from ``at`` to before ``until``.

    Steps of 1, 2, 4 ... instants are built as long as one fits into a stretch, then each stretch is walked with the
    largest steps first: twice log2 of the instants of the longest stretch joins.  Stretches without an end are left out.
    """
    ends = ends.filter("until IS NOT NULL")
    step = store(ends.filter("next < until").select("code_hash", "at", "until", F.col("next").alias("to"), "top"), "step")
    steps = []
    while not step.isEmpty():
        steps.append(step)
        more = step.select("code_hash", F.col("at").alias("to"), F.col("to").alias("beyond"), F.col("top").alias("further"))
        step = store(step.join(more, ["code_hash", "to"]).filter("beyond < until").select(
            "code_hash", "at", "until", F.col("beyond").alias("to"), F.greatest("top", "further").alias("top")), "step")
    walk = ends.select("code_hash", "at", "until", F.col("at").alias("here"), F.lit(None).cast("long").alias("top"))
    for step in reversed(steps):
        ahead = step.select("code_hash", F.col("at").alias("here"), "to", F.col("top").alias("more"))
        fits = F.col("to") < F.col("until")
        walk = store(walk.join(ahead, ["code_hash", "here"], "left").select(
            "code_hash", "at", "until", F.when(fits, F.col("to")).otherwise(F.col("here")).alias("here"),
            F.when(fits, F.greatest("top", "more")).otherwise(F.col("top")).alias("top")), "walk")
    own = ends.select("code_hash", F.col("at").alias("here"), F.col("top").alias("own"))
    return walk.join(own, ["code_hash", "here"]).select("code_hash", "at", "until", F.greatest("top", "own").alias("top"))


def label(submissions: DataFrame, ttl: int, hot_rows: int = FOLDED_JOBS) -> DataFrame:
    """Adds ``hit`` to submissions(job_id, code_hash, created_at, completed_at, ...)."""
    jobs = store(jobs_of(submissions), "jobs")
    missed = jobs.join(miss_instants(jobs, None, ttl, hot_rows), ["code_hash", "at"], "left_semi").select("job_id", F.lit(True).alias("_miss"))
    return submissions.join(missed, "job_id", "left").withColumn("hit", F.col("_miss").isNull()).drop("_miss")
