"""Structured Streaming jobs over submissions, deliveries and dead letters."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import inflight, jobs as J, reuse, score
from ..operators.asof import micros, nearest
from ..operators.scan import scan
from ..operators.tables import newest, oldest
from ..session import scratch
from ..sources.daytable import DayTable


# ---- running a stream to its end ---------------------------------------------
# Every function takes a folder for its output and its progress.  A call with the folder of an earlier one goes on
# where that one stopped; without a folder a new one is made.
def to_table(stream: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """Process what is there, append it to a table in the shared folder, read it."""
    spark = stream.sparkSession
    path = path or scratch(spark, purpose)
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows")
             .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def each_batch(stream: DataFrame, purpose: str, write: Callable[[DataFrame, int, str], None], mode: str = "append",
               path: str | None = None) -> str:
    """Process what is there batch by batch; returns the folder the batches wrote to."""
    path = path or scratch(stream.sparkSession, purpose)
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/progress")
             .foreachBatch(lambda df, n: write(df, n, f"{path}/rows")).trigger(availableNow=True).start())
    query.awaitTermination()
    return f"{path}/rows"


def put(df: DataFrame, path: str, batch: int) -> None:
    """Write the rows of one batch; a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that no batch needs any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, path: str) -> DataFrame:
    """A frame that a batch uses more than once, written; the batch drops it at its end."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_apart(stream: DataFrame, time: str, seconds: int, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A stream of the rows that come in time, and a table of those that do not: (rows, late rows with their batch).

    A row is late when it is at least ``seconds`` older than the newest row of the batches before, so a stage behind
    with a watermark of that delay drops none: each row is in one of the two.  Rows without a time are in time.
    """
    spark, t = stream.sparkSession, micros(F.col(time))

    def write(df: DataFrame, n: int, at: str) -> None:
        rows = staged(df, f"{at}-all/{n}")
        clock = newest_before(spark, at, n)
        late = F.lit(False) if clock is None else F.coalesce(t <= clock - seconds * 1_000_000, F.lit(False))
        put(rows.filter(~late), at, n)
        put(rows.filter(late), f"{at}-late", n)
        tell_newest(spark, at, n, clock, rows.agg(F.max(t)).first()[0])
        drop(spark, f"{at}-all/{n}")

    at = each_batch(stream, "in-time", write, path=path)
    late = spark.read.schema(_with_batch(stream)).parquet(f"{at}-late") if exists(spark, f"{at}-late") else spark.createDataFrame(
        [], _with_batch(stream))
    return spark.readStream.schema(stream.schema).parquet(f"{at}/batch=*"), late


def newest_before(spark: SparkSession, at: str, batch: int) -> int | None:
    """The newest time, in microseconds, of the batches before this one."""
    return spark.read.parquet(f"{at}-clock/batch={batch - 1}").first()["newest"] if batch > 0 else None


def tell_newest(spark: SparkSession, at: str, batch: int, *times: int | None) -> int | None:
    """Write the newest of these times as that of the batches up to this one."""
    newest_t = max((x for x in times if x is not None), default=None)
    put(spark.createDataFrame([(newest_t,)], "newest long").coalesce(1), f"{at}-clock", batch)
    return newest_t


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


class Runs:
    """A keyed table that batches bring up to date by writing only their own rows.

    A batch adds a run: what it says of its keys.  Four runs of one size are merged into one of the next size, so a row is written
    once for each size, and what a batch writes follows the batch and not the table.  A run is cut by a hash of the
    key into as many folders as its rows need; a look-up reads the folders its keys fall into.  ``merge`` brings rows of
    several runs down to one for each key, in whatever order the runs come.

    The live runs are listed in a manifest per batch.  A repeated batch starts from the manifest of the batch before
    it and replaces its own runs.  Runs that neither this batch nor the one before needs are deleted.
    """

    FANOUT = 4
    ROWS_PER_FOLDER = 1 << 16
    MANIFEST = "run string, tier int, folders int, rows long"

    def __init__(self, spark: SparkSession, path: str, schema, key: str, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.key, self.merge = spark, path, schema, key, merge

    def live(self, batch: int) -> list[tuple[str, int, int, int]]:
        """Run, tier, folders and rows of each run after a batch: some for each size, so few."""
        if batch < 0:
            return []
        return sorted(map(tuple, self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}-manifest/batch={batch}").collect()))

    def _rows(self, runs: list[tuple], only: dict[int, set[int]] | None = None) -> DataFrame:
        paths = [f"{self.path}-run/{run}/folder={f}" for run, _, folders, rows in runs if rows
                 for f in (range(folders) if only is None else sorted(only[folders]))]
        found = [p for p in paths if exists(self.spark, p)]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def _folder(self, folders: int):
        return F.pmod(F.xxhash64(self.key), F.lit(folders)).cast("int")

    def known(self, batch: int, keys: DataFrame) -> DataFrame:
        """What the table holds of these keys after a batch."""
        runs = self.live(batch)
        most = max((r[2] for r in runs), default=1)  # folders are powers of two: the finest cut tells all others
        finest = range(1) if most == 1 else [r[0] for r in keys.select(self._folder(most)).distinct().collect()]
        only = {folders: {f % folders for f in finest} for _, _, folders, _ in runs}
        return self.merge(self._rows(runs, only).join(keys.select(self.key).distinct(), self.key, "left_semi"))

    def all(self, batch: int | None = None) -> DataFrame:
        """The table after a batch, or after the newest one."""
        if batch is None:
            batch = self.spark.read.parquet(f"{self.path}-manifest").agg(F.max("batch")).first()[0]
        return self.merge(self._rows(self.live(batch)))

    def _write(self, name: str, tier: int, rows: DataFrame) -> tuple[str, int, int, int]:
        at, wait = f"{self.path}-run/{name}", f"{self.path}-wait/{name}"
        rows = staged(rows, wait)
        n = rows.count()
        folders = 1 << max(0, (n - 1) // self.ROWS_PER_FOLDER).bit_length()
        rows.withColumn("folder", self._folder(folders)).repartition(folders, "folder").write.mode("overwrite").partitionBy("folder").parquet(at)
        drop(self.spark, wait)
        return name, tier, folders, n

    def add(self, batch: int, rows: DataFrame, keep=None) -> None:
        """Add a run with the rows of a batch; rows for which ``keep`` is not true go when runs are merged."""
        before = self.live(batch - 1)
        runs = [*before, self._write(f"{batch}-0", 0, rows)]
        tier = 0
        while len(same := [r for r in runs if r[1] == tier]) >= self.FANOUT:
            merged = self.merge(self._rows(same))
            tier += 1
            runs = [r for r in runs if r not in same]
            runs.append(self._write(f"{batch}-{tier}", tier, merged if keep is None else merged.filter(keep)))
        put(self.spark.createDataFrame(runs, self.MANIFEST).coalesce(1), f"{self.path}-manifest", batch)
        needed = {r[0] for r in [*before, *runs]}
        for run in {r[0] for r in (self.live(batch - 2) if batch > 1 else [])} - needed:
            drop(self.spark, f"{self.path}-run/{run}")


def newest_by(key: str, order: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: newest(rows, key, order)


# ---- review ------------------------------------------------------------------
def review(files: DataFrame) -> DataFrame:
    """Stateless review of every file of the stream."""
    return score.scored(score.with_issues(scan(files))).select(
        "file_id", "language", "n_issues", "score", "grade")


# ---- dead letters --------------------------------------------------------------
def first_report(letters: DataFrame, path: str | None = None, keep_days: int | None = None) -> DataFrame:
    """Idempotent capture: one row per message, the first report wins.

    Known messages lie in runs, so a batch writes only its own messages and repeats are found at any distance; with
    ``keep_days`` keys older than that before the newest report are forgotten when runs are merged, as the queue forgets
    the messages.  A replayed batch replaces its own rows.
    """
    spark, known_schema = letters.sparkSession, "message_id string, seen long"

    def write(df: DataFrame, n: int, at: str) -> None:
        known = Runs(spark, f"{at}-known", known_schema, "message_id", newest_by("message_id", ["seen"]))
        first = oldest(df, "message_id", ["moved_to_dlq_at", "id"])
        fresh = first.join(known.known(n - 1, first).select("message_id"), "message_id", "left_anti")
        put(fresh.select(*df.columns), at, n)
        new = spark.read.schema(df.schema).parquet(f"{at}/batch={n}").select("message_id", micros(F.col("moved_to_dlq_at")).alias("seen"))
        limit = None if keep_days is None else new.agg(F.max("seen")).first()[0]
        known.add(n, new, None if limit is None else F.col("seen") >= limit - keep_days * DAY)

    rows = each_batch(letters, "first-report", write, path=path)
    return spark.read.schema(_with_batch(letters)).parquet(rows).drop("batch")


def _with_batch(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])


def dead_jobs(letters: DataFrame, path: str | None = None) -> DataFrame:
    """The job half of the capture: job_id, message_id, last_error, moved_to_dlq_at of the last report of each job.

    Kept in runs, to which each batch adds its own jobs; a replayed or repeated report changes nothing.
    """
    columns, order = ["job_id", "message_id", "last_error", "moved_to_dlq_at", "id"], ["moved_to_dlq_at", "id"]
    narrow = letters.select(*columns)
    spark = letters.sparkSession

    def table(at: str) -> Runs:
        return Runs(spark, at, narrow.schema, "job_id", newest_by("job_id", order))

    at = each_batch(narrow, "dead-jobs", lambda df, n, at: table(at).add(n, newest(df, "job_id", order)), path=path)
    return table(at).all()


# ---- retry routing -------------------------------------------------------------
ROUTED = "delivery_id long, message_id string, attempt int, status string"
STATE = "messages binary"
GROUPS = 512  # of messages, each with one state
DAY = 86_400_000_000


def route(deliveries: DataFrame, max_receive: int = J.MAX_RECEIVE, keep_days: int = J.KEEP_DAYS, groups: int = GROUPS) -> DataFrame:
    """Attempt number and outcome of each delivery, with a counter per message as state.

    The counters of the messages that share a hash lie in one state, so that the cost of calling Python is paid per group
    and not per message; ``groups`` follows the number of messages alive at a time, some thousands of messages to each.  A counter
    expires by event time, ``keep_days`` after the first delivery of the message; deliveries that come
    later than the watermark, of the same length, are counted by the engine (numRowsDroppedByWatermark).
    """
    keep = keep_days * DAY

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = pickle.loads(state.get[0]) if state.exists else {}  # message: attempts, closed, first
        now = state.getCurrentWatermarkMs() * 1000
        rows = []
        if not state.hasTimedOut:
            seen: list[tuple] = []  # the narrow rows of one group in one batch
            for c in chunks:
                seen += zip(c["t"].tolist(), c["delivery_id"].tolist(), c["failed"].tolist(), c["message_id"].tolist())
            for t, delivery, failed, message in sorted(seen, key=lambda r: r[:3]):
                attempts, closed, first = known.get(message, (0, False, None))
                if first is None or t - first >= keep:
                    attempts, closed, first = 0, False, t
                if closed:
                    rows.append((delivery, message, None, "ignored"))
                else:
                    attempts += 1
                    status = "complete" if not failed else "dlq" if attempts >= max_receive else "retrying"
                    closed = status != "retrying"
                    rows.append((delivery, message, attempts, status))
                known[message] = attempts, closed, first
        known = {message: s for message, s in known.items() if s[2] + keep > now}
        if known:
            state.update((pickle.dumps(known),))
            state.setTimeoutTimestamp(max((min(s[2] for s in known.values()) + keep) // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame({"delivery_id": [r[0] for r in rows], "message_id": [r[1] for r in rows],
                                "attempt": pd.array([r[2] for r in rows], "Int32"), "status": [r[3] for r in rows]})

    narrow = deliveries.select("message_id", "delivery_id", "failed", micros(F.col("delivered_at")).alias("t"),
                               F.col("delivered_at").cast("timestamp").alias("at"),
                               F.pmod(F.xxhash64("message_id"), F.lit(groups)).alias("group")).withWatermark("at", f"{keep_days} days")
    return narrow.groupBy("group").applyInPandasWithState(
        step, ROUTED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def route_in_time(deliveries: DataFrame, by_batch: bool = False, max_receive: int = J.MAX_RECEIVE, keep_days: int = J.KEEP_DAYS,
                  path: str | None = None) -> DataFrame:
    """Either router behind ``set_apart``: a row for every delivery, those more than ``keep_days`` late with status ``late``.

    The queue has forgotten a message by then, so a late delivery is no attempt and changes no count.
    """
    spark = deliveries.sparkSession
    path = path or scratch(spark, "routing")
    narrow = deliveries.select("delivery_id", "message_id", "failed", "delivered_at")
    in_time, late = set_apart(narrow, "delivered_at", keep_days * 86_400, f"{path}/in-time")
    done = (route_by_batch(in_time, max_receive, keep_days, f"{path}/routed") if by_batch
            else to_table(route(in_time, max_receive, keep_days), "routed", f"{path}/routed"))
    return done.unionByName(late.select("delivery_id", "message_id", F.lit(None).cast("int").alias("attempt"), F.lit("late").alias("status")))


def route_by_batch(deliveries: DataFrame, max_receive: int = J.MAX_RECEIVE, keep_days: int = J.KEEP_DAYS,
                   path: str | None = None) -> DataFrame:
    """Like ``route`` without Python workers: each batch continues from a table of message states.

    A state whose life ended more than ``keep_days`` before the newest delivery is dropped; a later delivery of
    that message begins a new life in any case.
    """
    spark, keep = deliveries.sparkSession, keep_days * DAY
    state_schema = "message_id string, attempts int, closed boolean, last long"

    def write(df: DataFrame, n: int, at: str) -> None:
        known = (spark.read.schema(state_schema).parquet(f"{at}-state/batch={n - 1}") if n > 0
                 else spark.createDataFrame([], state_schema))
        fresh = df.select("delivery_id", "message_id", "failed", micros(F.col("delivered_at")).alias("t"))
        placed = J.lives(fresh.join(known, "message_id", "left"), keep_days)
        same = F.col("life") == F.col("last")
        placed = placed.withColumns({"attempts": F.when(same, F.col("attempts")), "closed": F.when(same, F.col("closed"))})
        tried = J.attempts_of(placed, max_receive).select("delivery_id", "attempt", "status")
        routed = placed.join(tried, "delivery_id", "left").withColumn("status", F.coalesce("status", F.lit("ignored")))
        put(routed.select("delivery_id", "message_id", "attempt", "status", "life"), at, n)
        done = spark.read.parquet(f"{at}/batch={n}").groupBy("message_id", F.col("life").alias("last")).agg(
            F.max("attempt").alias("attempts"), F.bool_or(F.col("status").isin("complete", "dlq")).alias("closed"))
        done = done.unionByName(known).groupBy("message_id", "last").agg(F.max("attempts").alias("attempts"), F.bool_or("closed").alias("closed"))
        done = done.groupBy("message_id").agg(F.max_by(F.struct("attempts", "closed", "last"), "last").alias("r")).select("message_id", "r.*")
        newest_t = fresh.agg((F.max("t") - 2 * keep).alias("_from"))  # one row
        kept = done.crossJoin(F.broadcast(newest_t)).filter(F.col("_from").isNull() | (F.col("last") >= F.col("_from"))).drop("_from")
        put(kept.select("message_id", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("closed", F.lit(False)).alias("closed"), "last"),
            f"{at}-state", n)
        if n > 1:
            drop(spark, f"{at}-state/batch={n - 2}")

    rows = each_batch(deliveries, "routed", write, path=path)
    return spark.read.schema(f"{ROUTED}, life long, batch int").parquet(rows).drop("batch", "life")


def latest_status(log: DataFrame, path: str | None = None) -> DataFrame:
    """Last state of each job, in runs to which each batch adds its own jobs."""
    narrow = log.select("job_id", "status", "ts", "event_id")
    spark, order = log.sparkSession, ["ts", "event_id"]

    def table(at: str) -> Runs:
        return Runs(spark, at, narrow.schema, "job_id", newest_by("job_id", order))

    at = each_batch(narrow, "latest", lambda df, n, at: table(at).add(n, newest(df, "job_id", order)), path=path)
    return table(at).all().drop("event_id")


# ---- reuse ---------------------------------------------------------------------
def reuse_labels(submissions: DataFrame, ttl: int = reuse.TTL_SECONDS, hot_rows: int = 10_000, path: str | None = None,
                 late_seconds: int = 0) -> DataFrame:
    """Hit or miss of each submission; the last miss of each hash is carried between batches.

    submissions(job_id, code_hash, created_at).  Uses the batch operator on each batch, so a hash with very many
    submissions does not fill one state group.  Rows older than the newest row of the batches before (less
    ``late_seconds``) cannot be labelled any more: they are set apart with hit null.  A last miss that is older
    than one time to live before the oldest admissible row is forgotten.
    """
    spark = submissions.sparkSession

    def write(df: DataFrame, n: int, at: str) -> None:
        narrow = df.select("job_id", "code_hash", micros(F.col("created_at")).alias("t"))
        put(narrow, f"{at}-narrow", n)  # read and hashed once
        narrow = spark.read.parquet(f"{at}-narrow/batch={n}")
        last = (spark.read.parquet(f"{at}-state/batch={n - 1}") if n > 0
                else spark.createDataFrame([], "code_hash string, last long"))
        clock = spark.read.parquet(f"{at}-clock/batch={n - 1}").first()["newest"] if n > 0 else None
        oldest_t = None if clock is None else clock - late_seconds * 1_000_000
        late = narrow.filter(F.lit(False)) if oldest_t is None else narrow.filter(F.col("t") < oldest_t)
        narrow = narrow if oldest_t is None else narrow.filter(F.col("t") >= oldest_t)
        put(narrow.groupBy("code_hash", "t").agg(F.min("job_id").alias("job_id")), f"{at}-instants", n)
        instants = spark.read.parquet(f"{at}-instants/batch={n}")
        times = instants.select("code_hash", "t").join(last, "code_hash", "left")
        put(reuse.miss_times(times, ttl, hot_rows), f"{at}-misses", n)
        misses = spark.read.schema("code_hash string, t long").parquet(f"{at}-misses/batch={n}")
        missed = instants.join(misses, ["code_hash", "t"], "left_semi").select("job_id", F.lit(True).alias("_miss"))
        labelled = narrow.join(missed, "job_id", "left").select("job_id", "code_hash", F.col("_miss").isNull().alias("hit"))
        put(labelled.unionByName(late.select("job_id", "code_hash", F.lit(None).cast("boolean").alias("hit"))), at, n)
        now = narrow.agg(F.max("t")).first()[0]
        newest_t = max((x for x in (clock, now) if x is not None), default=None)
        state = misses.groupBy("code_hash").agg(F.max("t").alias("last")).unionByName(last).groupBy("code_hash").agg(F.max("last").alias("last"))
        if newest_t is not None:
            state = state.filter(F.col("last") > newest_t - (late_seconds + ttl) * 1_000_000)
        put(state, f"{at}-state", n)
        put(spark.createDataFrame([(newest_t,)], "newest long").coalesce(1), f"{at}-clock", n)
        for part in ("narrow", "instants", "misses"):
            drop(spark, f"{at}-{part}/batch={n}")
        if n > 1:
            drop(spark, f"{at}-state/batch={n - 2}")

    rows = each_batch(submissions, "reuse", write, path=path)
    return spark.read.parquet(rows).drop("batch")


def reuse_from_completion(submissions: DataFrame, ttl: int = reuse.TTL_SECONDS, hot_rows: int = inflight.FOLDED_JOBS,
                          path: str | None = None, late_seconds: int = 0) -> DataFrame:
    """Like ``reuse_labels`` for submissions with ``completed_at``: a result lives from its completion.

    Between batches the results of misses are kept that are still alive or still to come; of those that are there
    already only the last one of a hash.  Rows older than the newest row of the batches before (less ``late_seconds``)
    are set apart with hit null and leave no result.
    """
    spark, wait = submissions.sparkSession, 2_000_000 * ttl

    def write(df: DataFrame, n: int, at: str) -> None:
        rows = staged(df.select("job_id", "code_hash", "created_at", "completed_at"), f"{at}-rows/{n}")
        known = (spark.read.parquet(f"{at}-state/batch={n - 1}").drop("batch") if n > 0
                 else spark.createDataFrame([], "code_hash string, effect long"))
        clock, t = newest_before(spark, at, n), micros(F.col("created_at"))
        behind = F.lit(False) if clock is None else t < clock - late_seconds * 1_000_000
        late, rows = rows.filter(behind), rows.filter(~behind)
        jobs = staged(inflight.jobs_of(rows), f"{at}-jobs/{n}")
        missed = inflight.miss_instants(jobs, known, ttl, hot_rows)
        missed = staged(jobs.join(missed, ["code_hash", "at"], "left_semi"), f"{at}-misses/{n}")
        labelled = rows.join(missed.select("job_id", F.lit(True).alias("_miss")), "job_id", "left").select(
            "job_id", "code_hash", F.col("_miss").isNull().alias("hit"))
        put(labelled.unionByName(late.select("job_id", "code_hash", F.lit(None).cast("boolean").alias("hit"))), at, n)
        newest_t = tell_newest(spark, at, n, clock, rows.agg(F.max(t)).first()[0])
        # whatever comes in a later batch follows these jobs, those of the same moment too
        results = known.union(missed.filter("effect IS NOT NULL").select("code_hash", inflight.even(F.col("effect"))))
        if newest_t is not None:
            oldest_t = 2 * (newest_t - late_seconds * 1_000_000)
            there = results.filter(F.col("effect") <= oldest_t).groupBy("code_hash").agg(F.max("effect").alias("effect"))
            results = there.filter(F.col("effect") + wait > oldest_t).union(results.filter(F.col("effect") > oldest_t).distinct())
        put(results, f"{at}-state", n)
        for part in ("rows", "jobs", "misses"):
            drop(spark, f"{at}-{part}/{n}")
        if n > 1:
            drop(spark, f"{at}-state/batch={n - 2}")

    rows = each_batch(submissions, "reuse", write, path=path)
    return spark.read.parquet(rows).drop("batch")


def possible_hits(submissions: DataFrame, completions: DataFrame, ttl: int = reuse.TTL_SECONDS, salts: int = 8) -> DataFrame:
    """Submissions with some completion of their hash in the hour before (an upper bound on hits).

    A semi join emits each submission once.  Completions are repeated per salt,
    so that one hash is spread over several tasks.
    """
    left = submissions.withColumn("salt", F.pmod("job_id", F.lit(salts)).cast("int")).withWatermark("created_at", "2 hours")
    right = completions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        F.col("code_hash").alias("h"), F.col("salt").alias("s"), "completed_at").withWatermark("completed_at", "2 hours")
    inside = (F.col("created_at") >= F.col("completed_at")) & (
        F.col("created_at") < F.col("completed_at") + F.make_dt_interval(secs=F.lit(ttl)))
    return left.join(right, (F.col("code_hash") == F.col("h")) & (F.col("salt") == F.col("s")) & inside,
                     "left_semi").drop("salt")


def possible_hits_by_batch(submissions: DataFrame, completions: DataFrame, ttl: int = reuse.TTL_SECONDS,
                           late_seconds: int = 7200, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Like ``possible_hits``, with the rows that come too late to tell in a second table.

    submissions(job_id, code_hash, created_at), completions(code_hash, completed_at) -> (job_id, code_hash, batch) of the
    possible hits and (job_id, code_hash, t, batch) of the late rows, job_id null for completions.  A row may be up to
    ``late_seconds`` older than the newest one of the batches before, on either side: a submission waits so long for
    its completion, a completion is kept one time to live longer.  The last completion before a submission
    decides, so rows of a hash are never paired and there is no fixed number of salts.
    """
    spark = submissions.sparkSession
    both = submissions.select("job_id", "code_hash", micros(F.col("created_at")).alias("t"), F.lit(False).alias("done")).unionByName(
        completions.select(F.lit(None).cast(submissions.schema["job_id"].dataType).alias("job_id"), "code_hash",
                           micros(F.col("completed_at")).alias("t"), F.lit(True).alias("done")))

    def write(df: DataFrame, n: int, at: str) -> None:
        rows, clock = staged(df, f"{at}-all/{n}"), newest_before(spark, at, n)
        kept = spark.read.schema(df.schema).parquet(f"{at}-state/batch={n - 1}") if n > 0 else rows.filter(F.lit(False))
        late = F.lit(False) if clock is None else F.col("t") <= clock - late_seconds * 1_000_000
        put(rows.filter(late).select("job_id", "code_hash", "t"), f"{at}-late", n)
        live = rows.filter(~late).unionByName(kept)
        landed = live.filter("done").select("job_id", "code_hash", "t", "done").distinct()
        judged = nearest(live.filter("NOT done"), landed.select("code_hash", "t"), ["code_hash"], "t", "t", False)
        judged = staged(judged.withColumn("hit", F.coalesce(F.col("t") < F.col("matched") + ttl * 1_000_000, F.lit(False))), f"{at}-judged/{n}")
        put(judged.filter("hit").select("job_id", "code_hash"), at, n)
        newest_t = tell_newest(spark, at, n, clock, rows.agg(F.max("t")).first()[0])
        since = (newest_t or 0) - late_seconds * 1_000_000
        put(judged.filter(~F.col("hit") & (F.col("t") > since)).select(*df.columns).unionByName(
            landed.filter(F.col("t") > since - ttl * 1_000_000)), f"{at}-state", n)
        for part in ("all", "judged"):
            drop(spark, f"{at}-{part}/{n}")
        if n > 1:
            drop(spark, f"{at}-state/batch={n - 2}")

    at = each_batch(both, "possible", write, path=path)
    kind = submissions.schema["job_id"].dataType.simpleString()
    return (spark.read.schema(f"job_id {kind}, code_hash string, batch int").parquet(at),
            spark.read.schema(f"job_id {kind}, code_hash string, t long, batch int").parquet(f"{at}-late"))


# ---- table changes --------------------------------------------------------------
def commit_changes(changes: DataFrame, table: DayTable, apply: Callable[[DataFrame, DataFrame], DataFrame], name: str,
                   path: str | None = None) -> int:
    """Apply a stream of changes to a table, a version for each batch; a replayed batch changes nothing.  Returns the version."""

    def write(df: DataFrame, n: int, at: str) -> None:
        rows = staged(df, f"{at}/{n}")
        table.update(rows, apply, (name, n))
        drop(changes.sparkSession, f"{at}/{n}")

    each_batch(changes, "changes", write, path=path)
    return table.manifest()["version"]


# ---- dashboards ----------------------------------------------------------------
def dashboard(stream: DataFrame, aggregate: Callable[[DataFrame], DataFrame], purpose: str, path: str | None = None) -> DataFrame:
    """A global aggregate that every batch replaces; the last one is returned."""
    at = each_batch(aggregate(stream), purpose, lambda df, n, p: put(df, p, n), "complete", path)
    rows = stream.sparkSession.read.parquet(at)
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


def letter_counts(letters: DataFrame) -> DataFrame:
    """Dead-letter statistics that a stream can keep (all but the distinct jobs)."""
    return letters.agg(
        F.count(F.lit(1)).alias("total_messages"), F.count_if(~F.col("resolved")).alias("unresolved"),
        F.count_if("resolved").alias("resolved"), F.avg("retry_count").alias("avg_retries"))


# ---- deadlines -----------------------------------------------------------------
DEADLINE = "job_id long, event_id long, status string, ts long, outcome string"
OPEN = "event_id long, status string, ts long"


def deadlines(log: DataFrame, seconds: int, delay: str = "1 hour") -> DataFrame:
    """Jobs that stay in a state that is not final for longer than ``seconds``: an event-time timeout per job.

    log(job_id, event_id, status, ts).  A row per missed deadline: ``late`` when the next state came after it,
    ``open`` when the watermark passed it with no further state.
    """
    wait = seconds * 1_000_000

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if state.hasTimedOut:
            out.append((key[0], *state.get, "open"))
            state.remove()
        else:
            now = tuple(state.get) if state.exists else None
            rows: list[tuple] = []
            for c in chunks:
                rows += zip(c["t"].tolist(), c["event_id"].tolist(), c["status"].tolist())
            for t, event, status in sorted(rows):
                if now is not None and t - now[2] > wait:
                    out.append((key[0], *now, "late"))
                now = None if status in J.TERMINAL else (event, status, t)
            if now is None:
                if state.exists:
                    state.remove()
            else:
                state.update(now)
                state.setTimeoutTimestamp(max((now[2] + wait) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "event_id", "status", "ts", "outcome"])

    narrow = log.select("job_id", "event_id", "status", micros(F.col("ts")).alias("t"), F.col("ts").cast("timestamp").alias("at"))
    return narrow.withWatermark("at", delay).groupBy("job_id").applyInPandasWithState(
        step, DEADLINE, OPEN, "append", GroupStateTimeout.EventTimeTimeout)


def missed_deadlines(log: DataFrame, seconds: int, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Jobs that stayed in a state that is not final for longer than ``seconds``, and the rows that came too late to tell.

    log(job_id, event_id, status, ts) -> (job_id, event_id, status, ts, outcome) and (job_id, event_id, status, ts, batch).
    ``late``: the next state came after the deadline.  ``open``: no further state by the newest time seen.  The last
    state of every job is kept in runs by job; a batch looks up its own jobs only, and all is done by the engine's joins
    and windows.  A row older than the state its job had in an earlier batch cannot be placed any more, since what
    follows it has been judged: it goes to the second table.  Rows of one batch may come in any order.
    """
    spark, order = log.sparkSession, ["ts", "event_id"]
    narrow = log.select("job_id", "event_id", "status", "ts")

    def table(at: str) -> Runs:
        return Runs(spark, f"{at}-last", narrow.schema, "job_id", newest_by("job_id", order))

    def write(df: DataFrame, n: int, at: str) -> None:
        last = table(at)
        df = staged(df, f"{at}-states/{n}")  # read once
        known = last.known(n - 1, df)
        before = known.select("job_id", F.struct(*order).alias("_last"))
        placed = df.join(before, "job_id", "left").withColumn("_behind", F.coalesce(F.struct(*order) < F.col("_last"), F.lit(False)))
        placed = staged(placed.drop("_last"), f"{at}-placed/{n}")
        put(placed.filter("_behind").drop("_behind"), f"{at}-behind", n)
        fresh = placed.filter("not _behind").drop("_behind")
        # the known state stands before the rows of its job; a repeated row is no new state
        states = known.unionByName(fresh).dropDuplicates(["job_id", "event_id", "status", "ts"])
        after = F.lead("ts").over(Window.partitionBy("job_id").orderBy(*order))
        judged = states.withColumn("_next", after).filter(
            ~F.col("status").isin(*J.TERMINAL) & (F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("_next")) > seconds * 1_000_000))
        put(judged.drop("_next").withColumn("outcome", F.lit("late")), at, n)
        last.add(n, newest(fresh, "job_id", order))
        drop(spark, f"{at}-states/{n}")
        drop(spark, f"{at}-placed/{n}")

    at = each_batch(narrow, "missed", write, path=path)
    late = spark.read.schema(T.StructType([*narrow.schema.fields, T.StructField("outcome", T.StringType()), T.StructField("batch", T.IntegerType())])).parquet(at).drop("batch")
    return late.unionByName(J.stuck(table(at).all(), seconds).select(*narrow.columns, F.lit("open").alias("outcome"))), spark.read.schema(
        _with_batch(narrow)).parquet(f"{at}-behind")


def letter_dashboard(letters: DataFrame, path: str | None = None) -> DataFrame:
    """All dead-letter statistics, brought up to date by every batch: counts, mean retries, jobs and newest letter.

    letters(job_id, resolved, retry_count, moved_to_dlq_at): jobs that a batch brings for the first time are counted
    against a keyed table of jobs, everything else is a sum or a maximum.
    """
    spark = letters.sparkSession

    def write(df: DataFrame, n: int, at: str) -> None:
        jobs = Runs(spark, f"{at}-jobs", "job_id long", "job_id", lambda rows: rows.distinct())
        here = df.filter("job_id is not null").select(F.col("job_id").cast("long").alias("job_id")).distinct()
        new = staged(here.join(jobs.known(n - 1, here), "job_id", "left_anti"), f"{at}-new/{n}")
        jobs.add(n, new)
        sums = df.agg(F.count(F.lit(1)).alias("total"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"),
                      F.coalesce(F.sum("retry_count"), F.lit(0)).alias("retries"), F.count("retry_count").alias("retried"),
                      F.max("moved_to_dlq_at").alias("newest"))
        now = sums.crossJoin(new.agg(F.count(F.lit(1)).alias("jobs")))  # one row each
        if n > 0:
            now = now.unionByName(spark.read.schema(now.schema).parquet(f"{at}/batch={n - 1}"))
            now = now.agg(*[(F.max if c == "newest" else F.sum)(c).alias(c) for c in now.columns])
        put(now.coalesce(1), at, n)
        drop(spark, f"{at}-new/{n}")

    at = each_batch(letters, "letters", write, path=path)
    rows = spark.read.parquet(at)
    last = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")
    return last.select(
        F.col("total").alias("total_messages"), "unresolved", "resolved", F.col("jobs").alias("unique_jobs"),
        F.when(F.col("retried") > 0, F.col("retries") / F.col("retried")).alias("avg_retries"), F.col("newest").alias("latest_message"))


def retention(letters: DataFrame, days: int, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows within ``days`` of the newest one seen, and per batch how many were kept and how many dropped.

    letters(..., moved_to_dlq_at).  A batch writes its own rows only, in folders by day.  Days that are over as a whole go as
    folders, counted from the manifest, without being read; of the one day that the limit cuts, the older rows are
    counted and hidden.  What is kept is never written again.  Rows without a time are kept.
    """
    spark, schema = letters.sparkSession, letters.schema
    manifest = "day date, version int, rows long"
    time = F.col("moved_to_dlq_at")

    def live(at: str, n: int) -> list[tuple]:
        """Day, batch that wrote it and rows of each folder; some for each day kept, so few."""
        return [tuple(r) for r in spark.read.schema(manifest).parquet(f"{at}-manifest/batch={n}").collect()] if n >= 0 else []

    def rows_of(at: str, parts: list[tuple]) -> DataFrame:
        paths = [f"{at}/version={v}/day={d if d is not None else '__HIVE_DEFAULT_PARTITION__'}" for d, v, _ in parts]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def write(df: DataFrame, n: int, at: str) -> None:
        fresh = df.withColumn("day", F.to_date(time))
        fresh.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{at}/version={n}")
        fresh = spark.read.schema(T.StructType([*schema.fields, T.StructField("day", T.DateType())])).parquet(f"{at}/version={n}")
        told = fresh.groupBy("day").agg(F.count(F.lit(1)).alias("rows"), F.max(time.cast("timestamp_ntz")).alias("newest")).collect()
        old = spark.read.parquet(f"{at}-counts/batch={n - 1}").first() if n > 0 else None
        newest_t = max([r["newest"] for r in told if r["newest"]] + ([old["newest"]] if old and old["newest"] else []), default=None)
        limit = newest_t - timedelta(days=days) if newest_t else None
        parts = live(at, n - 1) + [(r["day"], n, r["rows"]) for r in told]
        over = [p for p in parts if limit and p[0] and p[0] < limit.date()]
        left = [p for p in parts if p not in over]
        cut = [p for p in left if limit and p[0] == limit.date()]
        hidden = rows_of(at, cut).filter(time < F.lit(limit)).count() if cut else 0
        gone = (old["gone"] if old else 0) + sum(r for _, _, r in over)
        put(spark.createDataFrame(left, manifest).coalesce(1), f"{at}-manifest", n)
        kept = sum(r for _, _, r in left) - hidden
        dropped = gone + hidden - (old["gone"] + old["hidden"] if old else 0)
        put(spark.createDataFrame([(kept, dropped, gone, hidden, newest_t)], "kept long, dropped long, gone long, hidden long, newest timestamp_ntz").coalesce(1),
            f"{at}-counts", n)
        # a repeated batch begins with the manifest of the one before it, so its folders go one batch later
        for d, v, _ in (set(live(at, n - 2)) - set(live(at, n - 1)) if n > 1 else ()):
            drop(spark, f"{at}/version={v}/day={d}")

    at = each_batch(letters, "retained", write, path=path)
    counts = spark.read.parquet(f"{at}-counts")
    last = counts.orderBy(F.desc("batch")).first()
    rows = rows_of(at, live(at, last["batch"]))
    if last["newest"] is not None:
        rows = rows.filter(time.isNull() | (time >= F.lit(last["newest"] - timedelta(days=days))))
    return rows, counts.select("kept", "dropped", "batch")


__all__ = ["to_table", "each_batch", "review", "first_report", "dead_jobs", "route", "route_by_batch", "latest_status",
           "reuse_labels", "possible_hits", "dashboard", "letter_counts", "deadlines",
           "missed_deadlines", "letter_dashboard", "retention", "Runs"]
