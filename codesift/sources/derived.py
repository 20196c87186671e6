"""Review inputs derived from the given tables: files, submissions, jobs, dead letters, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .snippets import ALL, BASIC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal out a source whose rows lie in fewer pieces than there are cores.

    The scan does much work per row, and a row group is read by one task however many splits its file has.  So splits
    count only as far as there are files to fill them; a source with at least as many files as cores is read as it lies.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    few = splits < cores or splits < 4 * cores and len(df.inputFiles()) < cores
    return df.repartition(cores, key) if few else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _pick(values: list[str], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def with_snippet(documents: DataFrame, snippets: list[tuple[str, str, str]]) -> DataFrame:
    """Files out of documents; a projection, so it works on a stream as well."""
    number = F.col("doc_id")
    bodies = [body.replace("~", "\n").replace("@", "'") for _, body, _ in snippets]
    return documents.select(
        number.alias("file_id"),
        F.concat(F.lit("f"), number.cast("string"), _pick([e for e, _, _ in snippets], number)).alias("file_name"),
        F.concat("text", F.lit("\n"), _pick(bodies, number)).alias("content"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document: its text followed by a snippet chosen by its number."""
    return with_snippet(documents(spark, sf_dir), BASIC)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like ``files`` with the long snippet list, so that every rule has findings."""
    return with_snippet(documents(spark, sf_dir), ALL)


def submissions(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Every event submits a file; many events submit the same one.

    ``of`` are the files, or what is needed of them: hashes computed there are computed once per file.
    """
    of = files(spark, sf_dir) if of is None else of
    events = table(spark, sf_dir, "events")
    count = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    picked = events.crossJoin(F.broadcast(count)).select(  # one row on the right
        F.col("event_id").alias("job_id"), "user_id", (F.col("event_id") % F.col("n")).alias("file_id"),
        F.col("ts").alias("created_at"))
    return picked.join(of, "file_id").select("job_id", "user_id", *of.columns, "created_at")


STATUS_BY_EVENT = {"signup": "queued", "view": "processing", "purchase": "complete", "error": "retrying"}


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs_of(table(spark, sf_dir, "events"))


def jobs_of(e: DataFrame) -> DataFrame:
    n = F.col("event_id")
    status = F.lit("dlq")
    for event, value in STATUS_BY_EVENT.items():
        status = F.when(F.col("event_type") == event, value).otherwise(status)
    return e.select(
        n.alias("id"), "user_id", F.concat(F.lit("f"), n.cast("string"), F.lit(".js")).alias("file_name"),
        status.alias("status"), (n % 3 == 0).alias("cache_hit"), (n % 3 + 1).cast("int").alias("attempts"),
        F.col("ts").alias("created_at"), F.floor(F.col("value") * 100).cast("int").alias("processing_time_ms"))


def review_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full job table: jobs plus result, error and dead-letter columns."""
    n, done = F.col("id"), F.col("status") == "complete"
    issues = (n % 11).cast("int")
    result = F.to_json(F.struct(
        F.col("file_name").alias("fileName"), F.struct(issues.alias("issuesFound")).alias("metrics")))
    return jobs(spark, sf_dir).select(
        "*", F.when(done, result).alias("result"),
        F.when(F.col("status").isin("retrying", "dlq"), F.concat(F.lit("error "), (n % 7).cast("string"))).alias("last_error"),
        F.when(F.col("status") == "dlq", F.concat(F.lit("m"), (n % 997).cast("string"))).alias("dlq_message_id"),
        F.when(F.col("status") == "dlq", F.col("created_at")).alias("dlq_moved_at"),
        F.when(done, F.col("created_at")).alias("completed_at"))


def dlq_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dlq_of(table(spark, sf_dir, "events"))


def dlq_of(e: DataFrame) -> DataFrame:
    n = F.col("event_id")
    return e.filter(F.col("event_type").isin("error", "click")).select(
        n.alias("id"), F.when(n % 5 == 0, -1 - n).otherwise(n - n % 4).alias("job_id"),
        F.concat(F.lit("m"), (n % 997).cast("string")).alias("message_id"),
        (3 + n % 2).cast("int").alias("receive_count"), F.col("ts").alias("moved_to_dlq_at"),
        (n % 4).cast("int").alias("retry_count"), (n % 3 == 0).alias("resolved"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue deliveries: up to four per message, three in five of them failing."""
    return deliveries_of(table(spark, sf_dir, "events"))


def deliveries_of(e: DataFrame) -> DataFrame:
    n = F.col("event_id")
    return e.select(
        n.alias("delivery_id"), (n - n % 4).alias("job_id"),
        F.concat(F.lit("m"), (n - n % 4).cast("string")).alias("message_id"),
        F.col("event_type").isin("error", "click", "view").alias("failed"),
        F.concat(F.lit("error "), (n % 7).cast("string")).alias("error"), F.col("ts").alias("delivered_at"))


PROVIDERS = ["openai", "mistral", "anthropic", "gemini"]


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model answer per document, with a defect chosen by its number."""
    def item(line="1", severity='"high"', category='"logic"', issue='"found"', explanation='"why"', drop=False):
        parts = [f'"line":{line}', f'"severity":{severity}', f'"category":{category}', f'"issue":{issue}']
        if not drop:
            parts.append(f'"explanation":{explanation}')
        return "{" + ",".join(parts + ['"suggestion":"fix"']) + "}"

    def body(*items: str) -> str:
        return '{"suggestions":[' + ",".join(items) + "]}"

    bodies = [
        body(item(line="#"), item(severity='"low"')), "```json\n" + body(item()) + "\n```",
        body(item(), item(drop=True)), body(item(line="0")), body(item(severity='"warning"')),
        body(item(category='"perf"')), body(item(issue='""')), "not json",
        body(item(explanation="null", line="2.5")), body(item(), '"text"'),
    ]
    doc, n = documents(spark, sf_dir), F.col("doc_id")
    lines = F.size(F.split("text", "\n", -1)).cast("string")
    return doc.select(
        n.alias("response_id"), _pick(PROVIDERS, n).alias("provider"),
        F.replace(_pick(bodies, n), F.lit("#"), lines).alias("body"))
