"""From findings to issues, buckets, score, grade and the result document."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..functions.expr import let, quoted
from ..rules import CATALOGUE, PENALTY, Rule

BUCKETS = ("security", "performance", "style")
SUGGESTIONS = ("array<struct<line:double,severity:string,category:string,issue:string,"
               "explanation:string,suggestion:string>>")


def catalogue(spark: SparkSession, extra: Iterable[Rule] = ()) -> DataFrame:
    """The rule catalogue as a dimension table: fixed size, one row per rule."""
    rows = [(r.key, r.name, r.severity, r.category, r.bucket, r.penalty, r.message, r.advice)
            for r in [*CATALOGUE, *extra]]
    return spark.createDataFrame(
        rows, "key string, rule string, severity string, category string, bucket string, penalty double,"
              " message string, suggestion string")


def _catalogue_map(extra: Iterable[Rule] = ()) -> str:
    """The catalogue as a map literal; the optimizer folds it into one constant."""
    rows = []
    for r in [*CATALOGUE, *extra]:
        category = quoted(r.category) if r.category else "cast(null as string)"
        rows.append(f"'{r.key}', named_struct('rule', {quoted(r.name)}, 'severity', '{r.severity}', "
                    f"'category', {category}, 'bucket', '{r.bucket}', 'penalty', {r.penalty}D, "
                    f"'message', {quoted(r.message)}, 'suggestion', {quoted(r.advice)})")
    return f"map({', '.join(rows)})"


def with_issues(scanned: DataFrame, extra: Iterable[Rule] = ()) -> DataFrame:
    """Replace hits by full issues, still inside the row of the file."""
    looked_up = let(f"element_at({_catalogue_map(extra)}, h.key)", "c", (
        "named_struct('line', h.line, 'message', replace(c.message, '{}', coalesce(h.detail, '')), "
        "'severity', c.severity, 'rule', c.rule, 'suggestion', c.suggestion, 'category', c.category, "
        "'bucket', c.bucket, 'penalty', c.penalty)"))
    keep = [f"`{c}`" for c in scanned.columns if c != "hits"]
    return scanned.selectExpr(*keep, f"transform(hits, h -> {looked_up}) AS issues")


def issues_long(scanned_findings: DataFrame, extra: Iterable[Rule] = ()) -> DataFrame:
    """Long form: findings joined to the catalogue (about a hundred rows, so broadcast)."""
    dim = catalogue(scanned_findings.sparkSession, extra)
    return scanned_findings.join(F.broadcast(dim), "key").withColumn(
        "message", F.replace("message", F.lit("{}"), F.coalesce("detail", F.lit(""))))


def score_of(issues: Column, suggestions: Column | None = None) -> Column:
    """100 minus all penalties, kept within 0 and 100."""
    lost = F.aggregate(issues, F.lit(0.0), lambda a, i: a + i["penalty"])
    if suggestions is not None:
        weights = F.create_map(*[F.lit(x) for kv in PENALTY["suggestion"].items() for x in kv])
        lost = lost + F.aggregate(suggestions, F.lit(0.0), lambda a, s: a + F.coalesce(
            F.element_at(weights, s["severity"]), F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - lost))


# fixed values: lowest score of each grade
GRADES = (("A", 90), ("B", 80), ("C", 70), ("D", 60))
LOWEST_GRADE = "F"


def grade_of(score: Column) -> Column:
    grade = F.lit(LOWEST_GRADE)
    for letter, least in reversed(GRADES):
        grade = F.when(score >= least, letter).otherwise(grade)
    return F.when(score.isNotNull(), grade)


def in_bucket(issues: Column, bucket: str) -> Column:
    return F.filter(issues, lambda i: i["bucket"] == bucket)


def severe(issues: Column) -> Column:
    """High and critical issues of the security and performance buckets, in that order."""
    both = F.concat(in_bucket(issues, "security"), in_bucket(issues, "performance"))
    return F.filter(both, lambda i: i["severity"].isin("high", "critical"))


def scored(reviewed: DataFrame) -> DataFrame:
    """Adds counts per bucket, score and grade; narrow when only these are selected.

    A file without text was not reviewed: it has neither score nor grade.
    """
    return reviewed.withColumns({
        **{f"n_{b}": F.size(in_bucket(F.col("issues"), b)) for b in BUCKETS},
        "n_issues": F.size("issues"), "score": F.when(F.col("n_lines").isNotNull(), score_of(F.col("issues"))),
    }).withColumn("grade", grade_of(F.col("score")))


def _public(issues: Column) -> Column:
    """Issue fields of the result document."""
    return F.transform(issues, lambda i: F.struct(*[
        i[f].alias(f) for f in ("line", "message", "severity", "rule", "suggestion", "category")]))


def result_struct(suggestions: Column, processing_ms: Column) -> Column:
    """The nested result document of one reviewed file."""
    issues = F.col("issues")
    return F.struct(
        F.col("file_name").alias("fileName"),
        *[_public(in_bucket(issues, b)).alias(b) for b in BUCKETS],
        suggestions.alias("aiSuggestions"),
        grade_of(score_of(issues, suggestions)).alias("qualityScore"),
        F.struct(
            T.seconds_text(processing_ms).alias("reviewTime"), F.col("n_lines").alias("linesAnalyzed"),
            (F.size(issues) + F.size(suggestions)).alias("issuesFound"),
            processing_ms.cast("int").alias("processingTimeMs")).alias("metrics"))


def with_result(reviewed: DataFrame, suggestions: str | None = None, processing_ms: str | None = None) -> DataFrame:
    """Adds ``result``; suggestions and processing time are columns of the frame when given."""
    s = F.col(suggestions) if suggestions else F.array().cast(SUGGESTIONS)
    s = F.coalesce(s, F.array().cast(SUGGESTIONS))
    ms = F.col(processing_ms) if processing_ms else F.lit(0)
    return reviewed.withColumn("result", result_struct(s, ms))
