"""Text report of one reviewed file, as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Labels and default texts of the report.
TITLE = "CODE REVIEW REPORT"
SECTIONS = {
    "security": ("SECURITY ISSUES (Critical)", "Follow best practices to fix this issue", True),
    "performance": ("PERFORMANCE ISSUES", "Optimize this section", True),
    "style": ("STYLE ISSUES", "Follow coding standards", False),
}
SUGGESTION_SECTION = "AI SUGGESTIONS"
NO_RULE = "N/A"
DOUBLE, SINGLE = "═" * 59 + "\n", "─" * 59 + "\n"


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _section(heading: str, entries: Column) -> Column:
    body = F.array_join(entries, "")
    return F.when(F.size(entries) > 0, _text(SINGLE, heading + "\n", SINGLE, "\n", body)).otherwise("")


def _issues(result: Column, bucket: str) -> Column:
    heading, fallback, severity = SECTIONS[bucket]

    def entry(i: Column, k: Column) -> Column:
        level = ["   Severity: ", i["severity"], "\n"] if severity else []
        return _text(k + 1, ". Line ", i["line"], ": ", i["message"], "\n", *level,
                     "   Rule: ", F.coalesce(i["rule"], F.lit(NO_RULE)), "\n",
                     "   Suggestion: ", F.coalesce(i["suggestion"], F.lit(fallback)), "\n\n")

    return _section(heading, F.transform(result[bucket], entry))


def _suggestions(result: Column) -> Column:
    def entry(s: Column, k: Column) -> Column:
        whole = F.when(s["line"] == F.floor(s["line"]), s["line"].cast("long").cast("string")).otherwise(s["line"].cast("string"))
        return _text(k + 1, ". Line ", whole, " - ", s["issue"], "\n   Category: ", s["category"],
                     "\n   Severity: ", F.upper(s["severity"]),
                     "\n   Explanation: ", F.coalesce(s["explanation"], F.lit("null")),
                     "\n   Suggestion: ", F.coalesce(s["suggestion"], F.lit("null")), "\n\n")

    return _section(SUGGESTION_SECTION, F.transform(result["aiSuggestions"], entry))


def report_text(result: Column, hit: bool = False) -> Column:
    """The report; sections without entries are left out, as are wall-clock lines."""
    m = result["metrics"]
    original = ["ORIGINAL ANALYSIS TIME: ", m["originalReviewTime"], "\nCACHE STATUS: ✓ Cache Hit (served instantly)\n"] if hit else []
    size = F.size
    return _text(
        DOUBLE, TITLE.center(59).rstrip() + "\n", DOUBLE, "\n",
        "FILE: ", result["fileName"], "\nLINES ANALYZED: ", m["linesAnalyzed"], "\nREVIEW TIME: ", m["reviewTime"], "\n",
        *original, "TOTAL ISSUES FOUND: ", m["issuesFound"], "\nPROCESSING TIME: ", m["processingTimeMs"], "ms\n\n",
        *[_issues(result, b) for b in SECTIONS], _suggestions(result),
        SINGLE, "SUMMARY\n", SINGLE, "\nSecurity Issues: ", size(result["security"]),
        "\nPerformance Issues: ", size(result["performance"]), "\nStyle Issues: ", size(result["style"]),
        "\nAI Suggestions: ", size(result["aiSuggestions"]), "\nTotal Issues: ", m["issuesFound"], "\n\n", DOUBLE)


def reports(results: DataFrame, key: str = "file_id") -> DataFrame:
    return results.select(key, report_text(F.col("result")).alias("report"))
