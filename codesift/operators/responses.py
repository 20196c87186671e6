"""Validation of raw model responses: valid suggestions here, reasons there."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T

# What a suggestion must look like, in the order of the checks.
REQUIRED = ["line", "severity", "category", "issue", "explanation", "suggestion"]
SEVERITIES = ["critical", "high", "medium", "low"]
CATEGORIES = ["security", "performance", "logic", "style", "reliability"]
NOT_OBJECT = "Response is not an object"
NOT_ARRAY = "suggestions is not an array"
BAD_LINE = "line must be a positive number"
BAD_ISSUE = "issue must be a non-empty string"

# Where each provider puts its text.
TEXT_PATH = {
    "gemini": "$.candidates[0].content.parts[0].text",
    "anthropic": "$.content[0].text",
    "openai": "$.choices[0].message.content",
}


def response_text(raw: DataFrame) -> DataFrame:
    """raw(provider, body): adds ``text``, the answer inside the provider's envelope."""
    text = F.get_json_object("body", TEXT_PATH["openai"])
    for provider in ("gemini", "anthropic"):
        text = F.when(F.col("provider") == provider, F.get_json_object("body", TEXT_PATH[provider])).otherwise(text)
    return raw.withColumn("text", text)


def wrap(provider, text):
    """A provider envelope around a text (the inverse, for inputs that hold bare text)."""
    gemini = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    anthropic = F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("content")))
    openai = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")))
    return F.when(provider == "gemini", gemini).when(provider == "anthropic", anthropic).otherwise(openai)


def parsed(texts: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``doc`` (variant) and ``reject``, the reason why a whole response is dropped."""
    doc = F.try_parse_json(T.strip_fences(F.col(column)))
    kind = "schema_of_variant(doc)"
    list_kind = "schema_of_variant(try_variant_get(doc, '$.suggestions', 'variant'))"
    scalar = ("exists(try_variant_get(doc, '$.suggestions', 'array<variant>'), "
              "x -> NOT (schema_of_variant(x) LIKE 'OBJECT%' OR schema_of_variant(x) LIKE 'ARRAY%'))")
    return texts.withColumn("doc", doc).withColumn("reject", F.expr(
        f"CASE WHEN {column} IS NULL OR {column} = '' THEN 'no text' WHEN doc IS NULL THEN 'not JSON' "
        f"WHEN NOT ({kind} LIKE 'OBJECT%' OR {kind} LIKE 'ARRAY%') THEN '{NOT_OBJECT}' "
        f"WHEN coalesce({list_kind}, '') NOT LIKE 'ARRAY%' THEN '{NOT_ARRAY}' "
        f"WHEN {scalar} THEN 'a suggestion is not an object' END"))


def _field(name: str) -> str:
    return f"try_variant_get(item, '$.{name}', 'variant')"


def _text(name: str) -> str:
    """The field as it appears in a message."""
    return f"coalesce(try_variant_get(item, '$.{name}', 'string'), 'null')"


def _reason() -> str:
    checks = [f"WHEN {_field(f)} IS NULL THEN 'Missing required field: {f}'" for f in REQUIRED]
    kind = f"schema_of_variant({_field('line')})"
    number = f"({kind} = 'BIGINT' OR {kind} = 'DOUBLE' OR {kind} LIKE 'DECIMAL%')"
    checks.append(f"WHEN NOT ({number} AND try_variant_get(item, '$.line', 'double') >= 1) THEN '{BAD_LINE}'")
    for name, allowed in (("severity", SEVERITIES), ("category", CATEGORIES)):
        listed = ", ".join(f"'{a}'" for a in allowed)
        is_text = f"schema_of_variant({_field(name)}) = 'STRING'"
        checks.append(f"WHEN NOT ({is_text} AND {_text(name)} IN ({listed})) THEN concat('Invalid {name}: ', {_text(name)})")
    checks.append(f"WHEN NOT (schema_of_variant({_field('issue')}) = 'STRING' AND {_text('issue')} <> '') THEN '{BAD_ISSUE}'")
    return "CASE " + " ".join(checks) + " END"


def items(docs: DataFrame, *carry: str) -> DataFrame:
    """One row per suggestion of a usable response, with the first failing check as ``reason``."""
    exploded = docs.filter("reject IS NULL").select(*carry, F.expr(
        "posexplode(try_variant_get(doc, '$.suggestions', 'array<variant>')) AS (i, item)"))
    return exploded.withColumn("reason", F.expr(_reason()))


def valid(checked: DataFrame, *carry: str) -> DataFrame:
    def get(name: str, kind: str = "string"):
        return F.expr(f"try_variant_get(item, '$.{name}', '{kind}')").alias(name)

    return checked.filter("reason IS NULL").select(*carry, "i", get("line", "double"), *[get(f) for f in REQUIRED[1:]])


def errors(checked: DataFrame, *carry: str) -> DataFrame:
    return checked.filter("reason IS NOT NULL").select(
        *carry, "i", F.format_string("Suggestion[%d]: %s", "i", "reason").alias("error"))


def suggestions_per_response(docs: DataFrame, key: str) -> DataFrame:
    """Valid suggestions of each response as one array, still in its row."""
    kept = (f"filter(try_variant_get(doc, '$.suggestions', 'array<variant>'), item -> ({_reason()}) IS NULL)")
    return docs.filter("reject IS NULL").select(key, F.expr(
        f"transform({kept}, item -> named_struct('line', try_variant_get(item, '$.line', 'double'), "
        + ", ".join(f"'{f}', try_variant_get(item, '$.{f}', 'string')" for f in REQUIRED[1:]) + "))").alias("suggestions"))


# ---- which files go to a model, and with what text ----------------------------
# fixed values: smallest and largest file
MIN_LINES, MAX_LINES = 5, 1000


def eligible(files: DataFrame, least: int = MIN_LINES, most: int = MAX_LINES) -> DataFrame:
    """Files of a size worth a model call."""
    return files.withColumn("n_lines", T.line_count(F.col("content"))).filter(F.col("n_lines").between(least, most))


def prompts(files: DataFrame) -> DataFrame:
    """Prompt text of each eligible file; the call itself is a job of its own."""
    language = T.prompt_language(F.col("file_name"))
    return eligible(files).select("file_id", language.alias("language"), "n_lines", F.concat(
        F.lit("Review this "), language, F.lit(" code.\n\nFILE: "), "file_name", F.lit("\nLINES: "),
        F.col("n_lines").cast("string"), F.lit("\n\nCODE:\n```"), language, F.lit("\n"), "content", F.lit("\n```")).alias("prompt"))
