"""Column functions over file names and file text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .dialect import SPACE, portable

# File extension to language, used to choose the rules.
LANGUAGE_BY_EXTENSION = {
    ".java": "java", ".py": "python", ".go": "go", ".rb": "ruby", ".php": "php", ".cs": "csharp",
    ".cpp": "cpp", ".c": "cpp", ".h": "cpp", ".ts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".jsx": "javascript",
}
JAVA_TEXT = r"public\s+class\s+\w|import\s+java\."
PYTHON_TEXT = r"^import\s+\w|^from\s+\w+\s+import|def\s+\w+\s*\("
DEFAULT_LANGUAGE = "javascript"

# File extension to the language name used in model prompts.
PROMPT_LANGUAGE = {
    "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python",
    "java": "java", "go": "go", "rb": "ruby", "php": "php", "cpp": "c++", "c": "c",
}
PROMPT_DEFAULT = "text"


def _lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hex."""
    return F.sha2(text, 256)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    return F.size(split_lines(text))


def file_extension(name: Column) -> Column:
    """Last extension in lower case, with its dot; names that start with the dot have none."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]*)\z", 1))


def detect_language(name: Column, text: Column) -> Column:
    """Language by extension, else by tell-tale text (java before python)."""
    by_name = F.element_at(_lookup(LANGUAGE_BY_EXTENSION), file_extension(name))
    by_text = (
        F.when(text.rlike(portable(JAVA_TEXT)), F.lit("java"))
        .when(text.rlike(portable(PYTHON_TEXT)), F.lit("python"))
        .otherwise(F.lit(DEFAULT_LANGUAGE))
    )
    return F.coalesce(by_name, by_text)


def prompt_language(name: Column) -> Column:
    """Language name shown to a model; the part after the last dot decides."""
    key = F.lower(F.substring_index(name, ".", -1))
    return F.coalesce(F.element_at(_lookup(PROMPT_LANGUAGE), key), F.lit(PROMPT_DEFAULT))


def count_of(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def trim_all(text: Column) -> Column:
    """Trim every kind of white space, line ends included."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def json_int(doc: Column, path: str) -> Column:
    """Integer field of a JSON text, null when absent."""
    return F.get_json_object(doc, path).try_cast("int")


def parse_int(text: Column, default: int) -> Column:
    """Integer from text, with a default for missing or malformed input."""
    return F.coalesce(text.try_cast("int"), F.lit(default))


def count_default(value: Column) -> Column:
    """A receive counter: missing and zero both mean one."""
    return F.when(F.coalesce(value, F.lit(0)) == 0, F.lit(1)).otherwise(value)


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def seconds_text(ms: Column) -> Column:
    """Whole milliseconds as seconds with one decimal, for example 1.5s.

    At five hundredths the binary value of the quotient decides, as it does in
    ECMAScript: ``error`` is that value times 1000 minus ``ms``, exactly.
    """
    q = ms / F.lit(1000.0)
    high = q * F.lit(134217729.0) - (q * F.lit(134217729.0) - q)
    product = q * F.lit(1000.0)
    error = (product - ms) + ((high * 1000.0 - product) + (q - high) * 1000.0)
    up = (ms % 100 > 50) | ((ms % 100 == 50) & (error >= 0))
    tenths = F.floor(ms / 100) + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))


def percent_text(rate: Column) -> Column:
    return F.format_string("%.2f%%", rate)


def strip_fences(text: Column) -> Column:
    """Remove a leading and trailing code fence from model text."""
    opened = F.regexp_replace(trim_all(text), r"^(?:```json)?(?:```)?", "")
    return trim_all(F.regexp_replace(opened, r"```\z", ""))
