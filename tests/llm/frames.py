"""Small tables with everything that may go wrong in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .brute import edited, prose

CLASHING = ["kept", "key", "label", "size", "block", "row", "window", "place", "shard", "slot", "copies", "set_id", "band", "h",
            "source_key", "n_words", "spans", "anchors", "_cell", "target", "turns", "segment"]


def with_clashes(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(-7) for c in CLASHING if c not in df.columns})


def document_rows() -> list[tuple]:
    """(doc_id, text, source): null and empty texts, null ids and sources, copies, near copies, repeated rows, a long text."""
    base = [prose(i, 120) for i in range(6)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(10 + i, edited(base[0], i, 0.01 + 0.006 * i), "s0") for i in range(12)]
    rows += [(30 + i, base[1], "s1") for i in range(4)]
    rows += [(40, None, "s2"), (41, "", "s2"), (42, "  \n\t ", None), (43, "one two", "s2"), (44, "ONE two", "s2"), (45, "one", None)]
    rows += [(None, base[2], "s0"), (None, "alone " + prose(77, 60), None), (46, None, None)]
    rows += [(50, base[3] + " " + base[4], "s1"), (51, prose(5, 30) + "\n" + base[4] + "\n" + prose(6, 30), "s1")]
    rows += [(60, "ka lo ti an be or shu\n" * 40, "s2"), (61, prose(8, 70) + " " + prose(8, 70), "s2")]
    rows += [(70, prose(9, 9000), "s0"), (71, "😀 naïve word  x " * 30, "s0")]
    rows += [rows[3], rows[3]]
    return rows


def documents(spark: SparkSession, rows=None) -> DataFrame:
    rows = document_rows() if rows is None else rows
    return spark.createDataFrame([(d, t, "xx", s, len(t or "")) for d, t, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
